"""Operator 5, MinHash near-dedup.

Documents are sets of five-word shingles weighted by TF-IDF. Improved consistent
weighted sampling turns a weighted set into samples that two documents share with
the probability of their weighted Jaccard similarity; samples in bands give
candidate groups; candidates are verified on their whole weighted sets.

No group is expanded into pairs. In each candidate group every member is held
against the group's leader, which joins most of what belongs together. What is
still apart in a group is then settled exactly, block by block: of all pairs in two
chunks of a group, those that reach the threshold are found where the blocks lie,
and only as many links leave as it takes to join them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, fresh, give_back, stored, unpickled
from .components import connected_components
from .frequencies import UNIT, Idf, summed
from .words import ID_BITS, Shingler, chunks, mixed, pack_counts, pack_ids, unpack_counts, unpack_ids

_MIX = np.uint64(0xFF51AFD7ED558CCD)


@dataclass(frozen=True)
class NearDupParams:
    shingle: int = 5
    similarity: float = 0.8
    bands: int = 12
    rows: int = 4
    #: Counters in each of the two rows of the document-frequency sketch, whatever the corpus' size.
    df_bits: int = 19
    #: Shingles rarer than one in two to the power of this have the same weight.
    rare_bits: int = 15
    #: Texts that share one of four smallest shingles with more than one in so many texts count as one document of a group.
    group_share: int = 4096
    #: Pairs of one leader that are verified together.
    leader_chunk: int = 256
    #: Texts of a chunk of a group whose pairs are all looked at.
    block: int = 384
    seed: int = 20


class Groups:
    """How much each text counts among documents: one, or its share of a large group of copies.

    Four hashes of a text's smallest shingles are counted in a table of 2**16
    counters each. Copies, near ones included, share at least one of them, so the
    fullest counter tells the size of a text's group, to within the table's noise.
    """

    BITS, HASHES = 16, 4

    def __init__(self, counts: np.ndarray, share: int):
        n = int(counts[: 1 << self.BITS].sum())
        large = counts.reshape(self.HASHES, -1) * share > max(n, share)
        self.units = np.where(large, np.maximum(1, UNIT // np.maximum(counts.reshape(self.HASHES, -1), 1)), UNIT).astype(np.int64)

    @classmethod
    def counters(cls, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(hashes, texts) places in the flat table."""
        out = np.empty((cls.HASHES, len(starts)), np.int64)
        for k in range(cls.HASHES):
            least = np.minimum.reduceat(mixed(ids + np.uint64((k + 1) << ID_BITS)), starts) if len(starts) else np.zeros(0, np.uint64)
            out[k] = (mixed(least) >> np.uint64(64 - cls.BITS)).astype(np.int64) + (k << cls.BITS)
        return out

    def __call__(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Units of each text."""
        return self.units.ravel()[self.counters(ids, starts)].min(axis=0)


def weighted_set(shingler: Shingler, text: str, idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    ids, tf = shingler.one(text)
    return ids, tf * idf(ids)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima of two sets in ascending order; 0 if both are empty."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    hit = b[0][at] == a[0]
    low = float(np.minimum(a[1][hit], b[1][at[hit]]).sum())
    high = float(a[1].sum() + b[1].sum()) - low
    return low / high if high else 0.0


class WeightedSampler:
    """Improved consistent weighted sampling of many sets at a time.

    The variates of a (shingle, sample) are the same for all documents: Gamma(2, 1)
    r with the uniform b from one table of 2**14 entries, Gamma(2, 1) c from
    another, at different bits of a hash of both. A core's cache holds the tables,
    and 2**28 combinations keep the shingles of a long text apart.
    """

    BITS = 14

    def __init__(self, samples: int, seed: int):
        rng = np.random.RandomState(seed)
        n = 1 << self.BITS
        r = rng.gamma(2.0, 1.0, n)
        self.log_c = np.log(rng.gamma(2.0, 1.0, n)).astype(np.float32)
        b = rng.uniform(0.0, 1.0, n)
        self.r, self.inverse, self.b = r.astype(np.float32), (1.0 / r).astype(np.float32), b.astype(np.float32)
        # log a = log c - r * (t - b) - r
        self.head = (r * b - r).astype(np.float32)
        self.factors = rng.randint(0, 2**63 - 1, samples, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, ids: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(sets, samples) of 64-bit samples (shingle, t); every set has a member."""
        n = len(ids)
        log_w = np.log(weights).astype(np.float32)
        sizes = np.diff([*starts, n])
        out = np.empty((len(starts), len(self.factors)), np.uint64)
        shift, shift2, low = np.uint64(64 - self.BITS), np.uint64(64 - 2 * self.BITS), np.uint64((1 << self.BITS) - 1)
        ids = mixed(ids)  # multiplication spreads only upwards
        h, at2 = np.empty((2, n), np.uint64)
        part, log_a, t = np.empty((3, n), np.float32)
        for k, factor in enumerate(self.factors):
            np.multiply(ids, factor, out=h)
            np.right_shift(h, shift2, out=at2)
            np.bitwise_and(at2, low, out=at2)
            np.right_shift(h, shift, out=h)
            at = h.view(np.intp)
            np.take(self.inverse, at, out=t, mode="clip")
            t *= log_w
            np.take(self.b, at, out=part, mode="clip")
            t += part
            np.floor(t, out=t)
            np.take(self.r, at, out=part, mode="clip")
            part *= t
            np.take(self.head, at, out=log_a, mode="clip")
            log_a -= part
            np.take(self.log_c, at2.view(np.intp), out=part, mode="clip")
            log_a += part
            hits = np.flatnonzero(log_a == np.repeat(np.minimum.reduceat(log_a, starts), sizes))
            owner = np.searchsorted(starts, hits, side="right") - 1
            best = hits[np.flatnonzero(np.diff(owner, prepend=-1))]  # ids come in one order within a set: ties go to the first
            out[:, k] = mixed(ids[best] + t[best].astype(np.int64).astype(np.uint64) * _MIX)
        return out


def text_node(text: Column) -> Column:
    """What stands for a text: its MD5, so equal texts are one node."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def document_frequencies(docs: DataFrame, text: str, params: NearDupParams) -> Idf:
    """The weights, from all documents in two passes: sizes of groups of copies, then frequencies in which a group counts as one document."""

    def count_groups(texts: list[str], table: np.ndarray) -> int:
        ids, _, starts, _ = Shingler(params.shingle).sets(texts)
        table += np.bincount(Groups.counters(ids, starts).ravel(), minlength=len(table))
        return 0

    groups = Groups(summed(docs, text, Groups.HASHES << Groups.BITS, count_groups)[0], params.group_share)
    bits = params.df_bits

    def count_shingles(texts: list[str], table: np.ndarray) -> int:
        ids, _, starts, _ = Shingler(params.shingle).sets(texts)
        if not len(ids):
            return 0
        units = groups(ids, starts)
        each = np.repeat(units, np.diff([*starts, len(ids)]))
        for row, at in enumerate(Idf.counters(ids, bits)):
            np.add.at(table, at + (row << bits), each)
        return int(units.sum())

    return Idf(bits, params.rare_bits, *summed(docs, text, 2 << bits, count_shingles))


def signatures(docs: DataFrame, text: str, idf_bytes, params: NearDupParams) -> DataFrame:
    """``node, bands`` for each row with words; ``bands`` are hashes of ``rows`` samples each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf: Idf = unpickled(idf_bytes)
        shingler, sampler = Shingler(params.shingle), WeightedSampler(params.bands * params.rows, params.seed)
        for batch in batches:
            done = 0
            for texts in chunks([t or "" for t in batch.column(1).to_pylist()]):
                ids, tf, starts, of = shingler.sets(texts)
                if len(of):
                    samples = sampler(ids, tf * idf(ids), starts)
                    keys = np.zeros((len(of), params.bands), np.uint64)
                    for r in range(params.rows):
                        keys = mixed(keys * np.uint64(31) + samples[:, r :: params.rows])
                    keys = mixed(keys + np.arange(params.bands, dtype=np.uint64)).astype(np.int64)
                    bands = pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1) * params.bands, pa.int32()), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of + done)), bands], names=["node", "bands"])
                done += len(texts)
        give_back()

    return docs.select(text_node(docs[text]).alias("node"), docs[text].cast("string")).mapInArrow(work, "node binary, bands array<long>")


def sets_of(nodes: DataFrame, docs: DataFrame, representatives: DataFrame, key: str, text: str, params: NearDupParams) -> DataFrame:
    """``node, ids, counts`` for each of ``nodes``: the packed shingles of its text, fetched by node and smallest document id, so copies of a text don't meet in one task."""
    wanted = stored(nodes.join(representatives, "node").select("node", "rep"), "neardup-wanted")
    rows = docs.select(text_node(docs[text]).alias("node"), docs[key].alias("rep"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"))
    texts = rows.join(wanted.hint("merge"), (rows["node"] == wanted["node"]) & rows["rep"].eqNullSafe(wanted["rep"]), "left_semi").select("node", "t")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(params.shingle)
        for batch in batches:
            nodes, ids, counts, done = [], [], [], 0
            for texts in chunks(batch.column(1).to_pylist()):
                all_ids, tf, starts, of = shingler.sets(texts)
                for i, a, b in zip(of.tolist(), starts.tolist(), [*starts[1:].tolist(), len(all_ids)]):
                    nodes.append(i + done)
                    ids.append(pack_ids(all_ids[a:b]))
                    counts.append(pack_counts(tf[a:b]))
                done += len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(nodes, pa.int64())), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["node", "ids", "counts"])
        give_back()

    made = stored(texts.mapInArrow(work, "node binary, ids binary, counts binary"), "neardup-sets")
    # Rows that repeat key and text came more than once.
    if stored_rows_repeat(made):
        once = stored(made.dropDuplicates(["node"]), "neardup-sets")
        drop_stored(made)
        made = once
    drop_stored(wanted)
    return made


def stored_rows_repeat(sets: DataFrame) -> bool:
    return bool(sets.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").take(1))


def opened(ids: bytes, counts: bytes, idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    """A packed set with its weights."""
    found = unpack_ids(ids)
    return found, unpack_counts(counts, len(found)) * idf(found)


def spanning_links(ids: list[np.ndarray], weights: list[np.ndarray], classes: np.ndarray, similarity: float) -> list[tuple[int, int, float]]:
    """(i, j, similarity) of links between different classes that join whatever such links join: a spanning forest of all pairs.

    Overlaps of all pairs are added up shingle by shingle over a table of one
    number for each pair, so the sets are bounded by the block that they come in.
    """
    n = len(ids)
    owner = np.repeat(np.arange(n), [len(x) for x in ids])
    shingle, weight = np.concatenate(ids), np.concatenate(weights)
    order = np.argsort(shingle, kind="stable")
    shingle, weight, owner = shingle[order], weight[order], owner[order]
    total = np.array([w.sum() for w in weights])
    cuts = np.flatnonzero(np.diff(shingle, prepend=shingle[:1] + np.uint64(1)))
    sizes = np.diff(np.append(cuts, len(shingle)))
    overlap = np.zeros((n, n))
    for at, m in zip(cuts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        who, w = owner[at : at + m], weight[at : at + m]
        overlap[np.ix_(who, who)] += np.minimum(w[:, None], w[None, :])
    union = total[:, None] + total[None, :] - overlap
    alike = overlap / np.maximum(union, 1e-300)
    near = (alike >= similarity) & (classes[:, None] != classes[None, :])
    out, seen = [], np.zeros(n, bool)
    for first in range(n):
        if seen[first] or not near[first].any():
            continue
        seen[first] = True
        todo = [first]
        while todo:
            i = todo.pop()
            new = np.flatnonzero(near[i] & ~seen)
            seen[new] = True
            out += [(i, int(j), float(alike[i, j])) for j in new]
            todo += new.tolist()
    return out


def open_links(members: DataFrame, classes: DataFrame, sets: DataFrame, idf_bytes, params: NearDupParams) -> DataFrame:
    """``a, b, similarity``: links that join whatever pairs of similar texts in one group join, among groups that still hold several classes.

    A group of two has been verified by its leader. Every pair of a group meets in
    one block of two of its chunks, which have ``block`` texts each on average; what
    leaves a block are fewer links than it has texts.
    """
    at = stored(members.join(classes, "node", "left").select("band", F.coalesce("component", "node").alias("class"), "node"), "neardup-at")
    several = stored(at.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("n")).filter("n > 2 and low <> high").select("band", F.ceil(F.col("n") / params.block).cast("int").alias("chunks")), "neardup-several")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    block = lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j"))
    dealt = at.join(several, "band").select("*", own.alias("own")).select("band", "class", "node", F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), block)).alias("x"))
    # Nodes are dealt first: their sets join them by node, many groups to a task.
    nodes = stored(dealt.select("band", "class", "node", "x.i", "x.j"), "neardup-open")
    drop_stored(at, several)

    def work(table: pa.Table) -> pa.Table:
        schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())])
        _, of = np.unique(np.array(table.column("class").to_pylist(), dtype=object), return_inverse=True)
        if of.max(initial=0) == 0:
            return schema.empty_table()
        idf: Idf = cloudpickle.loads(idf_bytes.value)
        both = [opened(x, c, idf) for x, c in zip(table.column("ids").to_pylist(), table.column("counts").to_pylist())]
        names = table.column("node").to_pylist()
        found = spanning_links([x for x, _ in both], [w for _, w in both], of, params.similarity)
        pairs = [(*sorted((names[i], names[j])), s) for i, j, s in found]
        return pa.table([pa.array([p[k] for p in pairs], schema.types[k]) for k in range(3)], schema=schema)

    rows = nodes.join(sets, "node").select("band", "i", "j", "class", "node", "ids", "counts")
    found = stored(rows.groupBy("band", "i", "j").applyInArrow(work, "a binary, b binary, similarity double"), "neardup-links")
    drop_stored(nodes)
    return found


def verified(pairs: DataFrame, sets: DataFrame, idf_bytes, params: NearDupParams) -> DataFrame:
    """The ``pairs(a, b, chunk)`` whose weighted Jaccard similarity reaches the threshold, with it.

    A leader's set goes to each chunk of its pairs, which keeps a leader of many in
    many tasks. The table is written as it is a link in several later joins.
    """
    left = pairs.select("a", "chunk").distinct().join(sets.select(F.col("node").alias("a"), F.col("ids").alias("ia"), F.col("counts").alias("ca")), "a")
    whole = pairs.join(sets.select(F.col("node").alias("b"), F.col("ids").alias("ib"), F.col("counts").alias("cb")), "b").join(left, ["a", "chunk"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf: Idf = unpickled(idf_bytes)
        last: tuple = (None, None)
        for batch in batches:
            keep, values = [], []
            for n, (a, ia, ca, ib, cb) in enumerate(zip(batch.column(0), *(batch.column(k) for k in (2, 3, 4, 5)))):
                if last[0] != (node := a.as_py()):
                    last = (node, opened(ia.as_py(), ca.as_py(), idf))
                s = weighted_jaccard(last[1], opened(ib.as_py(), cb.as_py(), idf))
                if s >= params.similarity:
                    keep.append(n)
                    values.append(s)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(values, pa.float64())], names=["a", "b", "similarity"])
        give_back()

    return stored(whole.select("a", "b", "ia", "ca", "ib", "cb").mapInArrow(work, "a binary, b binary, similarity double"), "neardup-links")


def class_table(docs: DataFrame, params: NearDupParams, key: str, text: str) -> DataFrame:
    """``node, rep, rep_rows, copies, component, checked_links``, one stored row for each distinct text."""
    spark = docs.sparkSession
    idf = document_frequencies(docs, text, params)
    idf_bytes = spark.sparkContext.broadcast(cloudpickle.dumps(idf))
    keys = docs.select(docs[key].alias("rep"), text_node(docs[text]).alias("node"))
    rows = keys.groupBy("node", "rep").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("rep").isNull().alias("z"), "rep", "n"))
    representatives = stored(rows.groupBy("node").agg(least.alias("x"), F.sum("n").alias("copies")).select("node", F.col("x.rep").alias("rep"), F.col("x.n").alias("rep_rows"), "copies"), "neardup-nodes")
    marks = stored(signatures(docs, text, idf_bytes, params).groupBy("node").agg(F.first("bands").alias("bands")), "neardup-signatures")
    members = marks.select("node", F.explode("bands").alias("band"))
    # Written first, so that the join is one of its own and a large group can be split.
    leaders = stored(members.groupBy("band").agg(F.min("node").alias("lead"), F.count("*").alias("n")).filter("n > 1"), "neardup-leaders")
    grouped = stored(members.join(leaders, "band"), "neardup-members")
    drop_stored(marks, leaders)
    members = grouped.select("band", "node")
    sets = sets_of(grouped.select("node").distinct(), docs, representatives, key, text, params)
    chunk = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / params.leader_chunk)).cast("int")

    def candidates(found: DataFrame) -> DataFrame:
        """``a, b, chunk`` of distinct pairs; a leader's chunks are as many as its largest group asks for."""
        return found.groupBy("a", "b").agg(F.max("n").alias("n")).select("a", "b", chunk.alias("chunk"))

    tried = stored(candidates(grouped.select(F.col("lead").alias("a"), F.col("node").alias("b"), "n").filter("a <> b")), "neardup-pairs")
    links = verified(tried, sets, idf_bytes, params)
    classes = stored(connected_components(links), "neardup-classes")
    # What the leaders left open.
    more = open_links(members, classes, sets, idf_bytes, params)
    if more.take(1):
        links = links.union(more)
        before, classes = classes, stored(connected_components(links), "neardup-classes")
        drop_stored(before)
    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("checked_links"))
    whole = representatives.join(classes, "node", "left").join(degree, "node", "left")
    out = stored(whole.select("node", "rep", "rep_rows", "copies", F.coalesce("component", "node").alias("component"), F.coalesce("checked_links", F.lit(0)).cast("long").alias("checked_links")), "neardup-texts")
    drop_stored(grouped, sets, tried, classes, representatives)
    idf_bytes.unpersist()
    return out


def named_classes(texts: DataFrame) -> DataFrame:
    """``node, class_node, class_id, class_size, checked_links`` from ``class_table``'s rows."""
    lowest = F.min(F.struct(F.col("rep").isNull().alias("z"), "rep"))
    named = stored(texts.groupBy("component").agg(lowest.alias("x"), F.sum("copies").alias("class_size")).select("component", F.col("x.rep").alias("class_id"), "class_size"), "neardup-names")
    return stored(texts.join(named, "component").select("node", F.col("component").alias("class_node"), "class_id", "class_size", "checked_links"), "neardup-classes")


def near_duplicate_classes(docs: DataFrame, params: NearDupParams = NearDupParams(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, node, class_node, class_id, class_size, checked_links`` for each row of ``docs``; ``node`` is the MD5 of the text, ``class_node`` the least in the class.

    Rows are in one class if a chain of verified links joins their texts; equal
    texts are always in one, null counting as the empty text. Texts without words
    are like their exact copies only; texts of fewer than five words are one
    shingle. ``class_id`` is the least key in the class (nulls last).
    ``checked_links`` counts the links of the row's text that were verified on the
    way; two members of a class needn't have been held against each other. An
    empty table gives an empty result; other columns don't come out.
    """
    # A table of its own, so that the join can split a text of many copies.
    whole = named_classes(class_table(docs, params, key, text))
    keys = docs.select(docs[key].alias("rep"), text_node(docs[text]).alias("node"))
    return keys.join(whole.hint("merge"), "node").select(F.col("rep").alias(key), "node", "class_node", "class_id", "class_size", "checked_links")


def deduplicate(docs: DataFrame, params: NearDupParams = NearDupParams(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of the least key, by text where several texts of a class share it; of rows repeating key and text, one. All columns stay."""
    texts = class_table(docs, params, key, text)
    lowest = F.min(F.struct(F.col("rep").isNull().alias("z"), "rep", "node", "rep_rows"))
    a, b = fresh(docs, "kept_id", "kept_node")
    kept = stored(texts.groupBy("component").agg(lowest.alias("x")).select(F.col("x.rep").alias(a), F.col("x.node").alias(b), F.col("x.rep_rows").alias("rep_rows")), "neardup-kept")
    ones = kept.hint("merge")
    out = docs.join(ones, docs[key].eqNullSafe(ones[a]) & (text_node(docs[text]) == ones[b]), "left_semi")
    if not kept.filter("rep_rows > 1").take(1):
        return out
    marked = out.withColumn(b, text_node(out[text]))
    return marked.dropDuplicates([key, b]).drop(b)
