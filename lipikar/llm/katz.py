"""Operator 8, LM scoring by a Katz backoff model, of order three unless told otherwise.

Counts are Good-Turing discounted; what that frees in a context goes to words not
seen there, in proportion to their probability in the context shortened by its
first word, by a weight that makes the context's probabilities add up to one. So a
token's probability is found by recursion over shorter contexts. Unigrams back off
in the same way to one class of unknown words.

The corpus is cut into batches of documents. A batch asks for each of its distinct
words, then for its distinct n-grams of each order, once, in packed columns dealt
out by a hash of the word or context; the partition that owns it adds up the
counts of all batches, stores its part of the model in rows of bounded size and
answers every batch in the order in which it asked. There are as many partitions as
batches at least, and a frequent context is dealt to several, so no partition grows
with the corpus. What an n-gram's context was seen comes from the order below; a
context seen once, that no held-out text has, is known to the batch that holds it
and isn't asked for.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import count as counter

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stored, give_back, stored
from .words import mixed


@dataclass(frozen=True)
class KatzParams:
    order: int = 3
    #: Counts up to this are discounted.
    cutoff: int = 5
    #: A batch is closed by the document that brings it to so many tokens.
    batch_tokens: int = 1_300_000
    #: A context seen more often is dealt to several partitions, this many tokens to each.
    hot: int = 500_000
    #: N-grams in a row of the stored model.
    block: int = 1 << 16


@cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()


def pack(a: np.ndarray) -> bytes:
    """Non-negative integers in the fewest bytes each, plane by plane, compressed."""
    width = 1
    top = int(a.max(initial=0))
    while top >> (8 * width):
        width *= 2
    planes = np.ascontiguousarray(a.astype(f"<u{width}")).view(np.uint8).reshape(-1, width).T
    return bytes([width]) + _zstd()[0].compress(planes.reshape(-1))


def unpack(b: bytes) -> np.ndarray:
    width = b[0]
    planes = np.frombuffer(_zstd()[1].decompress(memoryview(b)[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.uint64 if width == 8 else np.int64)


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending integers by their differences."""
    return pack(np.diff(a, prepend=0))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b).astype(np.int64))


def ranked(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values in ascending order, the first place of each, each value's number among them), as ``np.unique`` gives them.

    A value and its place are sorted as one number where both fit into 64 bits,
    which takes a fourth of the time of sorting places by values.
    """
    bits = max(len(a) - 1, 0).bit_length()
    if not len(a) or int(a.min()) < 0 or int(a.max()) >> (64 - bits):
        return np.unique(a, return_index=True, return_inverse=True)
    both = (a.astype(np.uint64) << np.uint64(bits)) | np.arange(len(a), dtype=np.uint64)
    both.sort()
    at = (both & np.uint64((1 << bits) - 1)).astype(np.int64)
    both >>= np.uint64(bits)
    new = np.ones(len(a), bool)
    np.not_equal(both[1:], both[:-1], out=new[1:])
    number = np.empty(len(a), np.int64)
    number[at] = np.cumsum(new) - 1
    return both[new].astype(a.dtype), at[new], number


def steady(a: np.ndarray) -> np.ndarray:
    """A stable ``argsort`` of non-negative integers, by radix where they are small."""
    return np.argsort(a.astype(np.uint16) if int(a.max(initial=0)) < 1 << 16 else a, kind="stable")


def smoothed(n: list[int], k: int) -> list[float]:
    """Simple Good-Turing's counts of counts for r from 1 to k + 1: a line through (log r, log n[r]), weighted by n[r].

    The slope is held at -1.01 or steeper, so that every r* = (r + 1) n[r + 1] / n[r]
    stays below r; where only one count occurs it is -2.
    """
    at = np.array([r for r in range(1, k + 2) if n[r] > 0], float)
    if not len(at):
        return [0.0] * (k + 2)
    x, y, w = np.log(at), np.log([n[int(r)] for r in at]), np.array([n[int(r)] for r in at], float)
    mx, my = (w * x).sum() / w.sum(), (w * y).sum() / w.sum()
    slope = (w * (x - mx) * (y - my)).sum() / (w * (x - mx) ** 2).sum() if len(at) > 1 else -2.0
    slope = min(slope, -1.01)
    return [0.0, *(float(np.exp(my + slope * (np.log(r) - mx))) for r in range(1, k + 2))]


class Discounts:
    """Katz's Good-Turing ratios d(1..k).

    They are taken from the counts of counts themselves where all lie between 0 and
    1, else from counts of counts smoothed by Simple Good-Turing's line, for which
    they always do: groups of copies make the raw ones uneven. ``method`` says which.
    """

    def __init__(self, n: list[int], k: int):
        """``n[r]`` is the number of types seen r times, for r up to k + 1."""
        self.k = k
        ratios = self.ratios(n, k)
        self.method = "good-turing"
        if not all(0.0 < d < 1.0 for d in ratios):
            self.method = "simple good-turing"
            ratios = self.ratios(smoothed(n, k), k) if any(n[1 : k + 2]) else [0.5] * k
        self.table = np.array([1.0, *ratios])

    @staticmethod
    def ratios(n: list[float], k: int) -> list[float]:
        cut = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
        star = [(r + 1) * n[r + 1] / n[r] if n[r] else 0.0 for r in range(1, k + 1)]
        return [(s / r - cut) / (1 - cut) if cut < 1 else 0.0 for r, s in enumerate(star, 1)]

    def kept(self, c: np.ndarray) -> np.ndarray:
        """The discounted counts."""
        c = c.astype(np.float64)
        small = np.minimum(c, self.k).astype(np.int64)
        return np.where(c <= self.k, self.table[small] * c, c)


class Unigrams:
    def __init__(self, n: list[int], total: int, types: int, k: int):
        self.total, self.types = total, types
        self.discounts = Discounts(n, k)
        free = sum(n[r] * r * (1.0 - self.discounts.table[r]) for r in range(1, k + 1))
        # where nothing is freed, one more observation stands for the unknown
        self.size = float(total) if free > 0 else float(total + 1)
        self.unknown = (free if free > 0 else 1.0) / self.size

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.discounts.kept(c) / self.size, self.unknown)


def freed(few: np.ndarray, d: Discounts) -> np.ndarray:
    """What the discounts take from contexts in which ``few[:, r - 1]`` words were seen r times; one observation where that is nothing."""
    free = np.zeros(len(few))
    for r in range(1, d.k + 1):
        free += few[:, r - 1] * r * (1.0 - d.table[r])
    return np.where(free > 0, free, 1.0)


def _numbers() -> defaultdict:
    """Words to numbers, given out as they come; an empty word stands for the end mark."""
    return defaultdict(counter(END + 1).__next__, {b"": END})


#: The end mark is word 0 of each batch; so many of it are the context of a text's first word.
END = 0


def _hashes(words) -> np.ndarray:
    from xxhash import xxh64_intdigest

    out = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    out[END] = xxh64_intdigest(b"end", 1)
    return out


def _batches(params: KatzParams):
    """Tokenises whole texts: words between ASCII white space with A-Z lower-cased, then the end mark."""
    names = ["batch", "words", "seen", "tokens", "lengths", "ids", "no_id", "held"]

    def work(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        made = 0

        def close():
            lengths = np.array([len(t) for t in texts])
            tokens = np.concatenate(texts)
            learned = tokens[np.repeat(~np.array(held), lengths)]
            seen = np.bincount(learned, minlength=len(words))
            # frequent words get small numbers
            order = np.concatenate([[END], 1 + np.argsort(-np.bincount(tokens, minlength=len(words))[1:], kind="stable")])
            new = np.empty(len(words), np.int64)
            new[order] = np.arange(len(words))
            row = [first + made, pack(_hashes(words)[order]), pack(seen[order]), pack(new[tokens]), pack(lengths), np.array(ids, np.int64).tobytes(), bytes(empty), bytes(held)]
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:])], names=names)

        words, texts, ids, empty, held, size = _numbers(), [], [], [], [], 0
        for frame in frames:
            for i, h, t in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), frame.column(2)):
                text = t.as_buffer().to_pybytes() if t.is_valid else b""
                texts.append(np.array([*map(words.__getitem__, text.lower().split()), END], np.int64))
                ids.append(i or 0)
                empty.append(i is None)
                held.append(bool(h))
                size += len(texts[-1])
                if size >= params.batch_tokens:
                    yield close()
                    made += 1
                    words, texts, ids, empty, held, size = _numbers(), [], [], [], [], 0
        if texts:
            yield close()
        del words, texts
        give_back()

    return work


def _by_part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (hashes % np.uint64(parts)).astype(np.int64)


def _counts_of(c: np.ndarray, k: int) -> np.ndarray:
    return np.bincount(np.minimum(c[c > 0], k + 2).astype(np.int64), minlength=k + 3)[: k + 2]


def _groups(by: np.ndarray, order: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Values of ``by`` along ``order``, which sorts it, and the stretch of each."""
    if not len(order):
        return []
    cuts = np.flatnonzero(np.diff(by[order])) + 1
    return [(int(by[g[0]]), g) for g in np.split(order, cuts)]


class Grams:
    """The distinct n-grams of one order in a batch, and what is known of them.

    ``context[g]`` numbers the context, which is an n-gram of the order below, or
    the one past the last for that of a text's first word; ``word[g]`` is the last
    word, ``low[g]`` the n-gram without its first word, ``at`` the n-gram of each
    token. ``columns`` are the context's words by their numbers in the corpus.
    """

    def __init__(self, tokens: np.ndarray, starts: np.ndarray, below_at: np.ndarray, below_n: int, below_columns: np.ndarray, n_words: int, held_tokens: np.ndarray):
        before = np.empty(len(tokens), np.int64)
        before[1:] = below_at[:-1]
        before[starts] = below_n
        keys, first, self.at = ranked(before * n_words + tokens)
        self.context, self.word, self.low = before[first], tokens[first], below_at[first]
        self.columns = below_columns
        held = np.bincount(self.at[held_tokens], minlength=len(keys))
        self.seen = np.bincount(self.at, minlength=len(keys)) - held
        self.held = held > 0
        self.n = len(keys)

    def learn(self, total: np.ndarray, asked_for: np.ndarray, low_count: np.ndarray, numbers: np.ndarray, parts: int, params: KatzParams) -> None:
        """``total``: how often each context was seen; ``asked_for``: whether a held-out text has it somewhere. Says where what is asked."""
        known = total[self.context]
        self.total, self.low_count = total, low_count
        # An n-gram whose shorter one, or whose context, was never seen has no count, and one of a
        # context seen once has that one, unless a held-out text may ask about it.
        self.alone = (known == 1) & (self.seen == 1) & ~asked_for[self.context]
        self.asks = (known > 0) & (low_count > 0) & ~self.alone
        hashes = np.zeros(len(self.columns), np.uint64)
        for column in self.columns.T:
            hashes = mixed(hashes + column.astype(np.uint64) + np.uint64(0x9E37))
        self.salts = np.maximum(1, -(-total // params.hot))
        self.own = np.flatnonzero(self.asks)
        owner = hashes[self.context[self.own]]
        hot = np.flatnonzero(self.salts[self.context[self.own]] > 1)
        grams = self.own[hot]
        owner[hot] += mixed(numbers[self.word[grams]].astype(np.uint64)) % self.salts[self.context[grams]].astype(np.uint64)
        self.owner = _by_part(owner, parts)
        # Contexts in which something wasn't seen, for all the batch knows, are asked for by themselves.
        open_ = np.zeros(len(total), bool)
        open_[self.context[(known > 0) & (low_count == 0)]] = True
        self.open = open_
        self.alone_contexts = np.flatnonzero(open_)
        self.context_owner = _by_part(hashes[self.alone_contexts], parts)

    def cells(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(partition, contexts in ascending order of their columns, their n-grams in that order) for each partition asked."""
        by_part = {part: self.own[g] for part, g in _groups(self.owner, steady(self.owner))}
        contexts_by = {part: self.alone_contexts[g] for part, g in _groups(self.context_owner, steady(self.context_owner))}
        place = np.empty(len(self.total), np.int64)
        out = []
        for part in sorted(set(by_part) | set(contexts_by)):
            grams = by_part.get(part, np.zeros(0, np.int64))
            contexts = self.context[grams]  # which ascend as n-grams do
            contexts = contexts[np.diff(contexts, prepend=-1) > 0]
            if part in contexts_by:
                contexts = np.union1d(contexts, contexts_by[part])
            contexts = contexts[_by_last(self.columns[contexts])]
            place[contexts] = np.arange(len(contexts))
            out.append((part, contexts, grams[steady(place[self.context[grams]])]))
        return out

    def answered(self, answers: pd.DataFrame, hot: pd.DataFrame, k: int) -> None:
        """Takes the partitions' answers: ``count``, ``elsewhere`` (a held-out text has it) of n-grams, ``extra``, ``few``, ``lower`` of contexts."""
        self.count = np.where(self.alone, 1, 0)
        self.elsewhere = self.held.copy()
        self.extra = np.zeros(len(self.total), bool)
        self.few, self.lower = np.zeros((len(self.total), k), np.int64), np.zeros(len(self.total))
        said = {r.part: r for r in answers.itertuples()}
        for part, contexts, grams in self.cells():
            r = said[part]
            both = unpack(r.a)
            self.count[grams] = both >> 1
            self.elsewhere[grams] |= (both & 1) > 0
            self.extra[contexts] |= unpack(r.b) > 0
            need = contexts[unpack(r.c) > 0]
            self.few[need] = unpack(r.d).reshape(k, -1).T
            self.lower[need] = np.frombuffer(r.e)
        if len(hot):
            place = {row.tobytes(): n for n, row in enumerate(self.columns) if self.salts[n] > 1}
            for r in hot.itertuples():
                n = place[bytes(r.key)]
                self.few[n], self.lower[n] = r.few, r.lower
                self.extra[n] = not any(r.few)

    def size(self) -> np.ndarray:
        """Observations that a context's probabilities are shares of: one more where the discounts free nothing."""
        return self.total + self.extra

    def probability(self, lower: np.ndarray, d: Discounts) -> np.ndarray:
        """Of each n-gram, from that of the shorter one."""
        size = np.maximum(self.size(), 1).astype(float)
        weight = freed(self.few, d) / size / np.maximum(1.0 - self.lower, 1e-300)
        c = self.context
        return np.where(self.count > 0, d.kept(self.count) / size[c], np.where(self.total[c] > 0, weight[c], 1.0) * lower)


class Batch:
    """A batch with what it has been told so far."""

    def __init__(self, row, said: pd.DataFrame, parts: int, params: KatzParams):
        self.row, self.parts, self.params = row, parts, params
        self.tokens, self.lengths = unpack(row["tokens"]), unpack(row["lengths"]).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.held = np.repeat(np.frombuffer(row["held"], np.uint8) != 0, self.lengths)
        owners = unpack(row["owners"])
        n = len(owners)
        self.numbers, self.count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        words = said[said["kind"] == "word"]
        places = dict(_groups(owners, steady(owners)))
        for r in words.itertuples():
            self.numbers[places[r.part]], self.count[places[r.part]] = unpack(r.a), unpack(r.b)
        self.orders: list[Grams] = []
        self.said = said

    def next_order(self) -> Grams:
        """The n-grams of one order more; those of the order below must have been answered."""
        n_words, n = len(self.count), len(self.orders) + 2
        docs = np.array([self.count[END]])  # how often a text was begun
        if n == 2:
            at, size, columns, count, total, elsewhere = self.tokens, n_words, self.numbers[:, None], self.count, self.count, np.ones(n_words, bool)
        else:
            g = self.orders[-1]
            at, size, columns, count, total, elsewhere = g.at, g.n, np.column_stack([g.columns[g.context], self.numbers[g.word]]), g.count, g.count, g.elsewhere
        columns = np.vstack([columns, np.full((1, n - 1), self.numbers[END])])
        grams = Grams(self.tokens, self.starts, at, size, columns, n_words, self.held)
        # Nothing follows an end mark: as a context it is the one before a text.
        grams.learn(np.append(total, docs), np.append(elsewhere, True), count[grams.low], self.numbers, self.parts, self.params)
        self.orders.append(grams)
        return grams

    def take(self) -> Grams:
        """``next_order`` with its answers."""
        grams = self.next_order()
        own = self.said[self.said["order"] == len(self.orders) + 1]
        grams.answered(own[own["kind"] == "answer"], own[own["kind"] == "hot"], self.params.cutoff)
        return grams


_SAID = "order int, part int, batch long, kind string, a binary, b binary, c binary, d binary, e binary, key binary, few array<long>, lower double, stats array<long>"
_NAMES = [x.split()[0] for x in _SAID.split(", ")]


def _said(**values) -> dict:
    return dict.fromkeys(_NAMES) | values


def score_documents(docs: DataFrame, held_out: Column, params: KatzParams = KatzParams(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Trains on the rows where ``held_out`` is not true and scores all rows.

    Returns ``key, held_out, n_tokens, n_known, train_tokens, base_score, score``,
    one row for each row of ``docs``; ``key`` is cast to long and may be null or
    repeat. A null or empty text is its end mark alone. ``base_score`` is the
    unigram model with 0.1 added to each count, ``score`` the Katz model, both as
    log10. Without training rows every word is unknown, and both are defined. An
    empty table gives an empty result; other columns don't come out.

    The scratch tables ``katz-2``, ``katz-3`` and so on hold the model: rows of
    ``kind = 'model'`` have up to ``block`` n-grams of one partition each.
    """
    spark = docs.sparkSession
    k = params.cutoff
    given = docs.select(docs[key].cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), docs[text].cast("string").alias("text"))
    blob = lambda names: ", ".join(f"{n} binary" for n in names.split())
    batches = stored(given.mapInArrow(_batches(params), "batch long, " + blob("words seen tokens lengths ids no_id held")), "katz-batches")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), batches.count())

    # --- words
    def ask_words(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for batch, words, seen in zip(*(c.to_pylist() for c in frame.columns)):
                hashes, c = unpack(words).astype(np.uint64), unpack(seen)
                of = _by_part(hashes, parts)
                own = _groups(of, steady(of))
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in own], pa.int32()), pa.array([batch] * len(own), pa.int64()), pa.array([pack(hashes[g]) for _, g in own], pa.binary()), pa.array([pack(c[g]) for _, g in own], pa.binary())], names=["part", "batch", "words", "seen"])

    def count_words(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        asked = [unpack(x).astype(np.uint64) for x in frame["words"]]
        distinct, _, at = ranked(np.concatenate(asked))
        total = np.bincount(at, weights=np.concatenate([unpack(x) for x in frame["seen"]]), minlength=len(distinct)).astype(np.int64)
        number = np.empty(len(distinct), np.int64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(distinct))
        number = number * parts + part
        ends = np.cumsum([len(a) for a in asked])[:-1]
        out = [_said(order=1, part=part, batch=b, kind="word", a=pack(x), b=pack(y)) for b, x, y in zip(frame["batch"], np.split(number[at], ends), np.split(total[at], ends))]
        out.append(_said(order=1, part=part, batch=-1, kind="stats", stats=[int(total.sum()), int((total > 0).sum()), *_counts_of(total, k).tolist()]))
        return pd.DataFrame(out, columns=_NAMES)

    asked = batches.select("batch", "words", "seen").mapInArrow(ask_words, "part int, batch long, words binary, seen binary")
    words = stored(asked.groupBy("part").applyInPandas(count_words, _SAID), "katz-1", ["kind"])

    def summed_stats(table: DataFrame, length: int) -> list[int]:
        """One row of counts of counts for all partitions."""
        got = table.filter("kind = 'stats'").select(F.posexplode("stats").alias("r", "n")).groupBy("r").agg(F.sum("n").alias("n")).collect()
        return [next((x["n"] for x in got if x["r"] == r), 0) for r in range(length)]

    # From here on a batch needs its words' partitions only, which are an eighth of their hashes.
    def owned(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            owners = pa.array([pack(_by_part(unpack(x.as_py()).astype(np.uint64), parts)) for x in frame.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([frame.column(0), owners, *frame.columns[2:]], names=["batch", "owners", *frame.schema.names[2:]])

    rest = "tokens lengths ids no_id held"
    whole, batches = batches, stored(batches.select("batch", "words", *rest.split()).mapInArrow(owned, "batch long, " + blob("owners " + rest)), "katz-batches")
    drop_stored(whole)

    sums = summed_stats(words, k + 4)
    total, types = sums[0], sums[1]
    unigrams = Unigrams(sums[2:], total, types, k)
    discounts: list[Discounts] = []
    said = words.filter("kind = 'word'").select(*_NAMES)
    tables = [words]

    # --- n-grams, order by order
    def exchange(order: int, said: DataFrame) -> DataFrame:
        known = list(discounts)

        def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            batch = Batch(left.iloc[0], right, parts, params)
            for _ in range(2, order):
                batch.take()
            below = batch.orders[-1] if batch.orders else None
            g = batch.next_order()
            seen_once = np.bincount(np.minimum(g.seen[g.alone], 1), minlength=k + 2)[: k + 2]
            out = [(-1 - order, 0, b"", b"", b"", b"", b"", b"", b"", b"", b"", seen_once.tolist())]
            number = int(left["batch"].iloc[0])
            for part, contexts, grams in g.cells():
                runs = np.bincount(_places(contexts, g.context[grams], len(g.total)), minlength=len(contexts))
                columns = [pack_sorted(g.columns[contexts, -1]), *(pack(c) for c in g.columns[contexts, :-1].T)]
                sizes = below.size()[below.context[_shorter(g, below, contexts)]] if below is not None else np.zeros(0, np.int64)
                out.append((part, number, _joined(columns), pack(runs), pack(batch.numbers[g.word[grams]]), pack(g.low_count[grams]), pack(g.seen[grams]), pack(g.held[grams]), pack(sizes), pack(g.salts[contexts]), pack(g.open[contexts]), None))
            give_back()
            return pd.DataFrame(out, columns=["part", "batch", "contexts", "runs", "words", "low", "seen", "held", "sizes", "salts", "open", "stats"])

        def count(frame: pd.DataFrame) -> pd.DataFrame:
            part = int(frame["part"].iloc[0])
            if part < 0:  # what batches knew by themselves
                return pd.DataFrame([_said(order=order, part=part, batch=-1, kind="stats", stats=np.sum([*frame["stats"]], axis=0).tolist())], columns=_NAMES)
            cells = [[unpack(y) for y in x] for x in zip(*(frame[c] for c in ("runs", "words", "low", "seen", "held", "sizes", "salts", "open")))]
            columns = [_split(x) for x in frame["contexts"]]
            matrix = np.concatenate([np.column_stack([*(unpack(c).astype(np.int64) for c in x[1:]), unpack_sorted(x[0])]) for x in columns])
            contexts, h = _distinct(matrix)
            runs, word, low, seen, held, sizes, salts, open_ = (np.concatenate([c[i] for c in cells]).astype(np.int64) for i in range(8))
            h_of = np.repeat(h, runs)
            words, _, w = ranked(word)
            keys, _, at = ranked(h_of * len(words) + w)
            c = np.bincount(at, weights=seen, minlength=len(keys)).astype(np.int64)
            elsewhere = np.bincount(at, weights=held, minlength=len(keys)) > 0
            context, n = keys // max(len(words), 1), len(contexts)
            low_of = np.zeros(len(keys), np.int64)
            low_of[at] = low
            size_of = np.zeros(n, np.int64)
            salts_of = np.ones(n, np.int64)
            salts_of[h] = salts
            if order > 2:
                size_of[h] = sizes
                p = known[-1].kept(low_of) / np.maximum(size_of[context], 1)
            else:
                p = unigrams(low_of)
            few = np.stack([np.bincount(context[c == r], minlength=n) for r in range(1, k + 1)], axis=1)
            lower = np.bincount(context, weights=np.where(c > 0, p, 0.0), minlength=n)
            extra = few.sum(axis=1) == 0
            hot = salts_of > 1
            out, done, done_h = [], 0, 0
            for batch, cell in zip(frame["batch"], cells):
                m, j = len(cell[0]), len(cell[1])
                own, grams = h[done_h : done_h + m], at[done : done + j]
                # Backoff weights are sent where something asked for wasn't seen.
                unseen = np.bincount(np.repeat(np.arange(m), cell[0].astype(np.int64)), weights=c[grams] == 0, minlength=m) > 0
                need = (unseen | (cell[7] > 0)) & ~hot[own]
                out.append(_said(order=order, part=part, batch=int(batch), kind="answer", a=pack((c[grams] << 1) | elsewhere[grams]), b=pack(extra[own] & ~hot[own]), c=pack(need), d=pack(few[own[need]].T.ravel()), e=lower[own[need]].tobytes()))
                out += [_said(order=order, part=part, batch=int(batch), kind="asks", key=contexts[x].tobytes()) for x in np.unique(own[hot[own]])]
                done, done_h = done + j, done_h + m
            out += [_said(order=order, part=part, batch=-1, kind="sums", key=contexts[x].tobytes(), few=few[x].tolist(), lower=float(lower[x])) for x in np.flatnonzero(hot)]
            out.append(_said(order=order, part=part, batch=-1, kind="stats", stats=_counts_of(c, k).tolist()))
            del cells, columns, matrix, at, word
            known_grams = np.flatnonzero(c > 0)
            for a in range(0, len(known_grams), params.block):
                g = known_grams[a : a + params.block]
                ctx, run = np.unique(context[g], return_counts=True)
                out.append(_said(order=order, part=part, batch=a // params.block, kind="model", a=_joined([pack(x) for x in contexts[ctx].T]), b=pack(run), c=pack(words[keys[g] % len(words)]), d=pack(c[g]), e=lower[ctx[run > 1]].tobytes()))
            return pd.DataFrame(out, columns=_NAMES)

        asks = batches.drop("ids", "no_id").groupBy("batch").cogroup(said.groupBy("batch")).applyInPandas(ask, "part int, batch long, " + blob("contexts runs words low seen held sizes salts open") + ", stats array<long>")
        # Batches' own counts go to as many groups as there are partitions.
        asks = asks.withColumn("part", F.when(F.col("part") < 0, -1 - F.pmod(F.xxhash64("batch", F.monotonically_increasing_id()), F.lit(parts)).cast("int")).otherwise(F.col("part")))
        return stored(asks.groupBy("part").applyInPandas(count, _SAID), f"katz-{order}", ["kind"])

    for order in range(2, params.order + 1):
        table = exchange(order, said)
        tables.append(table)
        discounts.append(Discounts(summed_stats(table, k + 2), k))
        # Frequent contexts' sums over the partitions that share them, for the batches that asked.
        sums_of = table.filter("kind = 'sums'").groupBy("key").agg(F.array(*[F.sum(F.col("few")[r]) for r in range(k)]).alias("few"), F.sum("lower").alias("lower"))
        hot = table.filter("kind = 'asks'").select("order", "batch", "key").distinct().join(sums_of, "key")
        none = lambda t: F.lit(None).cast(t)
        hot = hot.select("order", F.lit(-1).alias("part"), "batch", F.lit("hot").alias("kind"), *[none("binary").alias(x) for x in "abcde"], "key", "few", "lower", none("array<long>").alias("stats"))
        said = said.union(table.filter("kind = 'answer'").select(*_NAMES)).union(hot)

    # --- scores
    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        batch = Batch(row, right, parts, params)
        p, at = unigrams(batch.count), batch.tokens
        for d in discounts:
            g = batch.take()
            p, at = g.probability(p[g.low], d), g.at
        base = np.log10((batch.count + 0.1) / (total + 0.1 * (types + 1)))
        add = lambda x: np.add.reduceat(x, batch.starts)
        ids = pd.array(np.frombuffer(row["ids"], np.int64), dtype="Int64")
        ids[np.frombuffer(row["no_id"], np.uint8) != 0] = pd.NA
        return pd.DataFrame({key: ids, "held_out": np.frombuffer(row["held"], np.uint8) != 0, "n_tokens": batch.lengths, "n_known": add((batch.count[batch.tokens] > 0).astype(np.int64)), "train_tokens": total, "base_score": add(base[batch.tokens]), "score": add(np.log10(p)[at])})

    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("held_out", T.BooleanType()), *(T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return batches.groupBy("batch").cogroup(said.groupBy("batch")).applyInPandas(score, schema)


def _joined(blobs: list[bytes]) -> bytes:
    """Several packed columns in one value."""
    return b"".join(len(b).to_bytes(8, "little") + b for b in blobs)


def _split(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _places(contexts: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    place = np.empty(n, np.int64)
    place[contexts] = np.arange(len(contexts))
    return place[of]


def _shorter(g: Grams, below: Grams, contexts: np.ndarray) -> np.ndarray:
    """An n-gram below that has the context without its first word as its own context, for each of ``contexts``."""
    any_gram = np.zeros(len(g.total), np.int64)
    any_gram[g.context] = g.low
    return any_gram[contexts]


def _by_last(columns: np.ndarray) -> np.ndarray:
    """The order of distinct rows by their last column first, then the one before."""
    if len(columns) and columns.shape[1] <= 2:
        size = int(columns[:, 0].max()) + 1
        if columns.shape[1] == 1:
            return np.argsort(columns[:, 0])
        if (int(columns[:, 1].max()) + 1) * size < 1 << 63:
            return np.argsort(columns[:, 1] * size + columns[:, 0])
    return np.lexsort(columns.T)


def _distinct(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, number of each row's)."""
    if matrix.shape[1] == 1:
        values, _, at = ranked(matrix[:, 0])
        return values[:, None], at
    # Rows by their columns' ranks, two columns at a time: ranks stay small.
    code = np.zeros(len(matrix), np.int64)
    for column in matrix.T:
        values, _, rank = ranked(column)
        _, first, code = ranked(code * len(values) + rank)
    return matrix[first], code
