"""Operator 6, toxicity by nearest labelled examples.

A bounded sample of labelled rows becomes TF-IDF vectors over all their words. A
block-max inverted index finds each document's nearest examples by exact cosine;
they vote with their cosines as weights, and votes become probabilities by
isotonic calibration on leave-one-out votes of the examples themselves.

Document frequencies are those of all documents. Words that stand out in the toxic
examples weigh more, by their log-likelihood ratio: without that, what two texts
have in common is their language. No word is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stored, give_back, stored, unpickled
from .frequencies import UNIT, Idf, summed
from .words import Shingler, chunks, pack_ids, unpack_ids

BLOCK = 64


@dataclass(frozen=True)
class ToxicityParams:
    #: The bound of the labelled sample: so many rows of each class at most, by a hash of doc_id.
    examples_per_class: int = 1024
    #: Toxic examples that a word must stand in to weigh more than its inverse document frequency.
    least_support: int = 3
    #: Power of the log-likelihood ratio in a word's weight.
    relevance: float = 0.75
    #: Counters in each row of the document-frequency sketch; rarer words than one in two to the power of ``rare_bits`` weigh alike.
    df_bits: int = 19
    rare_bits: int = 15
    neighbours: int = 15
    #: Weight of the base rate against the neighbours' cosines.
    prior_weight: float = 0.05
    threshold: float = 0.7


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted pool-adjacent-violators with one pseudo-observation of the mean in each pool: (mean x, value) of each, to be interpolated."""
    mean = float((y * w).sum() / w.sum())
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # weighted sums of y and x, weight, greatest x
    for k in order:
        if pools and pools[-1][3] == x[k]:
            pools[-1][:3] = [pools[-1][0] + y[k] * w[k], pools[-1][1] + x[k] * w[k], pools[-1][2] + w[k]]
        else:
            pools.append([float(y[k] * w[k]), float(x[k] * w[k]), float(w[k]), float(x[k])])
        while len(pools) > 1 and pools[-2][0] * pools[-1][2] >= pools[-1][0] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [*(a + b for a, b in zip(pools[-1][:3], last[:3])), last[3]]
    unit = float(np.min(w))
    xs = np.array([p[1] / p[2] for p in pools])
    vs = np.array([(p[0] + mean * unit) / (p[2] + unit) for p in pools])
    return xs, np.maximum.accumulate(vs)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all runs, one after another."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


class BlockMaxIndex:
    """Postings of examples cut into blocks of ``BLOCK``; each block of a term keeps its largest weight.

    ``vectors`` are pairs of term numbers in ascending order and their weights.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]]):
        # Examples with the same heaviest term stand together, so that few blocks hold what a query needs.
        heaviest = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in vectors]
        self.order = np.array(sorted(range(len(vectors)), key=lambda i: (heaviest[i], i)), np.int64)
        self.blocks = max(1, -(-len(vectors) // BLOCK))
        none = np.zeros(0, np.uint64)
        terms = np.concatenate([vectors[i][0] for i in self.order] or [none])
        weights = np.concatenate([vectors[i][1] for i in self.order] or [np.zeros(0)])
        place = np.repeat(np.arange(len(vectors)), [len(vectors[i][0]) for i in self.order])
        by = np.lexsort((place, terms))
        self.place, self.weight = place[by].astype(np.int32), weights[by]
        # A cell is a term in a block.
        cell = np.flatnonzero((np.diff(terms[by], prepend=terms[by][:1] + np.uint64(1)) != 0) | (np.diff(self.place // BLOCK, prepend=-1) != 0)) if len(by) else np.zeros(0, np.int64)
        self.cell_start = np.append(cell, len(by))
        self.cell_block = (self.place[cell] // BLOCK).astype(np.int32)
        self.cell_max = np.maximum.reduceat(self.weight, cell) if len(cell) else np.zeros(0)
        cell_term = terms[by][cell]
        first = np.flatnonzero(np.diff(cell_term, prepend=cell_term[:1] + np.uint64(1))) if len(cell) else np.zeros(0, np.int64)
        self.terms, self.term_start = cell_term[first], np.append(first, len(cell))

    def nearest(self, query: tuple[np.ndarray, np.ndarray], k: int, without: int = -1) -> list[tuple[int, float]]:
        """The ``k`` examples of highest positive cosine, ties to the smaller number; exact."""
        ids, weights = query
        if not len(ids) or not len(self.terms):
            return []
        at = np.minimum(np.searchsorted(self.terms, ids), len(self.terms) - 1)
        hit = (self.terms[at] == ids) & (weights > 0)
        at, weights = at[hit], weights[hit]
        n = self.term_start[at + 1] - self.term_start[at]
        cells, share = spread(self.term_start[at], n), np.repeat(weights, n)
        block = self.cell_block[cells]
        bound = np.bincount(block, self.cell_max[cells] * share, self.blocks) * (1 + 1e-9)
        scores = np.zeros(self.blocks * BLOCK)
        order = np.argsort(-bound, kind="stable")
        done, todo, least = np.zeros(self.blocks, bool), order[: max(2, self.blocks // 8)], 0.0
        while len(todo):
            chosen = np.zeros(self.blocks, bool)
            chosen[todo] = True
            own = chosen[block]
            start = self.cell_start[cells[own]]
            length = self.cell_start[cells[own] + 1] - start
            posts = spread(start, length)
            scores += np.bincount(self.place[posts], self.weight[posts] * np.repeat(share[own], length), len(scores))
            done |= chosen
            if without >= 0:
                scores[self.where[without]] = 0.0
            least = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else 0.0
            # The next quarter of the blocks that may still hold one of the nearest; then the bound is looked at again.
            open_ = order[~done[order]]
            open_ = open_[(bound[open_] >= least) & (bound[open_] > 0)]
            todo = open_[: max(2, self.blocks // 4)]
        good = np.flatnonzero((scores > 0) & (scores >= least))
        ranked = sorted(((-float(scores[p]), int(self.order[p])) for p in good))[:k]
        return [(i, -s) for s, i in ranked]

    @property
    def where(self) -> np.ndarray:
        if not hasattr(self, "_where"):
            self._where = np.argsort(self.order)
        return self._where


class ToxicityModel:
    """What a fit leaves: word weights, examples, index and calibration, all bounded by the sample and the parameters."""

    def __init__(self, params: ToxicityParams, idf: Idf | None, examples: list[tuple[int, int, float, np.ndarray, np.ndarray]], base_rate: float):
        """``examples`` are (doc_id, label, weight, words, counts)."""
        self.params, self.idf, self.base_rate = params, idf, base_rate
        self.ids = [e[0] for e in examples]
        self.labels = np.array([e[1] for e in examples], dtype=float)
        self.weights = np.array([e[2] for e in examples])
        self._weigh(examples)
        vectors = [self.vector(e[3], e[4]) for e in examples]
        self.index = BlockMaxIndex(vectors)
        self.steps = (np.array([0.0]), np.array([base_rate]))
        if examples:
            raw = np.array([self.vote(self.index.nearest(v, params.neighbours, without=i)) for i, v in enumerate(vectors)])
            self.steps = isotonic(raw, self.labels, self.weights)

    def _weigh(self, examples: list) -> None:
        """Words that stand out in toxic examples, with their factors."""
        toxic, clean = [e[3] for e in examples if e[1]], [e[3] for e in examples if not e[1]]
        none = [np.zeros(0, np.uint64)]
        self.marked, self.factor = none[0], np.zeros(0)
        if not toxic or not clean:
            return
        words, a = np.unique(np.concatenate(toxic + none), return_counts=True)
        other, n = np.unique(np.concatenate(clean + none), return_counts=True)
        b = np.zeros(len(words))
        if len(other):
            at = np.minimum(np.searchsorted(other, words), len(other) - 1)
            b = np.where(other[at] == words, n[at], 0)
        ratio = a * np.log((a + 0.5) / len(toxic) / ((b + 0.5) / len(clean)))
        kept = (a >= self.params.least_support) & (ratio > 0)
        self.marked, self.factor = words[kept], 1.0 + ratio[kept] ** self.params.relevance

    def vector(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words with their weights, of length one."""
        if not len(words) or self.idf is None:
            return words, np.zeros(len(words))
        w = (1.0 + np.log(counts)) * np.maximum(0.0, self.idf(words) - np.log(2.0))
        if len(self.marked):
            at = np.minimum(np.searchsorted(self.marked, words), len(self.marked) - 1)
            w = np.where(self.marked[at] == words, w * self.factor[at], w)
        norm = np.sqrt((w * w).sum())
        return words, w / norm if norm else w

    def vote(self, near: list[tuple[int, float]]) -> float:
        """Distance-weighted share of toxic neighbours, drawn to the base rate when there are few or far ones."""
        if not near:
            return self.base_rate
        i = [k for k, _ in near]
        w = np.array([c for _, c in near]) * self.weights[i] / self.weights.min()
        return float(((w * self.labels[i]).sum() + self.params.prior_weight * self.base_rate) / (w.sum() + self.params.prior_weight))

    def score(self, words: np.ndarray, counts: np.ndarray) -> tuple[float, list[tuple[int, float]]]:
        """(probability, nearest examples as (doc_id, cosine)) of a text's words."""
        near = self.index.nearest(self.vector(words, counts), self.params.neighbours)
        p = float(np.interp(self.vote(near), *self.steps))
        return min(1.0, max(0.0, p)), [(self.ids[i], c) for i, c in near[:3]]


def fit_toxicity(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams(), key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Learns from a sample of labelled rows, ``examples_per_class`` of each class at most, chosen by a hash of the key.

    Rows with a null key or label take no part; a document labelled twice counts as
    toxic if either row says so. Document frequencies are counted over all of
    ``docs``. What reaches the driver are the sample's words and a table of fixed
    size. Examples of the same text count once for each label, so that one
    much-copied text doesn't pass for evidence.
    """
    named = labels.select(labels[key].alias("id"), labels[label].alias("y")).dropna().groupBy("id").agg(F.max("y").cast("int").alias("y"))
    totals = {r["y"]: r["count"] for r in named.groupBy("y").count().collect()}
    picked = None
    for y in (0, 1):
        part = named.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(params.examples_per_class)
        picked = part if picked is None else picked.union(part)
    # At most twice examples_per_class ids.
    chosen = stored(picked, "toxicity-sample")
    sample = docs.select(docs[key].alias("id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t")).join(F.broadcast(chosen), "id").select("id", "y", "t")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Shingler(1)
        for batch in batches:
            found = [words.one(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([pack_ids(i) for i, _ in found], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in found], pa.binary())], names=["id", "y", "words", "counts"])

    rows = {}
    for r in sample.mapInArrow(read, "id long, y int, words binary, counts binary").collect():
        at = (r["y"], bytes(r["words"]), bytes(r["counts"]))
        rows[at] = min(r["id"], rows.get(at, r["id"]))
    drop_stored(chosen)
    seen = {y: sum(k[0] == y for k in rows) for y in (0, 1)}
    if not seen[0] or not seen[1]:
        return ToxicityModel(params, None, [], float(bool(seen[1])))
    bits = params.df_bits

    def count(texts: list[str], table: np.ndarray) -> int:
        ids, _, _, _ = Shingler(1).sets(texts)
        for row, at in enumerate(Idf.counters(ids, bits)):
            table += np.bincount(at + (row << bits), minlength=len(table)) * UNIT
        return len(texts) * UNIT

    idf = Idf(bits, params.rare_bits, *summed(docs, text, 2 << bits, count))
    weight = {y: totals[y] / seen[y] for y in (0, 1)}
    examples = sorted(((i, y, weight[y], unpack_ids(w), np.frombuffer(c, "<u4").astype(float)) for (y, w, c), i in rows.items()), key=lambda e: (e[0], e[1]))
    return ToxicityModel(params, idf, examples, totals[1] / (totals[0] + totals[1]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("toxic_score", "toxic_evidence")) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if None) with a score and its evidence, called by ``names``.

    Evidence is the three nearest examples as ``struct<doc_id, cosine>``. The score
    depends on the text alone; null and empty texts get that of a document without
    evidence. One row for each row in; columns already called so are replaced. No
    shuffle: the model, bounded by its parameters, is broadcast.
    """
    spark = docs.sparkSession
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    given = docs.select(*[docs[c] for c in kept], docs[text].cast("string").alias("__text"))
    near = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType())]))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField(names[0], T.DoubleType()), T.StructField(names[1], near)])
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))
    shipped = spark.sparkContext.broadcast(cloudpickle.dumps(model))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: ToxicityModel = unpickled(shipped)
        words = Shingler(1)
        empty = np.zeros(0, np.uint64), np.zeros(0)
        for batch in batches:
            found = []
            for texts in chunks([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]):
                ids, counts, starts, of = words.sets(texts)
                part: list = [empty] * len(texts)
                for i, a, b in zip(of.tolist(), starts.tolist(), [*starts[1:].tolist(), len(ids)]):
                    part[i] = ids[a:b], counts[a:b]
                found += [own.score(*p) for p in part]
            scores = pa.array([p for p, _ in found], pa.float64())
            evidence = pa.array([[{"doc_id": i, "cosine": c} for i, c in e] for _, e in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores, evidence], names=[f.name for f in schema.fields])
        del own
        give_back()

    return given.mapInArrow(work, schema)
