"""Operator 3, exact top-k search over a pivot-distance index.

Every vector is keyed by its nearest pivot and the distance to it, and the index
is stored in that order, so a run of rows is an annulus about a pivot. For a query
at distance d from the pivot, no vector of an annulus [low, high] is nearer than
max(0, d - high, low - d); with the annulus' largest norm this bounds its inner
products. Annuli are taken by falling bound, and a query leaves the search at the
first below its k-th best score so far, which no later one can beat: results are
exact.

The stored order is cut into groups. A query first meets its own group, which gives
it a good k-th best; then a table of groups by pivot tells which others can hold
anything better, and only those are read again, each with a run of queries that
stand near each other. Queries are rows all the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored

#: Vectors in an annulus, at most.
ANNULUS = 256
#: Scores beyond 64 bits count as the largest or smallest that fits.
MOST = 2**63 - 1


@dataclass(frozen=True)
class TopKParams:
    k: int = 5
    pivots: int = 64
    #: Rows of a group: so many at least, and at most, where there are enough for ``groups``.
    least_rows: int = 4096
    most_rows: int = 65_536
    groups: int = 64
    #: Consecutive groups whose queries go to another group together.
    run: int = 64


def finite(embedding: Column) -> Column:
    """Components as doubles; null unless there are some and all are present and finite."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when((F.size(embedding) > 0) & ~F.coalesce(bad, F.lit(True)), x)


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 * x): as float64, or as Python integers where that doesn't hold them exactly or could overflow."""
    if float(np.abs(x).max(initial=0.0)) < 2.0**45:
        return np.floor(x * 256.0)
    return np.array([[int(np.floor(v * 256.0)) if abs(v) < 2.0**45 else int(v) * 256 for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def exact_in_floats(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether float64 holds all inner products of rows of ``a`` and ``b``, and their partial sums, exactly."""
    if a.dtype == object or b.dtype == object:
        return False
    return float(np.abs(a).max(initial=0.0)) * float(np.abs(b).max(initial=0.0)) * a.shape[1] < 2.0**53


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of ``a`` with rows of ``b`` as exact integers, held within 64 bits; decided by both sides' magnitudes."""
    if exact_in_floats(a, b):
        return a @ b.T
    big = lambda m: m if m.dtype == object else np.array([[int(v) for v in row] for row in m.tolist()], dtype=object).reshape(m.shape)
    return np.array([[max(-MOST - 1, min(MOST, v)) for v in row] for row in big(a).dot(big(b).T).tolist()], dtype=object).reshape(len(a), len(b))


def as_floats(m: np.ndarray) -> np.ndarray:
    """For bounds: magnitudes are held where their squares can still be added up."""
    with np.errstate(over="ignore"):
        return np.clip(m.astype(np.float64) if m.dtype != object else np.array([[float(max(-(10**140), min(10**140, v))) for v in row] for row in m.tolist()]).reshape(m.shape), -1e140, 1e140)


def squared(f: np.ndarray) -> np.ndarray:
    return (f * f).sum(axis=1)


def distances(f: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(squared(f)[:, None] + squared(pivots)[None, :] - 2 * f @ pivots.T, 0.0))


def slack(norms: np.ndarray) -> np.ndarray:
    """What rounding can take off a bound, for squared norms of this size."""
    return 1.0 + 1e-9 * norms


class Queries:
    """Queries of one length with their best scores so far."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, floor: list | None = None):
        self.ids, self.k, self.matrix = ids, k, matrix
        self.floats = as_floats(matrix)
        self.norms = squared(self.floats)
        self.best: list[list[tuple[int, int]]] = [[] for _ in range(len(ids))]  # (-score, vec_id), ascending
        self.floor: list[int | None] = list(floor) if floor is not None else [None] * len(ids)
        self.least = np.array([-np.inf if x is None else float(x) for x in self.floor])

    def offer(self, q: int, scores, ids) -> None:
        own, best, least = self.ids[q], self.best[q], self.floor[q]
        best += [(-int(s), int(i)) for s, i in zip(scores, ids) if i != own and (least is None or int(s) >= least)]
        best.sort()
        del best[self.k :]
        if len(best) == self.k and (least is None or -best[-1][0] > least):
            self.floor[q] = -best[-1][0]
            self.least[q] = float(self.floor[q])


def search_rows(queries: Queries, pivots: np.ndarray, ids: np.ndarray, pivot: np.ndarray, distance: np.ndarray, matrix: np.ndarray) -> int:
    """Offers index rows in (pivot, distance) order to all queries; returns how often a query met an annulus."""
    cuts = [0]
    for i in range(1, len(ids)):
        if pivot[i] != pivot[i - 1] or i - cuts[-1] >= ANNULUS:
            cuts.append(i)
    starts, ends = np.array(cuts), np.array([*cuts[1:], len(ids)])
    low, high, of = distance[starts], distance[ends - 1], pivot[starts]
    norm = np.maximum.reduceat(squared(as_floats(matrix)), starts)
    far = distances(queries.floats, pivots)[:, of]  # of each query from each annulus' pivot
    near = np.maximum(0.0, np.maximum(far - high, low - far))
    both = queries.norms[:, None] + norm[None, :]
    bound = np.minimum((both - near * near) / 2, np.sqrt(queries.norms)[:, None] * np.sqrt(norm)[None, :]) + slack(both)
    visited = 0
    for a in np.argsort(-bound.max(axis=0, initial=-np.inf), kind="stable"):
        asked = np.flatnonzero(bound[:, a] >= queries.least)
        if not len(asked):
            continue
        visited += len(asked)
        s, e = starts[a], ends[a]
        scores = products(queries.matrix[asked], matrix[s:e])
        good = scores >= queries.least[asked][:, None]
        for n in np.flatnonzero(good.any(axis=1)):
            hit = np.flatnonzero(good[n])
            queries.offer(int(asked[n]), scores[n][hit].tolist(), ids[s:e][hit].tolist())
    return visited


def flat_vectors(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all components, where each row's begin)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(), offsets - offsets[0]


def rows_of(table: pa.Table, dim: int, name: str = "v") -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix) of a table's vectors of one length."""
    at = np.flatnonzero(table.column("dim").to_numpy() == dim)
    flat, starts = flat_vectors(table.column(name))
    return at, flat[starts[at][:, None] + np.arange(dim)]


def build_index(vectors: DataFrame, is_query: Column, params: TopKParams, key: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(index ``dim, pivot, distance, id, v, q, at, grp`` stored in that order, pivots by length).

    ``q`` marks queries, ``at`` numbers the rows, ``grp`` the runs of the order.
    """
    rows = vectors.select(vectors[key].cast("long").alias("id"), finite(vectors[embedding]).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).filter("id is not null and v is not null")
    # Bounded by the parameter: pivots are the rows whose ids hash lowest.
    by_dim: dict[int, list] = {}
    for r in rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(params.pivots).collect():
        by_dim.setdefault(len(r["v"]), []).append(r["v"])
    pivots = {d: as_floats(whole(np.array(got))) for d, got in by_dim.items()}
    shipped = vectors.sparkSession.sparkContext.broadcast(cloudpickle.dumps(pivots))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cloudpickle.loads(shipped.value)
        for batch in batches:
            vs = batch.column(1)
            flat, begins = flat_vectors(vs)
            dims = np.diff(vs.offsets.to_numpy())
            pivot, far, norm = np.zeros(len(dims), np.int32), np.zeros(len(dims)), np.zeros(len(dims))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                f = as_floats(whole(flat[begins[at][:, None] + np.arange(d)]))
                norm[at] = squared(f)
                dist = distances(f, own.get(int(d), np.zeros((1, d))))
                pivot[at] = dist.argmin(axis=1)
                far[at] = dist.min(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(pivot), pa.array(far), pa.array(norm), batch.column(0), vs, batch.column(2)], names=["dim", "pivot", "distance", "norm", "id", "v", "q"])

    placed = stored(rows.mapInArrow(place, "dim int, pivot int, distance double, norm double, id long, v array<double>, q boolean").withColumn("at", F.monotonically_increasing_id()), "pivot-places")
    total = placed.count()
    groups = max(1, min(-(-total // params.least_rows), max(params.groups, -(-total // params.most_rows))))
    order = ["dim", "pivot", "distance", "id", "at"]
    index = stored(placed.repartitionByRange(groups, *order).sortWithinPartitions(*order).withColumn("grp", F.spark_partition_id()), "pivot-index")
    drop_stored(placed)
    return index, pivots


def search_topk(vectors: DataFrame, is_query: Column, params: TopKParams = TopKParams(), key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products of each query with every other row.

    Components are scaled to floor(256 * x); rows with a null id, a null or empty
    vector, or null or non-finite components take no part, neither do candidates
    of another length than the query, nor rows with the query's own id. Inner
    products are exact integers at any finite magnitude; those beyond 64 bits count
    as the largest or smallest number of 64 bits. Ties go to the smaller id. A
    query row that repeats is answered once for each repetition. An empty table, or
    no query, gives an empty result. Other columns don't come out.
    """
    spark = vectors.sparkSession
    index, pivots = build_index(vectors, is_query, params, key, embedding)
    shipped = spark.sparkContext.broadcast(cloudpickle.dumps(pivots))
    k = params.k
    best = "best array<struct<score: long, vec_id: long>>"
    best_type = pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64())]))

    def found(lists: list[list[tuple[int, int]]]) -> pa.Array:
        return pa.array([[{"score": -s, "vec_id": i} for s, i in x] for x in lists], best_type)

    # --- each query in its own group
    def inner(table: pa.Table) -> pa.Table:
        centres = cloudpickle.loads(shipped.value)
        table = table.sort_by([("pivot", "ascending"), ("distance", "ascending"), ("at", "ascending")])
        dims, flags = table.column("dim").to_numpy(), table.column("q").to_numpy(zero_copy_only=False)
        out = []
        for d in np.unique(dims).tolist():
            at, x = rows_of(table, d)
            asked = np.flatnonzero(flags[at])
            if not len(asked):
                continue
            m, ids = whole(x), table.column("id").to_numpy()[at]
            p = centres.get(d, np.zeros((1, d)))
            queries = Queries(ids[asked], m[asked], k)
            search_rows(queries, p, ids, table.column("pivot").to_numpy()[at], table.column("distance").to_numpy()[at], m)
            rows = table.select(["grp", "at", "id", "dim", "v", "norm"]).take(pa.array(at[asked]))
            far = pa.array(distances(queries.floats, p).tolist(), pa.list_(pa.float64()))
            out.append(rows.append_column("far", far).append_column("floor", pa.array(queries.floor, pa.int64())).append_column("best", found(queries.best)))
        schema = pa.schema([("grp", pa.int32()), ("at", pa.int64()), ("id", pa.int64()), ("dim", pa.int32()), ("v", pa.list_(pa.float64())), ("norm", pa.float64()), ("far", pa.list_(pa.float64())), ("floor", pa.int64()), ("best", best_type)])
        return pa.concat_tables([t.cast(schema) for t in out]) if out else schema.empty_table()

    queries = stored(index.groupBy("grp").applyInArrow(inner, f"grp int, at long, id long, dim int, v array<double>, norm double, far array<double>, floor long, {best}"), "topk-queries")

    # --- which groups can hold better ones: tables of a row for each group and pivot
    rings = index.groupBy("grp", "dim", "pivot").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.max("norm").alias("most"))
    run = F.floor(F.col("grp") / params.run).cast("int")
    views = queries.select(run.alias("run"), "dim", "norm", "floor", F.posexplode("far").alias("pivot", "d"))
    views = views.groupBy("run", "dim", "pivot").agg(F.min("d").alias("d0"), F.max("d").alias("d1"), F.max("norm").alias("norm"), F.min(F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf")))).alias("least"))
    near = F.greatest(F.lit(0.0), F.col("d0") - F.col("high"), F.col("low") - F.col("d1"))
    both = F.col("norm") + F.col("most")
    bound = F.least((both - near * near) / 2, F.sqrt("norm") * F.sqrt("most")) + 1.0 + both * 1e-9
    # A double of the lowest score may stand a rounding above it.
    enough = bound + F.abs(F.col("least")) * 1e-15 >= F.col("least")
    pairs = stored(views.join(rings, ["dim", "pivot"]).filter(enough | (F.col("least") == float("-inf"))).select("run", "grp").distinct(), "topk-pairs")

    # --- a run of queries meets a group
    def outer(left: pa.Table, right: pa.Table) -> pa.Table:
        centres = cloudpickle.loads(shipped.value)
        schema = pa.schema([("number", pa.int64()), ("query_id", pa.int64()), ("best", best_type)])
        out = []
        if left.num_rows and right.num_rows:
            right = right.sort_by([("pivot", "ascending"), ("distance", "ascending"), ("at", "ascending")])
            grp = right.column("grp")[0].as_py()
            for d in np.intersect1d(left.column("dim").to_numpy(), right.column("dim").to_numpy()).tolist():
                qs, x = rows_of(left, d)
                other = left.column("own").to_numpy()[qs] != grp  # its own group has been searched
                qs, x = qs[other], x[other]
                if not len(qs):
                    continue
                at, y = rows_of(right, d)
                found_by = Queries(left.column("id").to_numpy()[qs], whole(x), k, left.column("floor").take(pa.array(qs)).to_pylist())
                search_rows(found_by, centres.get(d, np.zeros((1, d))), right.column("id").to_numpy()[at], right.column("pivot").to_numpy()[at], right.column("distance").to_numpy()[at], whole(y))
                hit = [n for n, b in enumerate(found_by.best) if b]
                out.append(pa.table([left.column("at").take(pa.array(qs[hit], pa.int64())), left.column("id").take(pa.array(qs[hit], pa.int64())), found([found_by.best[n] for n in hit])], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    asking = queries.select(F.col("grp").alias("own"), "at", "id", "dim", "v", "floor", run.alias("run")).join(pairs, "run")
    asked = index.select("grp", "dim", "pivot", "distance", "id", "v", "at").join(pairs, "grp")
    unit = ["run", "grp"]
    more = asking.groupBy(*unit).cogroup(asked.groupBy(*unit)).applyInArrow(outer, f"number long, query_id long, {best}")
    told = queries.select(F.col("at").alias("number"), F.col("id").alias("query_id"), "best").union(more).select("number", "query_id", F.explode("best").alias("b"))
    w = Window.partitionBy("number").orderBy(F.col("b.score").desc(), F.col("b.vec_id"))
    ranked = told.select("number", "query_id", F.row_number().over(w).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
