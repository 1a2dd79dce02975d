"""Operator 10, mixing sources to target weights by Pfair scheduling.

Every source is a task whose utilisation is its target weight and whose jobs are
its blocks. Block ``i`` of a source of weight ``w`` is released at slot
``floor(i / w)`` and due by ``ceil((i + 1) / w)``; taking the released block that
is due first keeps every source less than one block from its exact share at all
times. Weights are exact fractions, so nothing adds up however long the schedule.

Blocks, not rows, are scheduled, one after another in one task that keeps a job of
each source. Rows find their block by their number in their source, worked out on
keys alone; texts move once, when they are put in order.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, stored

#: Bytes of a boundary of the order, and of all that are broadcast together, at most.
BOUND, BOUNDS = 64, 64 << 20


def exact_weights(weights: Mapping[str | None, float | Fraction]) -> dict[str | None, int]:
    """Whole numbers in exactly the proportions of the positive weights."""
    given = {s: Fraction(w) for s, w in weights.items() if w > 0}
    common = math.lcm(*(w.denominator for w in given.values())) if given else 1
    whole = {s: int(w * common) for s, w in given.items()}
    shrink = math.gcd(*whole.values()) if whole else 1
    return {s: w // shrink for s, w in whole.items()}


def pfair_schedule(weights: Mapping[str | None, float | Fraction], blocks: Mapping[str | None, int]) -> Iterator[tuple[str | None, int, int, int, int]]:
    """(source, block, slot, release, deadline) of all blocks, earliest deadline first among released ones.

    A source that has run out leaves its slots to no one: others keep their own pace.
    """
    share = exact_weights({s: w for s, w in weights.items() if blocks.get(s)})
    total = sum(share.values())
    order = {s: k for k, s in enumerate(sorted(share, key=lambda s: (-share[s], s is None, s or "")))}
    # A source's next block waits for its release or is ready; there is one at a time.
    waiting = [(0, order[s], s, 0) for s in share]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str | None, int, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, k, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // share[s]), k, s, i, release))
        deadline, k, s, i, release = heapq.heappop(ready)
        yield s, i, slot, release, deadline
        slot += 1
        if i + 1 < blocks[s]:
            heapq.heappush(waiting, (max(slot, (i + 1) * total // share[s]), k, s, i + 1))


def target_weights(counts: Mapping[str | None, int], temperature: float) -> dict[str | None, float]:
    """Counts to the power of ``1 / temperature``: 1 keeps the natural mix, more evens it out."""
    return {s: n ** (1 / temperature) for s, n in counts.items() if n > 0}


def addressed(docs: DataFrame) -> tuple[DataFrame, Column]:
    """(``docs``, a number of each row that every scan gives again): of its place in its file, or in a copy where rows don't come straight from files."""
    try:
        at = F.xxhash64("_metadata.file_name", "_metadata.row_index")
        docs.select(at)
        return docs, at
    except AnalysisException:
        (name,) = fresh(docs, "row_at")
        copy = stored(docs.withColumn(name, F.monotonically_increasing_id()), "mix-copy")
        return copy, F.col(name)


class Mix:
    """The schedule of a table's sources and what a row needs to find its place in it."""

    def __init__(self, docs: DataFrame, weights: Mapping[str | None, float] | None, source: str, key: str, text: str, block_rows: int, temperature: float, rows_per_bucket: int, rows_per_file: int):
        spark: SparkSession = docs.sparkSession
        self.columns = docs.columns
        self.docs, at = addressed(docs)
        self.block_rows = block_rows
        src = F.struct(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s"), F.col(source).isNull().alias("z"))
        # The order within a source is that of a hash of key and text; only equal rows need their place.
        self.keyed = self.docs.select("*", src.alias("__src"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("__h"), at.alias("__at"))
        keys = self.keyed.select(F.col(key).alias("__key"), "__src", "__h", "__at")
        # One count for each source.
        self.counts = {None if r["__src"]["z"] else r["__src"]["s"]: r["count"] for r in keys.groupBy("__src").count().collect()}
        self.total = sum(self.counts.values())
        wanted = target_weights(self.counts, temperature) if weights is None else {s: w for s, w in weights.items() if s in self.counts and w > 0}
        late = [s for s in sorted(self.counts, key=lambda s: (s is None, s or "")) if s not in wanted]
        # Boundaries are broadcast: where sources are many, files grow instead.
        per_file = max(rows_per_file, self.total * len(self.counts) * BOUND // BOUNDS, 1)
        self.files = max(1, -(-self.total // per_file))
        self.schedule = stored(self._schedule(spark, wanted, late, per_file), "mix-schedule")
        self.numbered = stored(self._numbered(keys, max(1, self.total // rows_per_bucket)), "mix-ranks")

    def _schedule(self, spark: SparkSession, weights: Mapping, late: list, per_file: int) -> DataFrame:
        """``s, z, block, slot, file``: written by one task, a batch of blocks at a time."""
        size, counts, files = self.block_rows, self.counts, self.files
        blocks = {s: -(-n // size) for s, n in counts.items()}

        def rows(_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def everything() -> Iterator[tuple]:
                slot = -1
                for s, i, slot, _, _ in pfair_schedule(weights, blocks):
                    yield s, i, slot
                for s in late:
                    for i in range(blocks[s]):
                        slot += 1
                        yield s, i, slot

            out: list[tuple] = []
            before = 0
            for s, i, slot in everything():
                out.append((s or "", s is None, i, slot, min(before // per_file, files - 1)))
                before += min(size, counts[s] - i * size)
                if len(out) == 1 << 16:
                    yield pd.DataFrame(out, columns=["s", "z", "block", "slot", "file"])
                    out = []
            yield pd.DataFrame(out, columns=["s", "z", "block", "slot", "file"])

        return spark.range(0, 1, 1, 1).mapInPandas(rows, "s string, z boolean, block long, slot long, file int")

    def _numbered(self, keys: DataFrame, n_buckets: int) -> DataFrame:
        """``__key, __src, __h, __at, rank``. Hash buckets of a source are numbered each by itself, so a source that holds a third of all rows is spread like the rest."""
        # Buckets are ranges of the hash: they follow one another in the order.
        bucket = F.floor((F.col("__h") / F.lit(2.0**64) + 0.5) * n_buckets)
        placed = keys.withColumn("bucket", F.least(F.greatest(bucket, F.lit(0)), F.lit(n_buckets - 1)))
        sizes = placed.groupBy("__src", "bucket").count()
        starts = sizes.select("__src", "bucket", F.coalesce(F.sum("count").over(Window.partitionBy("__src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
        w = Window.partitionBy("__src", "bucket").orderBy("__h", "__at")
        ranked = placed.withColumn("rank", F.row_number().over(w) - 1)
        # One row for each bucket: Spark broadcasts them below its own size limit only.
        return ranked.join(starts, ["__src", "bucket"]).select("__key", "__src", "__h", "__at", (F.col("rank") + F.col("start")).cast("long").alias("rank"))

    def places(self, key: str, source: str) -> DataFrame:
        """``key, source, mix_block, mix_slot, mix_offset`` of every row."""
        n = self.numbered.select("*", F.floor(F.col("rank") / self.block_rows).alias("block"), F.col("__src.s").alias("s"), F.col("__src.z").alias("z"))
        found = n.join(self.schedule.drop("file"), ["s", "z", "block"])
        return found.select(
            F.col("__key").alias(key),
            F.when(~F.col("z"), F.col("s")).alias(source),
            F.col("block").cast("long").alias("mix_block"),
            F.col("slot").alias("mix_slot"),
            (F.col("rank") % self.block_rows).cast("int").alias("mix_offset"),
        )

    def ordered(self) -> DataFrame:
        """The rows in the mixed order, file by file, with ``mix_block, mix_slot, mix_offset``."""
        b = self.block_rows
        # The first row of each source in each file.
        firsts = self.schedule.groupBy("s", "z", "file").agg((F.min("block") * b).alias("rank"))
        n = self.numbered.select("__h", "__at", "rank", F.col("__src.s").alias("s"), F.col("__src.z").alias("z"))
        bounds = n.join(firsts, ["s", "z", "rank"]).groupBy("s", "z").agg(F.sort_array(F.collect_list(F.struct(F.col("__h").alias("h"), F.col("__at").alias("at"), "file", "rank"))).alias("__bounds"))
        held = stored(bounds.select(F.struct("s", "z").alias("__src"), "__bounds"), "mix-bounds")
        steps = F.array(*[F.lit(2**i) for i in reversed(range(self.files.bit_length() + 1))])
        x = lambda i: F.get(F.col("__bounds"), i)
        reached = lambda i: (x(i)["h"] < F.col("__h")) | ((x(i)["h"] == F.col("__h")) & (x(i)["at"] <= F.col("__at")))
        # Binary search: how many of the source's boundaries stand at or before the row.
        found = F.aggregate(steps, F.lit(0), lambda at, m: F.when(F.coalesce(reached(at + m - 1), F.lit(False)), at + m).otherwise(at)) - 1
        # BOUNDS bytes at most.
        placed = self.keyed.join(F.broadcast(held), "__src").select("*", x(found).alias("__b")).select("*", F.col("__b.file").alias("__file"), F.col("__b.rank").alias("__first"))
        names = self.columns
        rows = placed.select(*[F.col(c) for c in names], "__src", "__h", "__at", "__file", "__first", F.lit(None).cast("long").alias("__block"), F.lit(None).cast("long").alias("__slot"))
        # Blocks travel with the rows of their file, as rows without a text.
        types = {f.name: f.dataType for f in rows.schema.fields}
        heads = self.schedule.select(*[F.lit(None).cast(types[c]).alias(c) for c in names], F.struct("s", "z").alias("__src"), F.lit(None).cast("long").alias("__h"), F.lit(None).cast("long").alias("__at"), F.col("file").alias("__file"), F.lit(None).cast("long").alias("__first"), F.col("block").alias("__block"), F.col("slot").alias("__slot"))
        dealt = rows.unionByName(heads).repartitionById(self.files, F.col("__file"))
        number = F.row_number().over(Window.partitionBy("__file", "__src").orderBy(F.col("__h").asc_nulls_last(), "__at")) - 1 + F.col("__first")
        ranked = dealt.select("*", number.alias("__rank")).withColumn("__block", F.coalesce("__block", F.floor(F.col("__rank") / b)))
        slot = F.max("__slot").over(Window.partitionBy("__file", "__src", "__block"))
        slotted = ranked.select("*", slot.alias("mix_slot")).filter("__first is not null")
        out = slotted.select(*[F.col(c) for c in names], F.col("__block").alias("mix_block"), "mix_slot", (F.col("__rank") % b).cast("int").alias("mix_offset"))
        return out.sortWithinPartitions("mix_slot", "mix_offset")


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    source: str = "source",
    key: str = "doc_id",
    text: str = "text",
    block_rows: int = 16,
    temperature: float = 2.0,
    rows_per_bucket: int = 500,
) -> DataFrame:
    """``key, source, mix_block, mix_slot, mix_offset`` for each row of ``docs``; sorting by the last two gives the mixed order.

    ``weights`` maps sources to target weights; without it they are the sources'
    row counts to the power of ``1 / temperature``. Sources that it lacks or gives
    nothing come after one another at the very end. A source's rows are taken in
    the order of a hash of key and text and cut into blocks of ``block_rows``.
    No row is dropped: when a source has run out, its slots stay empty and the
    others go on at their own pace, so the deviation from the exact weights is
    under one block while all last. Null is a source of its own; null keys and
    texts and repeated rows are rows like any other; an empty table gives an empty
    result; other columns don't come out.

    Texts don't move. Rows of a source are numbered in buckets of about
    ``rows_per_bucket`` rows, and a block has ``block_rows``: no source's rows meet
    in one task. The driver sees one count for each source.
    """
    mix = Mix(docs, weights, source, key, text, block_rows, temperature, rows_per_bucket, 1 << 40)
    return mix.places(key, source)


def in_mixed_order(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    source: str = "source",
    key: str = "doc_id",
    text: str = "text",
    block_rows: int = 16,
    temperature: float = 2.0,
    rows_per_bucket: int = 500,
    rows_per_file: int = 10_000,
    keep_places: bool = False,
) -> DataFrame:
    """``docs`` in the order of ``mix_sources``: written as files, rows stand in the mixed order, about ``rows_per_file`` in each.

    Columns stay as they are; columns called ``mix_block``, ``mix_slot`` or
    ``mix_offset`` are replaced if ``keep_places`` asks for these three. Texts move
    once, straight to the file that they belong to.
    """
    base = docs.drop("mix_block", "mix_slot", "mix_offset") if keep_places else docs
    renamed = {c: n for c, n in zip(("mix_block", "mix_slot", "mix_offset"), fresh(base, "m_block", "m_slot", "m_offset")) if c in base.columns}
    mix = Mix(base.withColumnsRenamed(renamed), weights, source, key, text, block_rows, temperature, rows_per_bucket, rows_per_file)
    out = mix.ordered()
    return out if keep_places else out.drop("mix_block", "mix_slot", "mix_offset").withColumnsRenamed({n: c for c, n in renamed.items()})
