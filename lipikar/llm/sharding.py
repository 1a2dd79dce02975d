"""Operator 4, sharding.

Contiguous shards of nearly equal bytes: rows are put in key order, every
partition's total goes into a prefix sum over partitions, and the running sum is
cut at equal targets. Only ids, sizes and hashes move; texts stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, fresh, stored


def byte_size(text: Column) -> Column:
    """UTF-8 bytes (null: none) plus one for the separator."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _dealt(docs: DataFrame, key: Column, text: Column, name: str, keep: list[Column]) -> DataFrame:
    """Rows in key order, numbered by partition and place: ``keep`` with ``size, part, at``.

    The boundaries of a range partitioning are sampled, so what has been dealt out
    is stored. Rows that repeat key and text are told apart by where they came
    from, so they can be dealt to several partitions.
    """
    tie = F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))
    rows = docs.select(*keep, byte_size(text).alias("__size"), key.alias("__key"), tie.alias("__tie"), F.monotonically_increasing_id().alias("__from"))
    order = [F.col("__key").asc_nulls_first(), F.col("__tie"), F.col("__from")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ordered.drop("__key", "__tie", "__from").select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")), name)


def _cut(dealt: DataFrame, n_shards: int) -> DataFrame:
    """``dealt`` with ``__shard`` and ``__row``, its number in the whole order."""
    everything = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row for each partition, however many documents there are.
    totals = dealt.groupBy("__part").agg(F.sum("__size").alias("bytes"), F.count("*").alias("rows"))
    starts = totals.select("__part", F.coalesce(F.sum("bytes").over(everything), F.lit(0)).alias("__bytes_before"), F.coalesce(F.sum("rows").over(everything), F.lit(0)).alias("__rows_before"), F.sum("bytes").over(whole).alias("__total"))
    inner = Window.partitionBy("__part").orderBy("__at")
    placed = dealt.select("*", (F.sum("__size").over(inner) - F.col("__size")).alias("__before"), (F.row_number().over(inner) - 1).alias("__n")).join(F.broadcast(starts), "__part")
    middle = 2 * (F.col("__bytes_before") + F.col("__before")) + F.col("__size")
    shard = F.least(F.floor(middle.cast("decimal(38,0)") * n_shards / (2 * F.col("__total"))), F.lit(n_shards - 1)).cast("int")
    return placed.select(*dealt.columns, shard.alias("__shard"), (F.col("__rows_before") + F.col("__n")).alias("__row"))


def assign_shards(docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row ``key, size, text_crc32, shard, slot`` for each row of ``docs``.

    Rows are ordered by ``key`` (nulls first), then by a hash of the text; equal
    rows may change places with one another, which no result shows. A row goes to
    the shard in which the middle of its bytes lies on the scale of all bytes, so
    a shard is off its target by less than one row at either end. A row larger
    than the target takes a shard to itself and may leave a neighbour empty.
    ``slot`` counts from 0 in each shard without gaps. Null and empty texts have
    size 1. An empty table gives an empty result; other columns don't come out.
    """
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    dealt = _dealt(docs, docs[key], docs[text], "shard-keys", [docs[key].alias("__id"), F.crc32(t.cast("binary")).alias("text_crc32")])
    cut = stored(_cut(dealt, n_shards), "shard-cuts")
    drop_stored(dealt)
    # One row for each shard.
    first = cut.groupBy("__shard").agg(F.min("__row").alias("__first"))
    return cut.join(F.broadcast(first), "__shard").select(F.col("__id").alias(key), F.col("__size").alias("size"), "text_crc32", F.col("__shard").alias("shard"), (F.col("__row") - F.col("__first")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int, key: str = "doc_id", text: str = "text") -> str:
    """Writes ``docs`` as Parquet under ``path/shard=<k>/`` by the law of ``assign_shards`` and returns the folders' column name.

    The rows of a shard are one contiguous range of the key order, and its files
    hold them in that order; rows that repeat key and text are cut like others. All
    columns stay: where ``docs`` has a column ``shard``, the folders are called by
    the first free one of ``_shard``, ``__shard`` and so on. Rows move once; an
    empty table writes a table without rows.
    """
    names = docs.columns
    (folder,) = fresh(docs, "shard")
    dealt = _dealt(docs.toDF(*[f"c{i}" for i in range(len(names))]), F.col(f"c{names.index(key)}"), F.col(f"c{names.index(text)}"), "shard-rows", [F.col(f"c{i}") for i in range(len(names))])
    # Where shards begin, in partitions and places: one row for each shard.
    cut = _cut(dealt.select("__size", "__part", "__at"), n_shards)
    begins = cut.groupBy("__shard").agg(F.min(F.struct("__part", "__at")).alias("b")).orderBy("__shard").collect()
    shard = F.lit(begins[0]["__shard"] if begins else 0)
    for r in begins[1:]:
        part, at = r["b"]["__part"], r["b"]["__at"]
        shard = F.when((F.col("__part") > part) | ((F.col("__part") == part) & (F.col("__at") >= at)), F.lit(r["__shard"])).otherwise(shard)
    dealt.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], shard.alias(folder)).write.partitionBy(folder).parquet(path)
    drop_stored(dealt)
    return folder
