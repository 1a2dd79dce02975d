"""Learned glyphs: confirmed, reused across fonts, remembered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def font_key(base_font: Column, ttf: Column) -> Column:
    return F.concat(base_font, F.lit(":"), F.sha2(ttf, 256))


def confirmed(glyphs: DataFrame) -> DataFrame:
    return glyphs.filter(F.coalesce("confidence", F.lit(0.0)) >= 1.0)


def unambiguous(rows: DataFrame, key: list[str], value: str, seq: str, ignore_empty: bool = False) -> DataFrame:
    """Keys whose values are all the same, with the last row's value."""
    given = rows.filter(F.col(value) != "") if ignore_empty else rows
    return given.groupBy(*key).agg(F.max_by(value, seq).alias(value), F.count_distinct(F.col(value)).alias("__n")).filter("__n = 1").drop("__n")


def fingerprint_index(glyphs: DataFrame) -> DataFrame:
    """``glyph_fingerprint, text`` for outlines that stand for one text in all fonts. Keys ``gid:n``, which any font has, don't count."""
    usable = confirmed(glyphs).filter(F.col("glyph_fingerprint").isNotNull() & ~F.col("glyph_fingerprint").startswith("gid:"))
    return unambiguous(usable, ["glyph_fingerprint"], "text", "seq")


def unique_gid_map(glyphs: DataFrame) -> DataFrame:
    """``gid, text`` for glyph numbers with one text that isn't empty."""
    return unambiguous(confirmed(glyphs), ["gid"], "text", "seq", ignore_empty=True)


def mapping_of(glyphs: DataFrame, fkey: Column, gid: Column) -> DataFrame:
    return glyphs.filter((F.col("fkey") == fkey) & (F.col("gid") == gid))


def code_points(text: Column) -> Column:
    """``U+%04X`` for each character."""
    one = lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.format_string("U+%04X", one(c)))


def remember(glyphs: DataFrame, news: DataFrame) -> DataFrame:
    """``glyphs`` with ``news(fkey, base_font, gid, text, glyph_fingerprint, confidence, source)`` put in: the last for each (fkey, gid) stands.

    The order of news is their own column ``seq``; without one all are of the same
    time, and of two for one glyph the greater text stands, in every run.
    """
    order = F.col("seq") if "seq" in news.columns else F.lit(0)
    added = news.withColumn("unicode", code_points(F.col("text"))).withColumn("seq", F.lit(2**40) + order.cast("long"))
    return latest(glyphs.unionByName(added.select(*glyphs.columns)))


def latest(glyphs: DataFrame) -> DataFrame:
    rest = [c for c in glyphs.columns if c not in ("fkey", "gid")]
    return glyphs.groupBy("fkey", "gid").agg(F.max_by(F.struct(*rest), F.struct("seq", "text") if "text" in rest else F.col("seq")).alias("r")).select("fkey", "gid", "r.*").select(*glyphs.columns)


def confirmed_entries(legacy: DataFrame, glyphs: DataFrame) -> DataFrame:
    """``gid, text``: what a generated font says. Each source flattened over fonts, the last one winning; learned over legacy."""
    a = legacy.select(F.col("cid").alias("gid"), "text", F.lit(0).alias("p"), "ord")
    b = confirmed(glyphs).select("gid", "text", F.lit(1), F.col("seq"))
    return a.unionAll(b).filter("text <> ''").groupBy("gid").agg(F.max_by("text", F.struct("p", "ord")).alias("text"))


def entry_counts(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.count_if(F.length("text") == 1).alias("single"), F.count_if(F.length("text") > 1).alias("ligatures"))
