"""Mappings from several sources merged by precedence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Precedence of sources, strongest first, in each way of reading.
PRESETS = {
    "reference_text": ("learned", "legacy", "ttf", "fingerprint"),
    "documented": ("tounicode", "learned", "fingerprint", "legacy", "ttf"),
    "extract": ("legacy", "tounicode"),
    "review": ("learned", "ttf", "unique_gid"),
}


def by_precedence(sources: dict[str, DataFrame], precedence: tuple[str, ...], on: list[str]) -> DataFrame:
    """``on, text, source``: for each key the text of the strongest source; of equals the last in ``ord``.

    Sources have the columns ``on, text, ord``. One union and one aggregation.
    """
    parts = [sources[s].select(*on, "text", F.col("ord").cast("long").alias("ord"), F.lit(len(precedence) - n).alias("p"), F.lit(s).alias("source")) for n, s in enumerate(precedence) if s in sources]
    if not parts:
        raise ValueError("no source")
    best = reduce(DataFrame.unionAll, parts).groupBy(*on).agg(F.max_by(F.struct("text", "source"), F.struct("p", "ord")).alias("b"))
    return best.select(*on, "b.text", "b.source")


def page_report_map(writes: DataFrame, fills: DataFrame, on: list[str]) -> DataFrame:
    """The analysis map: fonts in order, each first writing (``step`` 0 ToUnicode, 1 override), then filling gaps.

    ``writes`` and ``fills`` have ``on, text, font_ord`` (writes also ``step``).
    The last write over all fonts wins; where nothing is written, the first fill.
    """
    w = writes.groupBy(*on).agg(F.max_by("text", F.struct("font_ord", "step")).alias("written"))
    f = fills.groupBy(*on).agg(F.min_by("text", "font_ord").alias("filled"))
    both = w.join(f, on, "full_outer")
    return both.select(*on, F.coalesce("written", "filled").alias("text"), F.when(F.col("written").isNotNull(), "written").otherwise("filled").alias("source"))


def flat(sections: DataFrame, on: list[str]) -> DataFrame:
    """Sections of all fonts as one map: the last one wins."""
    return sections.groupBy(*on).agg(F.max_by("text", "ord").alias("text"))


def gaps(known: DataFrame, more: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``more`` whose key ``known`` lacks."""
    return more.join(known.select(*on), on, "left_anti")
