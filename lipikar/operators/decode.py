"""Codes of shows, their text, and what no mapping knows."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKER = "⟦CID:%d⟧"


def identity_codes(data: Column, strict: bool = False) -> Column:
    """Big-endian 16-bit codes. A last odd byte is dropped, or raises if ``strict``."""
    n = F.octet_length(data)
    starts = F.when(n >= 2, F.sequence(F.lit(1), n - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    codes = F.transform(starts, lambda i: F.conv(F.hex(F.substring(data, i, F.lit(2))), 16, 10).cast("int"))
    if strict:
        codes = F.when(n % 2 == 0, codes).otherwise(F.raise_error(F.lit("odd number of bytes in an Identity-H string")).cast("array<int>"))
    return F.when(data.isNotNull(), codes)


def code_maps(mapping: DataFrame, by: list[str]) -> DataFrame:
    """``by, code_map``: a mapping's entries, one for each code of ``by``, as one map. A map has as many entries as a font has codes at most."""
    return mapping.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("cid", "text"))).alias("code_map"))


def told(codes: Column, code_map: Column) -> Column:
    """The text of each code of an array, in place: no row for each glyph. A code that the map lacks, or a null map, gives the marker."""
    return F.transform(codes, lambda c: F.coalesce(F.try_element_at(code_map, c), F.format_string(MARKER, c)))


class Told(dict):
    """``told`` for the bytes of whole strings, by a map of codes to texts that takes in the markers of those it lacks."""

    def __missing__(self, code: int) -> str:
        self[code] = out = MARKER % code
        return out

    def __call__(self, data: bytes, strict: bool = False) -> str:
        if strict and len(data) % 2:
            raise ValueError("odd number of bytes in an Identity-H string")
        return "".join(map(self.__getitem__, struct.unpack_from(f">{len(data) // 2}H", data)))


def untold(codes: Column, code_map: Column) -> Column:
    """The distinct codes of an array that the map lacks, in ascending order."""
    return F.array_sort(F.array_distinct(F.array_except(codes, F.coalesce(F.map_keys(code_map), F.array().cast("array<int>")))))


def decode(codes: DataFrame, mapping: DataFrame, on: list[str]) -> DataFrame:
    """``codes`` with ``text`` and ``known``: a left join, a code without a mapping shown by its marker."""
    found = codes.join(mapping.select(*on, F.col("text").alias("__text")), on, "left")
    return found.select(*codes.columns, F.coalesce("__text", F.format_string(MARKER, F.col("cid"))).alias("text"), F.col("__text").isNotNull().alias("known"))


def used_codes(codes: DataFrame, by: list[str]) -> DataFrame:
    return codes.groupBy(*by, "cid").agg(F.count("*").alias("uses"))


def missing_codes(codes: DataFrame, mapping: DataFrame, on: list[str]) -> DataFrame:
    """Distinct codes that the mapping lacks."""
    return codes.select(*on).distinct().join(mapping.select(*on), on, "left_anti")


def joined(rows: DataFrame, by: list[str], order: list[str], text: str = "text", sep: str = "") -> DataFrame:
    """Texts of a group put together in order."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t"))))
    return rows.groupBy(*by).agg(parts.alias("__p")).select(*by, F.array_join(F.transform("__p", lambda x: x["__t"]), sep).alias(text))


def classify(used: Column, native: Column, effective: Column) -> Column:
    """``struct<unresolved, fallback, unknown>`` of code arrays, sorted: what the font's own map lacks, and which of that other sources know."""
    unresolved = F.array_sort(F.array_except(used, native))
    return F.struct(unresolved.alias("unresolved"), F.array_sort(F.array_intersect(unresolved, effective)).alias("fallback"), F.array_sort(F.array_except(unresolved, effective)).alias("unknown"))
