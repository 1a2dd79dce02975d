"""Where codes occur: windows, first lines, islands, layout."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Codes shown on either side of an unresolved one.
REACH = 8
#: Uses of missing codes in one batch of rows that a worker gives out.
_USES = 4096


def around(codes: DataFrame, by: list[str], order: str, value: str = "cid", reach: int = REACH) -> DataFrame:
    """``codes`` with ``context``, the values up to ``reach`` places before and after within ``by``."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-reach, reach)
    return codes.withColumn("context", F.collect_list(value).over(w))


def unresolved_context(codes: DataFrame, missing: DataFrame, page: list[str], reach: int = REACH) -> DataFrame:
    """One row for each use of a missing code: its running number on the page, and codes, texts and bytes around it.

    ``codes`` has ``page, op_seq, operand, pos, cid, text, known``; windows stay
    within one string operand.
    """
    w = Window.partitionBy(*page, "op_seq", "operand").orderBy("pos").rowsBetween(-reach, reach)
    shown = F.when(F.col("known"), F.col("text")).otherwise(F.format_string("⟦%d⟧", F.col("cid")))
    near = codes.select("*", F.collect_list("cid").over(w).alias("cids"), F.collect_list(shown).over(w).alias("texts"))
    n = F.row_number().over(Window.partitionBy(*page, "cid").orderBy("op_seq", "operand", "pos"))
    hits = near.join(missing.select(*page, "cid"), [*page, "cid"], "left_semi")
    return hits.select(*page, "cid", n.alias("occurrence"), "op_seq", "cids", F.array_join("texts", " ").alias("context"), F.array_join(F.transform("cids", lambda c: F.lpad(F.hex(c.cast("long")), 4, "0")), "").alias("raw_hex"))


class _Written(dict):
    """Codes as they are written, each made once."""

    def __init__(self, form: str, known: dict[int, str] = {}):
        super().__init__(known)
        self.form = form

    def __missing__(self, code: int) -> str:
        self[code] = out = self.form % code
        return out


def occurrences(codes: np.ndarray) -> np.ndarray:
    """How often each code has occurred up to and with its place."""
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    first = np.flatnonzero(np.diff(ranked, prepend=-1))
    out = np.empty(len(codes), np.int64)
    out[order] = np.arange(1, len(codes) + 1) - np.repeat(first, np.diff(first, append=len(codes)))
    return out


def unresolved_in_texts(rows: DataFrame, mapping: DataFrame, keep: list[str], text: str = "text", reach: int = REACH) -> DataFrame:
    """``unresolved_context`` where each row is a page of one operand, whose codes are the code points of ``text``: no row for each code, and nothing is moved.

    Returns ``keep, cid, occurrence, cids, context, raw_hex``, ``cids`` in decimal.
    ``mapping`` has ``cid, text``, a row for each code point at most, and goes to
    every task. A null or empty text gives no row.
    """
    texts = {r["cid"]: r["text"] for r in mapping.select("cid", "text").collect()}
    given = rows.select(*keep, F.col(text).cast("binary").alias("__bytes"))
    names = [*keep, "cid", "occurrence", "cids", "context", "raw_hex"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0x110000, bool)
        known[list(texts)] = True
        forms = _Written("%d"), _Written("⟦%d⟧", texts), _Written("%04X")
        for batch in batches:
            at, cids, ns, told = [], [], [], ([], [], [])

            def made() -> pa.RecordBatch:
                kept = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(keep))]
                return pa.RecordBatch.from_arrays([*kept, pa.array(cids, pa.int32()), pa.array(ns, pa.int32()), *(pa.array(x, pa.string()) for x in told)], names=names)

            for i, b in enumerate(batch.column(len(keep))):
                codes = np.frombuffer((b.as_py() or b"").decode(errors="replace").encode("utf-32-le"), "<u4").astype(np.int64)
                uses = np.flatnonzero(~known[codes])
                if not len(uses):
                    continue
                whole = codes.tolist()
                for p, n in zip(uses.tolist(), occurrences(codes[uses]).tolist()):
                    near = whole[max(0, p - reach) : p + reach + 1]
                    at.append(i)
                    cids.append(whole[p])
                    ns.append(n)
                    for out, form, sep in zip(told, forms, (" ", " ", "")):
                        out.append(sep.join(map(form.__getitem__, near)))
                    if len(at) == _USES:
                        yield made()
                        at, cids, ns, told = [], [], [], ([], [], [])
            if at:
                yield made()

    return given.mapInArrow(work, T.StructType([*given.schema.fields[:-1], *T.StructType.fromDDL("cid int, occurrence int, cids string, context string, raw_hex string").fields]))


def first_line(codes: DataFrame, by: list[str], order: str = "op_seq") -> DataFrame:
    """The first show that has each code."""
    return codes.groupBy(*by, "cid").agg(F.min(order).alias("first_op"))


def islands(rows: DataFrame, by: list[str], order: list[str], is_separator: Column) -> DataFrame:
    """``rows`` with ``island``: separators counted so far, so rows between two have one number."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("island", F.sum(is_separator.cast("long")).over(w))


def pen_positions(glyphs: DataFrame, by: list[str], order: str = "pos", advance: str = "advance") -> DataFrame:
    """``x``: the advances of all glyphs before."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return glyphs.withColumn("x", F.sum(advance).over(w) - F.col(advance))


def review_queue(missing: DataFrame, codes: DataFrame, prints: DataFrame, index: DataFrame, by: list[str]) -> DataFrame:
    """Missing glyphs with uses, first line and outline, those that a known outline would settle marked with its text; most used first."""
    uses = codes.groupBy(*by, "cid").agg(F.count("*").alias("uses"), F.min("op_seq").alias("first_op"))
    told = missing.select(*by, "cid").join(uses, [*by, "cid"]).join(prints.select(*by, F.col("gid").alias("cid"), "glyph_fingerprint"), [*by, "cid"], "left")
    return told.join(index.select("glyph_fingerprint", F.col("text").alias("suggestion")), "glyph_fingerprint", "left").orderBy(F.col("uses").desc(), *by, "cid")


def review_targets(codes: DataFrame, ttf: DataFrame, on: list[str], least: int = 120, only: int | None = None) -> DataFrame:
    """Codes to ask about where none are named: from ``least`` on, not told by the font itself; or the one in question."""
    out = codes.select(*on).distinct().filter(F.col("cid") >= least).join(ttf.select(*on), on, "left_anti")
    return out if only is None else out.filter(F.col("cid") == only)
