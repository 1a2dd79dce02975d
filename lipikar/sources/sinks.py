"""Texts, reports and dumps."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Page markers of the text output.
PAGE_HEAD, PAGE_END = "<<<page:%d>>>", "<<<END>>>"


def marked_page(page_no: Column, text: Column, error: Column | None = None) -> Column:
    """A page between its markers; of a failed page a line that says so."""
    said = F.coalesce(text, F.lit(""))
    if error is not None:
        said = F.when(error.isNotNull(), F.format_string("[PAGE %d FAILED: %s]", page_no, error)).otherwise(said)
    return F.concat_ws("\n", F.format_string(PAGE_HEAD, page_no), said, F.lit(PAGE_END))


def document_text(pages: DataFrame, by: str = "pdf_id") -> DataFrame:
    """``by, text, n_pages``: marked pages joined in page order. A page is bounded by its file, so is a document."""
    error = F.col("error") if "error" in pages.columns else None
    marked = pages.select(by, "page_no", marked_page(F.col("page_no"), F.col("text"), error).alias("m"))
    joined = marked.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("page_no", "m"))).alias("ms"))
    text = F.array_join(F.transform("ms", lambda x: x["m"]), "\n")
    return joined.select(by, text.alias("text")).withColumn("n_pages", F.regexp_count("text", F.lit("<<<page:")).cast("long"))


def write_text(documents: DataFrame, path: str, by: str = "pdf_id") -> None:
    documents.select("text").write.mode("overwrite").text(path)


def write_json(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").json(path)


def cache_fonts(ttf: DataFrame, path: str) -> DataFrame:
    """Adds the embedded fonts of ``ttf(fkey, ttf)`` that ``path`` lacks, once each, and returns the whole cache."""
    spark = ttf.sparkSession
    fonts = ttf.select("fkey", "ttf").dropDuplicates(["fkey"])
    try:
        known = spark.read.parquet(path)
        fonts = fonts.join(known.select("fkey"), "fkey", "left_anti")
    except AnalysisException:  # nothing there yet
        pass
    fonts.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def hex_dump(data: Column, width: int = 16, start: int = 0, most: int | None = None) -> Column:
    """``array<struct<offset, hex, ascii>>``: lines of ``width`` bytes from ``start``, ``most`` bytes at most."""
    if width not in (8, 16, 32):
        raise ValueError("width is 8, 16 or 32")
    part = F.substring(data, F.lit(start + 1), F.lit(most if most is not None else 2**31 - 1 - start))
    lines = F.when(F.octet_length(part) > 0, F.sequence(F.lit(0), F.floor((F.octet_length(part) - 1) / width).cast("int"))).otherwise(F.array().cast("array<int>"))

    def line(i):
        b = F.substring(part, i * width + 1, F.lit(width))
        pairs = F.rtrim(F.regexp_replace(F.hex(b), "(..)", "$1 "))
        return F.struct(F.lpad(F.hex((i * width + start).cast("long")), 8, "0").alias("offset"), pairs.alias("hex"), F.regexp_replace(F.decode(b, "ISO-8859-1"), r"[^\x20-\x7E]", ".").alias("ascii"))

    return F.transform(lines, line)


def hex_dump_text(line: Column, width: int = 16) -> Column:
    return F.concat(line["offset"], F.lit("  "), F.rpad(line["hex"], 3 * width - 1, " "), F.lit("  |"), line["ascii"], F.lit("|"))


def html_escape(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text
