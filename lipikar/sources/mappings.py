"""Mapping, learned-glyph, correction and conjunct files as tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.script import corrections_in_order

LEARNED = "schema_version int, fonts map<string, struct<base_font: string, glyphs: map<string, struct<gid: int, text: string, unicode: array<string>, glyph_fingerprint: string, confidence: double, source: string>>>>"
GLYPHS = "fkey string, base_font string, gid int, text string, unicode array<string>, glyph_fingerprint string, confidence double, source string, seq long"


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", "true").text(path)


def _entries(value: Column) -> Column:
    """A JSON object's members in their order."""
    return F.transform(F.json_object_keys(value), lambda k: F.struct(k.alias("k")))


def legacy_mapping(texts: DataFrame) -> DataFrame:
    """``font_key, cid, text, ord`` from ``value``, JSON of base font to code to text.

    A text may also be an object with a member ``text``. Sections that aren't
    objects, keys that aren't whole numbers and other values are passed over; of a
    repeated key the last counts.
    """
    fonts = texts.select(F.posexplode(F.from_json("value", "map<string,string>")).alias("font_ord", "font_key", "section"))
    cells = fonts.select("font_ord", "font_key", F.posexplode(F.from_json("section", "map<string,string>")).alias("cell_ord", "cid", "raw"))
    inner = F.get_json_object("raw", "$.text")
    is_object = F.col("raw").startswith("{")
    return cells.filter(F.col("cid").rlike(r"^\s*\d+\s*$")).select("font_key", F.trim("cid").cast("int").alias("cid"), F.when(is_object, inner).otherwise(F.col("raw")).alias("text"), (F.col("font_ord") * 65536 + F.col("cell_ord")).cast("long").alias("ord")).filter("text is not null")


def font_name_match(section: Column, font: Column) -> Column:
    """1 to 4 by how a section's name fits a font's: exact, without slash, without subset prefix, both stripped; null if it doesn't."""
    plain = F.ltrim(font, F.lit("/"))
    bare = F.regexp_replace(plain, r"^[A-Z]{6}\+", "")
    section_bare = F.regexp_replace(F.ltrim(section, F.lit("/")), r"^[A-Z]{6}\+", "")
    return F.when(section == font, 1).when(section == plain, 2).when(section == bare, 3).when(section_bare == bare, 4)


def section_for_font(legacy: DataFrame, fonts: DataFrame) -> DataFrame:
    """``base_font, cid, text, ord``: for each font the section whose name fits best, of equals the first.

    Section and font names are few; the join is on the name without slash and prefix.
    """
    key = lambda c: F.regexp_replace(F.ltrim(c, F.lit("/")), r"^[A-Z]{6}\+", "")
    a = fonts.select("base_font").distinct().withColumn("k", key(F.col("base_font")))
    b = legacy.groupBy("font_key").agg(F.min("ord").alias("first")).withColumn("k", key(F.col("font_key")))
    fits = a.join(b, "k").withColumn("rank", font_name_match(F.col("font_key"), F.col("base_font")))
    best = fits.withColumn("n", F.row_number().over(Window.partitionBy("base_font").orderBy("rank", "first"))).filter("n = 1")
    return best.select("base_font", "font_key").join(legacy, "font_key").select("base_font", "cid", "text", "ord")


def learned_glyphs(texts: DataFrame) -> DataFrame:
    """The learned database as rows; JSON that isn't an object raises, no row gives no rows."""
    parsed = texts.select(F.when(F.trim("value").startswith("{"), F.from_json("value", LEARNED)).otherwise(F.raise_error(F.lit("the learned database must be a JSON object"))).alias("db"))
    fonts = parsed.select(F.posexplode("db.fonts").alias("font_ord", "fkey", "font"))
    return fonts.select("font_ord", "fkey", "font.base_font", F.posexplode("font.glyphs").alias("ord", "key", "g")).select(
        "fkey", "base_font", F.coalesce("g.gid", F.col("key").cast("int")).alias("gid"), "g.text", "g.unicode", "g.glyph_fingerprint", "g.confidence", "g.source", (F.col("font_ord") * 65536 + F.col("ord")).cast("long").alias("seq")
    )


def empty_learned(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], GLYPHS)


def learned_json(glyphs: DataFrame) -> DataFrame:
    """The learned database as one JSON text for each font: the sink's rows."""
    row = F.struct("gid", "text", "unicode", "glyph_fingerprint", "confidence", "source")
    cells = glyphs.groupBy("fkey").agg(F.first("base_font").alias("base_font"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("gid").cast("string").alias("k"), row.alias("v"))))).alias("glyphs"))
    return cells.select("fkey", F.to_json(F.struct(F.lit(1).alias("schema_version"), F.create_map("fkey", F.struct("base_font", "glyphs")).alias("fonts")), {"pretty": "true"}).alias("value"))


def learned_file(glyphs: DataFrame) -> DataFrame:
    """The whole learned database as one JSON text, the file's one row: it has as many entries as people have confirmed."""
    row = F.struct("gid", "text", "unicode", "glyph_fingerprint", "confidence", "source")
    cells = glyphs.groupBy("fkey").agg(F.first("base_font").alias("base_font"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("gid").cast("string").alias("k"), row.alias("v"))))).alias("glyphs"))
    by_key = lambda a, b: F.when(a["fkey"] < b["fkey"], -1).otherwise(1)
    fonts = cells.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("fkey", F.struct("base_font", "glyphs").alias("v"))), by_key)).alias("fonts"))
    return fonts.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), "fonts"), {"pretty": "true"}).alias("value"))


def corrections(spark: SparkSession, own: dict[str, str] | None = None) -> DataFrame:
    """``ord, wrong, right``: defaults first, overridden in place."""
    return spark.createDataFrame([(n, w, r) for n, (w, r) in enumerate(corrections_in_order(own).items())], "ord int, wrong string, right string")


def read_corrections(texts: DataFrame) -> dict[str, str]:
    """The members of small files, of one that repeats the last by file name; JSON that can't be read corrects nothing beyond the defaults."""
    named = texts.select(F.col("_metadata.file_name").alias("name") if _from_files(texts) else F.lit("").alias("name"), F.from_json("value", "map<string,string>").alias("m"))
    out: dict[str, str] = {}
    for r in sorted(named.collect(), key=lambda r: r["name"]):
        out |= dict(r["m"] or {})
    return out


def _from_files(rows: DataFrame) -> bool:
    try:
        rows.select("_metadata.file_name")
    except AnalysisException:
        return False
    return True


def conjuncts(texts: DataFrame) -> DataFrame:
    """``text`` of each conjunct that isn't empty; a file whose ``conjuncts`` isn't a list raises."""
    parsed = texts.select(F.from_json("value", "conjuncts array<string>").alias("f"))
    checked = parsed.select(F.when(F.col("f.conjuncts").isNotNull(), F.col("f.conjuncts")).otherwise(F.raise_error(F.lit("conjuncts must be a list"))).alias("c"))
    return checked.select(F.explode("c").alias("text")).filter("text <> ''")
