"""Whole queries over PDF files: operations, mappings, page texts and reports."""

from __future__ import annotations

import time
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.storagelevel import StorageLevel

from ..functions import cmap, script, truetype
from ..functions.content import fallback_shows, text_shows
from ..functions.syntax import SyntaxFault
from ..operators import context, decode, learned, merge, resolve
from ..sources import mappings, pdf, sinks

PAGE = ["pdf_id", "page_no"]
_SHOWS = "op_index int, operator string, operands array<struct<kind: string, bytes: binary, num: double>>, error string"


def stream_shows(data: bytes, fallback: bool = False) -> tuple[list[tuple[str, list]], str | None]:
    """([(operator, operands)], error) of a content stream: none, if it has a fault anywhere, but those that ``fallback`` finds."""
    shows, error = text_shows(data)
    shows = [] if error else shows
    if not shows and fallback:
        shows = [(op, operands) for _, op, operands in fallback_shows(data)]
    return shows, error


def text_ops(streams: DataFrame, keep: list[str], fallback: bool = False) -> DataFrame:
    """Show operations of ``decoded`` streams; a stream with a fault anywhere gives none, but a row that says so. ``fallback`` scans streams that yield nothing byte by byte."""

    def make(data: bytes) -> list[tuple]:
        found, error = stream_shows(data, fallback)
        rows = [(n, op, [dict(zip(("kind", "bytes", "num"), x)) for x in operands], None) for n, (op, operands) in enumerate(found)]
        return rows + ([(len(rows), None, [], error)] if error else [])

    return pdf.expand(streams, "decoded", keep, pdf.ddl(_SHOWS), make)


@dataclass
class Parts:
    """The tables that page queries share."""

    objects: DataFrame
    pages: DataFrame
    fonts: DataFrame
    ops: DataFrame
    codes: DataFrame
    ttf: DataFrame
    contents: DataFrame
    edges: DataFrame
    strict: bool = False
    fallback: bool = False

    def release(self) -> None:
        """Lets go of what executors hold, once results have been written; tables made from it are worked out again if they are read."""
        for table in (self.objects, self.edges, self.fonts, self.ops, self.ttf):
            table.unpersist()


def read_parts(files: DataFrame, fallback: bool = False, strict: bool = False) -> Parts:
    """``objects, pages, fonts, ops, codes, ttf`` of ``files(pdf_id, content)``, and the ``contents`` that pages refer to, not inflated."""
    # Scanned once: all that follows are joins on (pdf_id, obj_num). What is kept grows with the files and stays on disk.
    objects = pdf.latest_objects(pdf.pdf_objects(files)).persist(StorageLevel.DISK_ONLY)
    edges = resolve.reference_edges(objects).persist(StorageLevel.DISK_ONLY)
    bodies = resolve.resolved(objects, edges=edges)
    pages = resolve.pages(objects)
    fonts = resolve.font_info(resolve.font_entries(resolve.page_resources(pages, bodies)), objects, bodies).persist(StorageLevel.DISK_ONLY)
    refs = resolve.content_refs(pages)
    # Only content streams reach inflate.
    contents = refs.join(objects.select("pdf_id", F.col("obj_num").alias("content_object"), "body"), ["pdf_id", "content_object"])
    streams = pdf.pdf_streams(contents, [*PAGE, "content_ord", "content_object"]).filter("decoded is not null")
    ops = text_ops(streams, [*PAGE, "content_ord", "content_object"], fallback)
    ops = ops.withColumn("op_seq", F.col("content_ord").cast("long") * (1 << 32) + F.col("op_index")).persist(StorageLevel.DISK_ONLY)
    strings = ops.filter("operator is not null").select(*PAGE, "op_seq", F.posexplode("operands").alias("operand", "o")).filter("o.kind = 'string'")
    codes = strings.select(*PAGE, "op_seq", "operand", F.posexplode(decode.identity_codes(F.col("o.bytes"), strict)).alias("pos", "cid"))
    files2 = fonts.filter("font_file2 is not null").select("pdf_id", "font_file2", "base_font").distinct()
    ttf = pdf.pdf_streams(files2.join(objects.select("pdf_id", F.col("obj_num").alias("font_file2"), "body"), ["pdf_id", "font_file2"]), ["pdf_id", "font_file2", "base_font"])
    ttf = ttf.filter("decoded is not null").select("pdf_id", "font_file2", "base_font", F.col("decoded").alias("ttf"), learned.font_key(F.coalesce("base_font", F.lit("")), F.col("decoded")).alias("fkey")).persist(StorageLevel.DISK_ONLY)
    return Parts(objects, pages, fonts, ops, codes, ttf, contents, edges, strict, fallback)


def glyph_tables(ttf: DataFrame) -> DataFrame:
    """``fkey, gid, text, glyph_fingerprint`` of each distinct font, parsed once each."""

    def make(data: bytes) -> list[tuple]:
        try:
            font = truetype.Font(data)
            texts = truetype.glyph_texts(font)
            return [(g, texts.get(g), fp) for g, fp in truetype.fingerprints(font).items()]
        except truetype.FontFault:
            return []

    one = ttf.dropDuplicates(["fkey"]).select("fkey", "ttf")
    return pdf.expand(one, "ttf", ["fkey"], pdf.ddl("gid int, text string, glyph_fingerprint string"), make)


def tounicode_entries(fonts: DataFrame, objects: DataFrame, strict: bool = False) -> DataFrame:
    """``pdf_id, tounicode, cid, text, ord`` of each distinct ToUnicode object."""

    def make(data: bytes) -> list[tuple]:
        if strict:
            return [(c, cmap.units_text(u), n) for n, (c, u) in enumerate(cmap.parse_cmap(data)[1].items())]
        return [(c, t, n) for n, (c, t) in enumerate(cmap.parse_tounicode(data).items())]

    wanted = fonts.filter("tounicode is not null").select("pdf_id", "tounicode").distinct()
    bodies = wanted.join(objects.select("pdf_id", F.col("obj_num").alias("tounicode"), "body"), ["pdf_id", "tounicode"])
    return pdf.expand_streams(bodies, ["pdf_id", "tounicode"], pdf.ddl("cid int, text string, ord long"), make)


def page_sources(parts: Parts, legacy: DataFrame | None = None, glyphs: DataFrame | None = None) -> dict[str, DataFrame]:
    """The five sources by page: ``pdf_id, page_no, cid, text, ord, font_ord``."""
    out = {}
    uni = tounicode_entries(parts.fonts, parts.objects)
    base = parts.fonts.select(*PAGE, "font_ord", "base_font", "tounicode", "font_file2")
    cols = [*PAGE, "cid", "text", "ord", "font_ord"]
    out["tounicode"] = base.join(uni, ["pdf_id", "tounicode"]).withColumn("ord", F.col("font_ord").cast("long") * 65536 + F.col("ord")).select(*cols)
    if legacy is not None:
        own = mappings.section_for_font(legacy, parts.fonts.filter("base_font is not null"))
        out["legacy"] = base.join(own, "base_font").select(*cols)
    tables = glyph_tables(parts.ttf)
    keyed = base.join(parts.ttf.select("pdf_id", "font_file2", "fkey"), ["pdf_id", "font_file2"])
    own = keyed.join(tables, "fkey").persist()
    out["ttf"] = own.filter("text is not null").select(*PAGE, F.col("gid").alias("cid"), "text", (-F.col("font_ord")).cast("long").alias("ord"), "font_ord")
    if glyphs is None:
        return out
    sure = learned.confirmed(glyphs).select("fkey", F.col("gid").alias("cid"), F.col("text"), "seq")
    out["learned"] = keyed.join(sure, "fkey").select(*PAGE, "cid", "text", F.col("seq").alias("ord"), "font_ord")
    index = learned.fingerprint_index(glyphs)
    out["fingerprint"] = own.select(*PAGE, F.col("gid").alias("cid"), "glyph_fingerprint", "font_ord").join(index, "glyph_fingerprint").select(*PAGE, "cid", "text", (-F.col("font_ord")).cast("long").alias("ord"), "font_ord")
    # A glyph number means nothing across fonts by itself: only the review's preset asks for it.
    out["unique_gid"] = own.select(*PAGE, F.col("gid").alias("cid"), "font_ord").join(learned.unique_gid_map(glyphs).withColumnRenamed("gid", "cid"), "cid").select(*PAGE, "cid", "text", (-F.col("font_ord")).cast("long").alias("ord"), "font_ord")
    return out


def effective_map(parts: Parts, legacy: DataFrame | None = None, glyphs: DataFrame | None = None, preset: str = "documented") -> DataFrame:
    """``pdf_id, page_no, cid, text, source`` by a preset of ``merge``, or ``reference_report``, which writes and fills font by font."""
    sources = page_sources(parts, legacy, glyphs)
    key = [*PAGE, "cid"]
    if preset != "reference_report":
        return merge.by_precedence(sources, merge.PRESETS[preset], key)
    section = merge.by_precedence(sources, merge.PRESETS["reference_text"], [*key, "font_ord"])
    writes = sources["tounicode"].select(*key, "text", "font_ord", F.lit(0).alias("step")).unionAll(section.select(*key, "text", "font_ord", F.lit(1)))
    return merge.page_report_map(writes, sources["ttf"].select(*key, "text", "font_ord"), key)


@pandas_udf(T.ArrayType(T.StringType()))
def logical(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: None if t is None else script.logical_tokens(t, visual=True))


@pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@pandas_udf(T.ArrayType(T.StringType()))
def composed(tokens: pd.Series) -> pd.Series:
    """Tokens that are in logical order already, with the halves of vowel signs put together."""
    return tokens.map(lambda t: None if t is None else script.logical_tokens(t, visual=False))


@pandas_udf(T.StringType())
def chosen(tokens: pd.Series, cids: pd.Series, lost: pd.Series, font: pd.Series) -> pd.Series:
    """The text of a show: in logical order, unless shaping with the page's font says that the drawn order fits as well. Codes without a text leave no choice."""

    def one(t, c, missing, f):
        if t is None:
            return None
        reordered = "".join(script.logical_tokens(t, visual=True))
        return reordered if missing or f is None else script.choose(bytes(f), list(c), "".join(t), reordered)[0]

    return pd.Series([one(*x) for x in zip(tokens, cids, lost.map(lambda x: x is not None and len(x) > 0), font)], index=tokens.index, dtype=object)


def op_texts(parts: Parts, mapping: DataFrame) -> DataFrame:
    """``pdf_id, page_no, op_seq, tokens, cids, missing`` of each show: a page's codes as one map, met by the page's shows, a row each."""
    strings = F.filter("operands", lambda o: o["kind"] == "string")
    cids = F.flatten(F.transform(strings, lambda o: decode.identity_codes(o["bytes"], parts.strict)))
    shows = parts.ops.filter("operator is not null").select(*PAGE, "op_seq", "operator", "content_object", "op_index", cids.alias("cids"))
    found = shows.join(decode.code_maps(mapping, PAGE), PAGE, "left")
    return found.select(*shows.columns, decode.told(F.col("cids"), F.col("code_map")).alias("tokens"), decode.untold(F.col("cids"), F.col("code_map")).alias("missing"))


def raw_texts(parts: Parts, mapping: DataFrame) -> DataFrame:
    """``pdf_id, page_no, text, error``: a page's shows in order, a line each, as decoded.

    A page's streams meet its map as they are in the file and are inflated, read
    and told in one pass, a page at a time: no show is a row, and none is kept.
    """
    streams = parts.contents.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("content_ord", "body"))).alias("streams"))
    found = parts.pages.select(*PAGE).join(streams, PAGE, "left").join(decode.code_maps(mapping, PAGE), PAGE, "left")
    given = found.select(*PAGE, F.transform("streams", lambda x: x["body"]).alias("streams"), F.map_keys("code_map").alias("cids"), F.map_values("code_map").alias("texts"))
    strict, fallback = parts.strict, parts.fallback

    def one(bodies: list[bytes], told: decode.Told) -> tuple[str, str | None]:
        lines, errors = [], []
        for body in bodies:
            if (data := pdf.decoded(body)[0]) is not None:
                shows, error = stream_shows(data, fallback)
                lines += ["".join([told(s, strict) for kind, s, _ in operands if kind == "string"]) for _, operands in shows]
                errors += [error] if error else []
        return "\n".join(lines), min(errors, default=None) if not lines else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*PAGE, "text", "error"]
        for batch in batches:
            start, out, held = 0, [], 0
            for n, (bodies, cids, texts) in enumerate(zip(*batch.columns[len(PAGE) :]), 1):
                told = decode.Told({c: t for c, t in zip(cids.as_py() or (), texts.as_py() or ()) if t is not None})
                out.append(one(bodies.as_py() or (), told))
                held += len(out[-1][0])
                if held >= pdf.SLICE_BYTES or n == batch.num_rows:
                    kept = [c.slice(start, n - start) for c in batch.columns[: len(PAGE)]]
                    yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, pa.string()) for x in zip(*out))], names=names)
                    start, out, held = n, [], 0

    return given.mapInArrow(work, T.StructType([*given.schema.fields[: len(PAGE)], T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))


def page_texts(parts: Parts, mapping: DataFrame, corrections: dict[str, str] | None = None, raw: bool = False, renormalize: bool = False, shaping: bool = True) -> DataFrame:
    """``pdf_id, page_no, text, error``: one line for each show, in logical order, normalised and repaired (``raw``: as decoded).

    With ``shaping``, the page's first embedded font decides between the drawn and
    the logical order where HarfBuzz is there to ask. ``error`` tells why nothing
    could be read of a page; a page with other shows hasn't failed.
    """
    if raw:
        return raw_texts(parts, mapping)
    ops = op_texts(parts, mapping)
    if shaping and script.can_shape():
        fonts = parts.fonts.filter("font_file2 is not null").groupBy(*PAGE).agg(F.min_by("font_file2", "font_ord").alias("font_file2"))
        fonts = fonts.join(parts.ttf.groupBy("pdf_id", "font_file2").agg(F.first("ttf").alias("ttf")), ["pdf_id", "font_file2"]).select(*PAGE, "ttf")
        lines = ops.join(fonts, PAGE, "left").select(*PAGE, "op_seq", chosen("tokens", "cids", "missing", "ttf").alias("text"))
    else:
        lines = ops.select(*PAGE, "op_seq", F.array_join(logical("tokens"), "").alias("text"))
    joined = decode.joined(lines, PAGE, ["op_seq"], sep="\n")
    errors = parts.ops.groupBy(*PAGE).agg(F.min("error").alias("error"), F.count("operator").alias("n")).filter("n = 0").drop("n")
    text = script.cleanup_column(nfc(F.coalesce("text", F.lit(""))), corrections)
    text = nfc(text) if renormalize else text
    return parts.pages.select(*PAGE).join(joined, PAGE, "left").join(errors, PAGE, "left").select(*PAGE, text.alias("text"), "error")


def document_texts(files: DataFrame, legacy: DataFrame | None = None, glyphs: DataFrame | None = None, preset: str = "documented", corrections: dict[str, str] | None = None) -> DataFrame:
    """``pdf_id, text, n_pages``: all pages of each file between markers."""
    parts = read_parts(files)
    return sinks.document_text(page_texts(parts, effective_map(parts, legacy, glyphs, preset), corrections))


def stage_seconds(files: DataFrame, legacy: DataFrame | None = None, glyphs: DataFrame | None = None, preset: str = "documented", corrections: dict[str, str] | None = None) -> dict[str, float]:
    """Seconds of each stage of decoding ``files``, one after another, what came before being at hand; then of all."""
    out: dict[str, float] = {}

    def timed(name: str, table: DataFrame) -> None:
        began = time.perf_counter()
        table.write.format("noop").mode("overwrite").save()
        out[name] = time.perf_counter() - began

    timed("pdf_read", files)
    parts = read_parts(files)
    timed("page_analysis", parts.ops)
    timed("font_bytes_lookup", parts.ttf)
    mapping = effective_map(parts, legacy, glyphs, preset).persist()
    timed("mapping_materialize", mapping)
    timed("text_processing", page_texts(parts, mapping, corrections))
    mapping.unpersist()
    parts.release()
    return out | {"total": sum(out.values())}


def page_reports(parts: Parts, mapping: DataFrame) -> DataFrame:
    """The structured report of each page: fonts, size of the map, used and missing codes, operations."""
    ops = op_texts(parts, mapping)
    each = F.array_sort(F.collect_list(F.struct("op_seq", "content_object", "operator", "cids", F.array_join("tokens", "").alias("decoded"), F.col("missing").alias("missing_cids"), (F.col("op_index") + 1).alias("index"))))
    operations = ops.groupBy(*PAGE).agg(each.alias("operations"))
    used = decode.used_codes(parts.codes, PAGE).groupBy(*PAGE).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cid", "uses")))).alias("used_cids"))
    missing = decode.missing_codes(parts.codes, mapping, [*PAGE, "cid"]).groupBy(*PAGE).agg(F.array_sort(F.collect_list("cid")).alias("missing_cids"))
    size = mapping.groupBy(*PAGE).agg(F.count_distinct("cid").alias("tounicode_entries"))
    fonts = parts.fonts.groupBy(*PAGE).agg(F.map_from_entries(F.collect_list(F.struct("resource", F.struct("font_object", "base_font", "encoding", "descendant_font", "font_descriptor", "font_file2", "tounicode")))).alias("fonts"))
    out = parts.pages.select(*PAGE, F.col("obj_num").alias("page_object"))
    for more in (fonts, size, used, missing, operations):
        out = out.join(more, PAGE, "left")
    return out.select(
        F.col("pdf_id").alias("pdf"),
        F.col("page_no").alias("page"),
        "page_object",
        "fonts",
        F.coalesce("tounicode_entries", F.lit(0)).alias("tounicode_entries"),
        F.transform_keys("used_cids", lambda k, v: k.cast("string")).alias("used_cids"),
        F.coalesce("missing_cids", F.array().cast("array<int>")).alias("missing_cids"),
        F.transform("operations", lambda o: o.dropFields("op_seq")).alias("operations"),
    )


def unresolved_report(parts: Parts, mapping: DataFrame) -> DataFrame:
    """Each use of each code that the mapping lacks, with what stands around it."""
    told = decode.decode(parts.codes, mapping, [*PAGE, "cid"])
    return context.unresolved_context(told, decode.missing_codes(parts.codes, mapping, [*PAGE, "cid"]), PAGE)


def inspect_tounicode(files: DataFrame, font_object: int) -> DataFrame:
    """``pdf_id, tounicode, codespaces, mappings, first`` of one font by the strict reader."""
    objects = pdf.resolved_objects(files).filter("error is null")
    font = objects.filter((F.col("obj_num") == font_object) & (F.col("gen") == 0)).select("pdf_id", F.try_variant_get(F.parse_json("value"), "$.v.ToUnicode.v[0]", "long").alias("tounicode"))
    found = font.join(objects.select("pdf_id", F.col("obj_num").alias("tounicode"), "stream"), ["pdf_id", "tounicode"])

    def make(data: bytes) -> list[tuple]:
        spaces, codes = cmap.parse_cmap(data)
        first = [{"code": c, "text": cmap.units_text(codes[c])} for c in sorted(codes)[:10]]
        return [([dict(zip(("low", "high", "width"), s)) for s in spaces], len(codes), first)]

    return pdf.expand(found, "stream", ["pdf_id", "tounicode"], pdf.ddl("codespaces array<struct<low: long, high: long, width: int>>, mappings int, first array<struct<code: int, text: string>>"), make)


def diagnose(files: DataFrame) -> DataFrame:
    """Size, header, objects, pages, fonts and maps of each file."""
    objects = pdf.pdf_objects(files)
    text = resolve.latin(F.col("body"))
    counts = objects.groupBy("pdf_id").agg(
        F.count("*").alias("objects"),
        F.count_if(text.rlike(r"/Type\s*/Page[\s/>]")).alias("pages"),
        F.count_if(text.rlike(r"/Type\s*/Font(?![A-Za-z])")).alias("fonts"),
        F.count_if(text.contains("/FontFile2")).alias("embedded"),
        F.count_if(text.contains("/ToUnicode")).alias("with_tounicode"),
        F.count_if(text.contains("/Identity-H")).alias("identity_h"),
    )
    return files.select("pdf_id", F.octet_length("content").cast("long").alias("bytes"), pdf.header_ok(F.col("content")).alias("header")).join(counts, "pdf_id", "left")


def generate_font(ttf: bytes, entries: DataFrame, family: str = "Recovered Bangla Unicode") -> tuple[bytes, dict[str, int]]:
    """A font file for the confirmed entries, which are as many as a font has glyphs at most; more than a font can have raises."""
    if (n := entries.count()) > 65_536:
        raise ValueError(f"{n} entries: a font has 65,536 glyphs at most")
    rows = entries.select("gid", "text").collect()
    return truetype.unicode_font(ttf, {r["gid"]: r["text"] for r in rows}, family)


def try_parse(data: bytes) -> str | None:
    """The fault of a content stream, or None."""
    try:
        return text_shows(data)[1]
    except SyntaxFault as fault:
        return str(fault)
