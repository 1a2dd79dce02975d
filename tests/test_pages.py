"""PDF files through the whole plan."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lipikar.functions import truetype
from lipikar.operators import candidates, context, decode, learned, merge, resolve
from lipikar.plans import pages
from lipikar.sources import mappings, pdf, sinks, writer

CODES = {1: "ক", 2: "ি", 3: "সে", 4: "ন", 5: "x"}
SHAPES = [[]] + [[[(0, 0), (100 * i, 0), (100, 100 * i)]] for i in range(1, 8)]
NAMES = [".notdef", "g1", "g2", "g3", "g4", "g5", "uni0AA8", "uni09A8"]
FONT = writer.build_font({ord("ক"): 1, ord("প"): 6}, SHAPES, NAMES)
SCHEMA = "pdf_id string, content binary"


@pytest.fixture(scope="module")
def files(spark):
    good = writer.build_pdf([[[2, 1, 9], [3, 4]], [[5, 7]]], CODES, font=FONT)
    return spark.createDataFrame([("a", bytearray(good)), ("junk", bytearray(b"not a pdf")), ("empty", bytearray(b""))], SCHEMA)


@pytest.fixture(scope="module")
def parts(files):
    return pages.read_parts(files)


def test_fonts(parts):
    f = parts.fonts.filter("page_no = 1").first()
    assert (f.font_object, f.base_font, f.encoding, f.descendant_font, f.font_descriptor, f.font_file2, f.tounicode) == (3, "AAAAAA+Sample", "Identity-H", 4, 5, 7, 6)


def test_texts_and_reports(files, parts):
    m = pages.effective_map(parts)
    got = {r.page_no: r.text for r in pages.page_texts(parts, m).collect()}
    assert got == {1: "কি⟦CID:9⟧\nসেন", 2: "xন"}
    assert pages.document_texts(files).first().text == "<<<page:1>>>\nকি⟦CID:9⟧\nসেন\n<<<END>>>\n<<<page:2>>>\nxন\n<<<END>>>"
    report = pages.page_reports(parts, m).filter("page = 1").first()
    assert report.missing_cids == [9] and report.used_cids["9"] == 1 and [o.operator for o in report.operations] == ["Tj", "Tj"] and report.operations[0].missing_cids == [9]
    seen = pages.unresolved_report(parts, m).first()
    assert (seen.cid, seen.occurrence, seen.raw_hex) == (9, 1, "000200010009") and seen.context.endswith("⟦9⟧")
    assert pages.diagnose(files).filter("pdf_id = 'a'").first().pages == 2


def test_strict_reader(files):
    got = pages.inspect_tounicode(files.filter("pdf_id = 'a'"), 3).first()
    assert got.mappings == 5 and got.first[0].text == "ক"
    assert pdf.xref_table(files, strict=False).filter("error is not null").count() == 2
    with pytest.raises(Exception, match="PDF header"):
        pdf.xref_table(files).count()
    with pytest.raises(Exception, match="is free"):
        pdf.require(pdf.xref_table(files.filter("pdf_id = 'a'")), 0, 65535).collect()


def test_precedence(spark, parts):
    fkey = parts.ttf.first().fkey
    glyphs = spark.createDataFrame([(fkey, "Sample", 7, "L", ["U+004C"], "glyph:x", 1.0, "user_confirmed", 0), ("other", "B", 3, "F", [], truetype.fingerprint(truetype.Font(FONT), 2), 1.0, "user_confirmed", 1), ("other", "B", 4, "no", [], "gid:5", 1.0, "x", 2)], mappings.GLYPHS)
    legacy = mappings.legacy_mapping(spark.createDataFrame([(json.dumps({"/Sample": {"1": "Z", "8": {"text": "Y"}, "bad": "x"}, "n": 3}),)], "value string"))
    at = lambda preset: {r.cid: (r.text, r.source) for r in pages.effective_map(parts, legacy, glyphs, preset).filter("page_no = 1").collect()}
    text = at("reference_text")
    assert text[7] == ("L", "learned") and text[1] == ("Z", "legacy") and text[8] == ("Y", "legacy") and text[2] == ("F", "fingerprint") and 5 not in text
    documented = at("documented")
    assert documented[1] == ("ক", "tounicode") and documented[7][0] == "L" and documented[8][0] == "Y"
    assert at("reference_report")[1][0] == "Z"


def test_references(spark):
    bodies = {1: b"2 0 R", 2: b"[3 0 R]", 3: b"end", 4: b"99 0 R", **{n: f"{n + 1} 0 R".encode() for n in range(20, 40)}}
    objects = spark.createDataFrame([("a", n, bytearray(b)) for n, b in bodies.items()], "pdf_id string, obj_num long, body binary")
    got = {r.obj_num: r.body and bytes(r.body) for r in resolve.resolved(objects).collect()}
    assert got[1] == got[2] == got[3] == b"end" and got[4] is None and got[20] == b"29 0 R"


def test_page_range(parts):
    assert resolve.one_page(parts.pages, F.lit(2)).count() == 1
    with pytest.raises(Exception, match="outside 1..2"):
        resolve.one_page(parts.pages, F.lit(3)).collect()


def test_objects_last_definition_wins(spark):
    raw = b"%PDF-1.4 1 0 obj\nold\nendobj 1 1 obj new endobj 2 0 obj x"
    got = pdf.latest_objects(pdf.pdf_objects(spark.createDataFrame([("a", bytearray(raw))], SCHEMA))).collect()
    assert [(r.obj_num, bytes(r.body)) for r in got] == [(1, b"new")]


def test_broken_byte_shows(spark):
    good = writer.build_pdf([[[1]]], CODES)
    at = good.index(b"stream\n", good.index(b"11 0 obj")) + 12
    bad = good[:at] + bytes([good[at] ^ 255]) + good[at + 1 :]
    got = pages.document_texts(spark.createDataFrame([("g", bytearray(good)), ("b", bytearray(bad))], SCHEMA))
    assert {r.pdf_id: "ক" in r.text for r in got.collect()} == {"g": True, "b": False}


def test_identity_codes(spark):
    df = spark.createDataFrame([(bytearray.fromhex("002F004F0122"),), (bytearray(b""),), (bytearray.fromhex("002F00"),), (None,)], "b binary")
    assert [r.c for r in df.select(decode.identity_codes(F.col("b")).alias("c")).collect()] == [[47, 79, 290], [], [47], None]
    with pytest.raises(Exception, match="odd"):
        df.select(decode.identity_codes(F.col("b"), strict=True)).collect()


def test_provenance(spark):
    df = spark.createDataFrame([([56, 207, 290], [56], [56, 207, 290]), ([207, 290, 999], [], [207, 290])], "u array<int>, n array<int>, e array<int>")
    got = [r.s.asDict() for r in df.select(decode.classify(F.col("u"), F.col("n"), F.col("e")).alias("s")).collect()]
    assert got == [{"unresolved": [207, 290], "fallback": [207, 290], "unknown": []}, {"unresolved": [207, 290, 999], "fallback": [207, 290], "unknown": [999]}]


def test_truetype():
    font = truetype.Font(FONT)
    assert truetype.glyph_texts(font) == {1: "ক", 6: "প", 7: "ন"}
    prints = truetype.fingerprints(font)
    assert len(set(prints.values())) == font.count and truetype.fingerprint(font, 99) == "gid:99"
    other = truetype.Font(writer.build_font({ord("ক"): 2}, [[], SHAPES[2], SHAPES[1]], [".notdef", "g2", "g1"]))
    assert truetype.fingerprint(other, 2) == prints[1]
    assert "<path" in truetype.glyph_svg(font, 1) and "no outline" in truetype.glyph_svg(font, 0) and truetype.INK in truetype.line_svg(font, [1, 2], 2)
    made, counts = truetype.unicode_font(FONT, {1: "ক", 2: "ষ", 3: "কষ"}, "Made")
    assert counts == {"entries": 3, "single": 2, "ligatures": 1} and truetype.Font(made).code_points() == {ord("ক"): 1, ord("ষ"): 2}
    with pytest.raises(truetype.FontFault):
        truetype.unicode_font(FONT, {1: "কষ"}, "None")
    with pytest.raises(truetype.FontFault):
        truetype.Font(b"xx")


def test_standard_glyph_names():
    from lipikar.functions import glyphnames

    text = truetype.name_to_text
    # Names and what they stand for.
    known = {"A": "A", "aacute": "á", "Ccedilla": "Ç", "seven": "7", "quotesingle": "'", "alpha": "α", "Lambda": "Λ", "emdash": "—", "fi": "ﬁ", "a.sc": "a", "f_i": "fi", "uni0995uni09CD": "ক্", "u1D4B3": "𝒳"}
    assert {n: text(n) for n in known} == known and text("g12") is None and text(".notdef") is None
    order = {3: "space", 36: "A", 68: "a", 97: "asciitilde", 98: "Adieresis", 143: "notequal", 172: "nonbreakingspace", 189: "currency", 210: "apple", 225: "caron", 226: "Lslash", 257: "dcroat"}
    assert {k: glyphnames.mac_name(k) for k in order} == order and len({glyphnames.mac_name(k) for k in range(258)}) == 258


def test_learned_round_trip(spark):
    db = {"schema_version": 1, "fonts": {"k1": {"base_font": "B", "glyphs": {"7": {"gid": 7, "text": "ক", "unicode": ["U+0995"], "glyph_fingerprint": "glyph:1", "confidence": 1.0, "source": "user_confirmed"}}}}}
    rows = mappings.learned_glyphs(spark.createDataFrame([(json.dumps(db),)], "value string"))
    news = spark.createDataFrame([("k1", "B", 7, "খ", "glyph:1", 1.0, "user_confirmed"), ("k2", "B", 1, "𝒳", "glyph:2", 0.5, "x")], "fkey string, base_font string, gid int, text string, glyph_fingerprint string, confidence double, source string")
    got = {(r.fkey, r.gid): r for r in learned.remember(rows, news).collect()}
    assert got["k1", 7].text == "খ" and got["k2", 1].unicode == ["U+1D4B3"]
    again = mappings.learned_glyphs(mappings.learned_json(rows).select("value")).first()
    assert (again.fkey, again.gid, again.text) == ("k1", 7, "ক")
    with pytest.raises(Exception, match="JSON object"):
        mappings.learned_glyphs(spark.createDataFrame([("[1]",)], "value string")).collect()


def test_small_dimensions(spark):
    assert [r.right for r in mappings.corrections(spark, {"সমর্ত": "X", "n": "m"}).orderBy("ord").collect()] == ["শাখারী", "অন্নপূর্ণা", "X", "m"]
    texts = spark.createDataFrame([('{"conjuncts": ["ক্ষ", "", "ক্ষ"]}',)], "value string")
    curated = mappings.conjuncts(texts)
    assert curated.count() == 2 and candidates.generate(spark, curated, generated=False).count() == 1
    assert candidates.generate(spark, curated).count() == 32 * 32 + 32 * 17 * 17
    assert mappings.read_corrections(spark.createDataFrame([("not json",)], "value string")) == {}


def test_merge_report(spark):
    w = spark.createDataFrame([(1, "u0", 0, 0), (1, "o0", 0, 1), (1, "u1", 1, 0), (2, "u", 0, 0)], "cid int, text string, font_ord int, step int")
    f = spark.createDataFrame([(1, "t", 0), (3, "t0", 0), (3, "t1", 1)], "cid int, text string, font_ord int")
    assert {r.cid: (r.text, r.source) for r in merge.page_report_map(w, f, ["cid"]).collect()} == {1: ("u1", "written"), 2: ("u", "written"), 3: ("t0", "filled")}


def test_review_queue(spark):
    codes = spark.createDataFrame([("a", n, c) for n, c in enumerate([5, 6, 6])], "pdf_id string, op_seq long, cid int")
    prints = spark.createDataFrame([("a", 5, "glyph:1"), ("a", 6, "glyph:2")], "pdf_id string, gid int, glyph_fingerprint string")
    index = spark.createDataFrame([("glyph:1", "ক")], "glyph_fingerprint string, text string")
    got = context.review_queue(codes.select("pdf_id", "cid").distinct(), codes, prints, index, ["pdf_id"]).collect()
    assert [(r.cid, r.uses, r.first_op, r.suggestion) for r in got] == [(6, 2, 1, None), (5, 1, 0, "ক")]


def test_hex_dump(spark):
    df = spark.createDataFrame([(bytearray(b"abc\x00" * 5),)], "b binary")
    lines = df.select(sinks.hex_dump(F.col("b"), 8, start=4, most=12).alias("l")).first().l
    assert [(x.offset, x.hex, x.ascii) for x in lines] == [("00000004", "61 62 63 00 61 62 63 00", "abc.abc."), ("0000000C", "61 62 63 00", "abc.")]


def test_failed_page_text(spark):
    rows = spark.createDataFrame([("a", 1, "x", None), ("a", 2, None, "boom")], "pdf_id string, page_no int, text string, error string")
    assert sinks.document_text(rows).first().text == "<<<page:1>>>\nx\n<<<END>>>\n<<<page:2>>>\n[PAGE 2 FAILED: boom]\n<<<END>>>"


def test_streaming_equals_batch(spark, tmp_path):
    from lipikar.streaming import watch

    (tmp_path / "in").mkdir()
    for n in range(3):
        (tmp_path / f"in/{n}.pdf").write_bytes(writer.build_pdf([[[1, 4], [5]]], CODES))
    files = watch.arriving(spark, str(tmp_path / "in"), files_at_once=2)
    query = watch.decode_arriving(files, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(300)
    got = {os.path.basename(r.pdf_id): r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {os.path.basename(r.pdf_id): r.text for r in pages.document_texts(pdf.read_files(spark, str(tmp_path / "in"))).collect()}
    assert got == batch and len(got) == 3


def test_lookups(parts, files):
    from lipikar.sources.pdf import cmap_objects, font_objects, of_kind, one_object, resolved_objects, stream_objects

    assert {r.obj_num for r in font_objects(parts.objects).collect()} == {3, 4, 5}
    assert {r.obj_num for r in cmap_objects(parts.objects).collect()} == {6} and stream_objects(parts.objects).count() == 4
    assert one_object(parts.objects, 3).count() == 1
    typed = resolved_objects(files.filter("pdf_id = 'a'"))
    assert of_kind(typed.filter("obj_num = 6"), "stream").first().kind == "stream"
    with pytest.raises(Exception, match="object 3 is no stream"):
        of_kind(typed.filter("obj_num = 3"), "stream").collect()


def test_pictures(spark, parts):
    from lipikar.plans import pictures

    fkey = parts.ttf.first().fkey
    gids = spark.createDataFrame([(fkey, 1), (fkey, 1), (fkey, 99)], "fkey string, gid int")
    got = pictures.glyph_pictures(parts.ttf, gids).collect()
    assert [r.gid for r in got] == [1] and got[0].svg.startswith("<svg")
    lines = spark.createDataFrame([(fkey, 2, [1, 2, 3], "a < b")], "fkey string, gid int, cids array<int>, label string")
    assert "a &lt; b" in pictures.review_pages(parts.ttf, lines).first().html


def test_font_cache_and_stage_seconds(spark, files, parts, tmp_path):
    one = sinks.cache_fonts(parts.ttf, str(tmp_path / "fonts"))
    assert one.count() == 1 and sinks.cache_fonts(parts.ttf, str(tmp_path / "fonts")).count() == 1
    seconds = pages.stage_seconds(files.filter("pdf_id = 'a'"))
    assert list(seconds) == ["pdf_read", "page_analysis", "font_bytes_lookup", "mapping_materialize", "text_processing", "total"]


def test_command_line(spark, tmp_path, capsys):
    from lipikar.__main__ import main

    (tmp_path / "a.pdf").write_bytes(writer.build_pdf([[[2, 1, 9]], [[5]]], CODES, font=FONT))
    (tmp_path / "map.json").write_text(json.dumps({"Sample": {"1": "ক", "2": "ষ", "9": "কষ"}}))
    assert main([str(tmp_path / "a.pdf"), "--page", "1"]) == 2
    assert "⟦CID:9⟧" in capsys.readouterr().out
    out = [str(tmp_path / x) for x in ("t", "j", "d", "f.ttf")]
    assert main([str(tmp_path / "a.pdf"), "--mapping", str(tmp_path / "map.json"), "--text", out[0], "--json", out[1], "--dump", out[2], "--generate-ttf", out[3]]) == 0
    assert "কষ" in spark.read.text(out[0]).filter("value like '%কষ%'").first().value and spark.read.json(out[1]).count() == 2
    assert truetype.Font((tmp_path / "f.ttf").read_bytes()).code_points() == {ord("ক"): 1, ord("ষ"): 2}
    assert main([str(tmp_path / "nothing.pdf")]) == 1
