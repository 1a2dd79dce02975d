"""Queries that must not grow beyond their input: what they move, and odd rows against SQL."""

import os
from types import SimpleNamespace

import oracle_check
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from lipikar.plans import catalogue, pages
from lipikar.sources import pdf, writer


@pytest.fixture(scope="module")
def odd(spark, tiny, tmp_path_factory):
    """The small tables with documents of odd texts."""
    out = tmp_path_factory.mktemp("odd")
    for name in os.listdir(tiny):
        if name != "documents.parquet":
            os.symlink(f"{tiny}/{name}", out / name)
    texts = ["a😀b😀\x01 é😀", "", None, "\n", "plain\n\nlines\n", "x" * 30 + "ж" * 40 + "y", " end ", "日本語" * 20]
    rows = [(n, t, "en", "s", len(t or "")) for n, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(out / "documents.parquet"))
    return str(out)


def test_unresolved_context_of_odd_texts(spark, odd):
    assert oracle_check.compare(spark, catalogue.unresolved_context, catalogue.oracle_sql()["unresolved_context"], odd) is None


def test_unresolved_context_moves_nothing(spark, tiny):
    plan = catalogue.unresolved_context(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_raw_page_texts_go_by_whole_strings(spark, tiny):
    plan = catalogue.pdf_roundtrip_text(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert "conv(" not in plan and "try_element_at" not in plan


def test_raw_page_texts(spark):
    content = b"BT <000100020009> Tj [<0001> -20 <00030A>] TJ [5] TJ (\\000\\002) Tj ET"
    codes = {1: "ক", 2: "ি", 3: "সে"}
    objects = {1: b"<< /Type /Catalog >>", 2: b"<< /Type /Font /BaseFont /A /ToUnicode 3 0 R >>", 3: writer.stream(writer.tounicode(codes))}
    for page in (4, 6, 8):
        objects[page] = f"<< /Type /Page /Resources << /Font << {'/F 2 0 R' if page != 6 else ''} >> >> /Contents {page + 1} 0 R >>".encode()
        objects[page + 1] = writer.stream(content if page != 8 else b"BT ET")
    files = spark.createDataFrame([("a", bytearray(writer.file_of(objects)))], "pdf_id string, content binary")
    parts = pages.read_parts(files)
    mapping = pages.effective_map(parts)
    got = {r.page_no: r.text for r in pages.page_texts(parts, mapping, raw=True).collect()}
    assert got == {1: "কি⟦CID:9⟧\nকসে\n\nি", 2: "⟦CID:1⟧⟦CID:2⟧⟦CID:9⟧\n⟦CID:1⟧⟦CID:3⟧\n\n⟦CID:2⟧", 3: ""}
    with pytest.raises(Exception, match="odd number"):
        pages.raw_texts(pages.read_parts(files, strict=True), mapping).collect()


def test_table_functions_hand_on_in_slices(spark):
    given = SimpleNamespace(schema=T.StructType([T.StructField("id", T.LongType()), T.StructField("b", T.BinaryType())]), mapInArrow=lambda f, _: f)
    rows = SimpleNamespace(select=lambda *_: given)
    work = pdf.expand(rows, "b", ["id"], pdf.ddl("n int, body binary"), lambda b: [(0, b), (1, b[::-1])])
    data = [None if i % 5 == 0 else bytes([i % 256]) * 50_000 for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array(data, pa.binary())], names=["id", "__bytes"])
    got = list(work(iter([batch])))
    assert len(got) > 5 and max(b.nbytes for b in got) < 4 * pdf.SLICE_BYTES
    assert [(r["id"], r["n"], r["body"]) for b in got for r in b.to_pylist()] == [(i, n, d) for i, d in enumerate(data) if d is not None for n in (0, 1)]
    many = pdf.expand(rows, "b", ["id"], pdf.ddl("n int, body binary"), lambda b: [(n, b"x") for n in range(100)])
    assert max(b.num_rows for b in many(iter([batch]))) < pdf.SLICE_ROWS + 100


def test_parts_stay_on_disk_and_raw_texts_need_no_row_for_each_show(spark, tiny):
    files = spark.createDataFrame([("a", bytearray(writer.build_pdf([[[1]]], {1: "x"})))], "pdf_id string, content binary")
    parts = pages.read_parts(files)
    for kept in (parts.objects, parts.edges, parts.fonts, parts.ops, parts.ttf):
        assert kept.storageLevel.useDisk and not kept.storageLevel.useMemory
    parts.release()
    assert "operands" not in catalogue.pdf_roundtrip_text(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()


def test_raw_page_texts_of_faulty_streams(spark):
    contents = {4: b"BT <0001> Tj <00zz> Tj ET", 6: b"BT <0001> Tj ET", 8: b"Tj", 10: None}
    objects = {1: b"<< /Type /Catalog >>", 2: b"<< /Type /Font /BaseFont /A /ToUnicode 3 0 R >>", 3: writer.stream(writer.tounicode({1: "x"}))}
    for page, content in contents.items():
        objects[page] = f"<< /Type /Page /Resources << /Font << /F 2 0 R >> >> /Contents [{page + 1} 0 R 7 0 R] >>".encode() if page == 8 else f"<< /Type /Page /Resources << /Font << /F 2 0 R >> >> /Contents {page + 1} 0 R >>".encode()
        objects[page + 1] = writer.stream(content) if content is not None else b"<< /Filter /FlateDecode /Length 3 >>\nstream\nabc\nendstream"
    files = spark.createDataFrame([("a", bytearray(writer.file_of(objects)))], "pdf_id string, content binary")
    for fallback, first in ((False, ""), (True, "x")):
        parts = pages.read_parts(files, fallback=fallback)
        mapping = pages.effective_map(parts)
        got = {r.page_no: (r.text, r.error) for r in pages.page_texts(parts, mapping, raw=True).collect()}
        assert {k: t for k, (t, _) in got.items()} == {1: first, 2: "x", 3: "x", 4: ""}
        assert {k: e for k, (_, e) in got.items()} == {r.page_no: r.error for r in pages.page_texts(parts, mapping).collect()}
        assert (got[1][1] is None) == fallback
        parts.release()
