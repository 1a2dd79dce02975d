"""Byte-level table functions."""

import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lipikar.functions import cmap, content, syntax
from lipikar.sources import pdf, writer

REF = ("ref", (236, 0))


@pytest.mark.parametrize(
    "data,value",
    [
        (b"/Bangla", ("name", b"Bangla")),
        (b"/A#20B", ("name", b"A B")),
        (b"123", ("number", 123)),
        (b"-1.25", ("number", -1.25)),
        (b"236 0 R", REF),
        (b"true", ("boolean", True)),
        (b"null", ("null", None)),
        (b"(a(b)\\)\\101\\\nc)", ("string", b"a(b))Ac")),
        (b"<00 0F2>", ("hex", b"\x00\x0f\x20")),
        (b"% note\n[1 % more\n2]", ("array", (("number", 1), ("number", 2)))),
    ],
)
def test_values(data, value):
    assert syntax.parse_value(data) == value


def test_nested_values():
    assert len(syntax.parse_value(b"[1 /Bangla (abc) 236 0 R]")[1]) == 4
    d = syntax.parse_value(b"<</BaseFont /CQCQVJ#2BBangla /ToUnicode 236 0 R>>")
    assert syntax.get(d, "BaseFont") == ("name", b"CQCQVJ+Bangla") and syntax.get(d, "ToUnicode") == REF
    assert syntax.parse_indirect(b"6 0 obj << /A [<<>>] >> endobj")[:2] == (6, 0)
    assert syntax.as_text(REF) == "236 0 R" and syntax.as_text(("name", b"A")) == "/A"


@pytest.mark.parametrize("data", [b"[1 2", b"<</A 1 /A 2>>", b"1 2", b"<<1 2>>", b"/A#2", b"(abc", b">", b"{", b")", b"12x", b"", b"<</A>>", b"]"])
def test_faults(data):
    with pytest.raises(syntax.SyntaxFault):
        syntax.parse_value(data)


def test_shows():
    one = lambda b: content.text_shows(b)[0]
    assert one(b"BT (hello) Tj ET") == [("Tj", [("string", b"hello", None)])]
    assert one(b"BT <0003001B0038> Tj ET")[0][1][0][1] == bytes.fromhex("0003001B0038")
    assert one(rb"BT (a\n\101\(b\)) Tj ET")[0][1][0][1] == b"a\nA(b)"
    assert one(b"BT [<0003> 120 (abc) -30] TJ ET") == [("TJ", [("string", b"\0\x03", None), ("number", None, 120.0), ("string", b"abc", None), ("number", None, -30.0)])]
    assert one(b"BI /W 1 ID xx(Tj EI (a) ' (b) \"") == [("'", [("string", b"a", None)]), ('"', [("string", b"b", None)])]
    assert [k for k, *_ in content.lex(b"/F1 12 Tf % comment\nBT")] == ["name", "number", "operator", "operator"]
    assert "unterminated" in content.text_shows(b"(broken")[1] and "operand" in content.text_shows(b"BT Tj ET")[1]
    assert content.text_shows(b"(a) Tj (broken")[0] == [("Tj", [("string", b"a", None)])]
    assert one(b"[(a) /N] TJ (b) Tj")[-1:] == [("Tj", [("string", b"b", None)])] or content.text_shows(b"[(a) /N] TJ")[1]


def test_fallback_scanner():
    found = content.fallback_shows(b"garbage ) [(a) 3 <0041>] TJ >> (x) Tj <00> '")
    assert [(op, len(items)) for _, op, items in found] == [("TJ", 3), ("Tj", 1), ("'", 1)]


CMAP = b"1 begincodespacerange\n<0000><FFFF>\nendcodespacerange\n2 beginbfchar\n<0003><0020>\n<001B><0981>\nendbfchar\n2 beginbfrange\n<001E><0020><0985>\n<0038><003A><09A1>\nendbfrange"


def test_cmap():
    spaces, codes = cmap.parse_cmap(CMAP)
    assert spaces == [(0, 0xFFFF, 2)]
    assert codes == {3: [0x20], 0x1B: [0x981], 0x1E: [0x985], 0x1F: [0x986], 0x20: [0x987], 0x38: [0x9A1], 0x39: [0x9A2], 0x3A: [0x9A3]}
    assert cmap.lookup(codes, 0x9999) == "�"
    arrays = cmap.parse_cmap(b"begincodespacerange <00><FF> endcodespacerange beginbfrange <01><02>[<0041><00420043>] endbfrange")[1]
    assert arrays == {1: [0x41], 2: [0x42, 0x43]}
    for bad in (b"", CMAP.replace(b"<0020><0985>", b"<0020><FFFF>"), CMAP.replace(b"<0981>", b"<098>")):
        with pytest.raises(syntax.SyntaxFault):
            cmap.parse_cmap(bad)


def test_tounicode():
    assert cmap.parse_tounicode(b"1 beginbfchar\n<0122> <09A8 09CD 09A4>\nendbfchar") == {0x122: "ন্ত"}
    assert cmap.parse_tounicode(CMAP)[0x3A] == "ণ"
    assert cmap.parse_tounicode(b"beginbfrange\n<05> <03> <0041>\n<01> <02> [<0041> <0042>]\nendbfrange") == {1: "A", 2: "B"}


def test_streams():
    x = b"some bytes\r\n"
    for filters, data in (("/Filter/FlateDecode", zlib.compress(x)), ("/Filter /Fl", zlib.compress(x)), ("/Filter [/FlateDecode /Fl]", zlib.compress(zlib.compress(x)))):
        body = f"<<{filters} /Length {len(data)}>>stream\n".encode() + data + b"\nendstream"
        assert pdf.decoded(body) == (x, None)
    assert pdf.decoded(b"<< /A 1 >>") == (None, None)
    assert "unsupported" in pdf.decoded(b"<</Filter /DCTDecode>>stream\nx\nendstream")[1]
    broken = b"<</Filter /FlateDecode>>stream\nnot deflate\nendstream"
    assert pdf.decoded(broken)[0] is None and pdf.decoded(broken, "raw")[0] == b"not deflate"
    with pytest.raises(syntax.SyntaxFault):
        pdf.decoded(broken, "fail")


def test_cross_references():
    data = writer.file_of({1: b"<< /Type /Catalog >>", 2: b"<< /ToUnicode 3 0 R >>", 3: b"<< /Length 3 >>\nstream\nabc\nendstream"})
    entries = pdf.xref_entries(data)
    assert [(n, used) for n, _, _, used in entries] == [(0, False), (1, True), (2, True), (3, True)]
    assert entries[1][2] == data.index(b"1 0 obj")
    assert pdf.object_at(data, entries[3][2])[3] == b"abc" and b"/Root" in pdf.trailer(data)
    for bad, said in ((b"not a pdf", "PDF header"), (b"%PDF-1.5\n\n           1 0 obj<<>>endobj startxref 20", "xref stream"), (b"%PDF-1.4", "startxref")):
        with pytest.raises(syntax.SyntaxFault, match=said):
            pdf.xref_entries(bad)


@settings(max_examples=60, deadline=None)
@given(st.recursive(st.one_of(st.integers(0, 10**6), st.booleans(), st.none(), st.binary(max_size=8)), lambda c: st.lists(c, max_size=4), max_leaves=12))
def test_values_survive_writing(v):
    def write(x):
        if isinstance(x, list):
            return b"[" + b" ".join(map(write, x)) + b"]"
        if isinstance(x, bytes):
            return b"<" + x.hex().encode() + b">"
        return {True: b"true", False: b"false", None: b"null"}[x] if x is None or isinstance(x, bool) else b"%d" % x

    def plain(x):
        return [plain(i) for i in x[1]] if x[0] == "array" else x[1]

    assert plain(syntax.parse_value(write(v))) == v
