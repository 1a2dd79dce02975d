"""PDF files as tables: objects, streams, and the strict reader's cross-references.

A file is one row; each function below is a table function from rows of bytes to
rows, run next to the scan on Arrow batches. Columns that a later step doesn't
need are not carried.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.syntax import SyntaxFault, as_json, get, hex_bytes, parse_indirect, parse_value, tokens

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\s*(.*?)\s*endobj", re.S)
_STREAM = re.compile(rb"stream(?:\r\n|\n|\r)")

#: A table function hands on what it has made after so many bytes of its column, or so many rows: a worker never holds a whole batch's.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 4096


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """``pdf_id, length, content`` of every file under ``path``; the id is its path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("pdf_id"), "length", "content")


def expand(rows: DataFrame, column: str, keep: list[str], schema: T.StructType, make: Callable[[bytes], list[tuple]]) -> DataFrame:
    """A table function: ``keep`` columns of each row beside every row that ``make`` finds in ``column``."""
    given = rows.select(*keep, F.col(column).alias("__bytes"))
    kinds = [pa.field(f.name, _arrow(f.dataType)) for f in schema.fields]

    def table(batch: pa.RecordBatch, at: list[int], out: list[tuple]) -> pa.RecordBatch:
        kept = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(keep))]
        made = [pa.array([r[k] for r in out], kinds[k].type) for k in range(len(kinds))]
        return pa.RecordBatch.from_arrays([*kept, *made], names=[*keep, *(k.name for k in kinds)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out, taken = [], [], 0
            for i, b in enumerate(batch.column(len(keep))):
                if not b.is_valid:
                    continue
                data = b.as_py()
                rows = make(data)
                at += [i] * len(rows)
                out += rows
                taken += len(data)
                if taken >= SLICE_BYTES or len(out) >= SLICE_ROWS:
                    yield table(batch, at, out)
                    at, out, taken = [], [], 0
            if out:
                yield table(batch, at, out)

    return given.mapInArrow(work, T.StructType([*given.schema.fields[:-1], *schema.fields]))


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def ddl(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def find_objects(content: bytes) -> list[tuple[int, int, int, bytes]]:
    return [(int(m[1]), int(m[2]), n, m[3]) for n, m in enumerate(_OBJECT.finditer(content))]


def pdf_objects(files: DataFrame) -> DataFrame:
    """``pdf_id, obj_num, gen, seq, body`` of every object in file order."""
    return expand(files, "content", ["pdf_id"], ddl("obj_num long, gen long, seq long, body binary"), find_objects)


def latest_objects(objects: DataFrame) -> DataFrame:
    """One body for each object number: the last definition wins, whatever its generation."""
    return objects.groupBy("pdf_id", "obj_num").agg(F.max_by("body", "seq").alias("body"))


# --- streams


def raw_stream(body: bytes) -> tuple[bytes, bytes] | None:
    """(dictionary, bytes) of a stream body, by its ``/Length`` where that fits and by ``endstream`` otherwise."""
    m = _STREAM.search(body)
    if m is None:
        return None
    head = body[: m.start()]
    n = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
    if n and re.match(rb"\s*endstream", body[m.end() + int(n[1]) :]):
        return head, body[m.end() : m.end() + int(n[1])]
    end = body.rfind(b"endstream")
    return head, (body[m.end() : end] if end >= 0 else body[m.end() :]).rstrip(b"\r\n")


def filters_of(head: bytes) -> list[str]:
    m = re.search(rb"/Filter\s*(\[[^\]]*\]|/[A-Za-z0-9]+)", head)
    return [x.decode("latin-1") for x in re.findall(rb"/([A-Za-z0-9]+)", m[1])] if m else []


def decode_filters(data: bytes, filters: list[str]) -> bytes:
    """Filters in order; only deflate is known."""
    for f in filters:
        if f not in ("FlateDecode", "Fl"):
            raise SyntaxFault(f"unsupported filter {f}")
        try:
            data = zlib.decompress(data)
        except zlib.error as e:
            raise SyntaxFault(f"broken deflate stream: {e}") from e
    return data


def decoded(body: bytes | None, on_error: str = "null") -> tuple[bytes | None, str | None]:
    """(bytes, error) of a stream body. ``on_error``: ``null``, ``raw`` keeps the bytes as they are, ``fail`` raises."""
    found = raw_stream(body) if body is not None else None
    if found is None:
        return None, None
    head, data = found
    try:
        return decode_filters(data, filters_of(head)), None
    except SyntaxFault as e:
        if on_error == "fail":
            raise
        return (data if on_error == "raw" else None), str(e)


def pdf_streams(objects: DataFrame, keep: list[str] | None = None, on_error: str = "null") -> DataFrame:
    """``decoded`` and ``error`` beside ``keep`` for each row of ``objects`` whose body is a stream. Filter to the objects that are needed first."""

    def make(body: bytes) -> list[tuple]:
        out = decoded(body, on_error)
        return [] if out == (None, None) else [out]

    return expand(objects, "body", keep or ["pdf_id", "obj_num"], ddl("decoded binary, error string"), make)


def expand_streams(objects: DataFrame, keep: list[str], schema: T.StructType, make: Callable[[bytes], list[tuple]]) -> DataFrame:
    """``expand`` over what the streams of ``objects`` hold, inflated and read in one pass; a broken one gives nothing."""

    def opened(body: bytes) -> list[tuple]:
        data = decoded(body)[0]
        return [] if data is None else make(data)

    return expand(objects, "body", keep, schema, opened)


# --- strict reading


def header_ok(content: Column) -> Column:
    return F.coalesce(F.startswith(content, F.lit(b"%PDF-")), F.lit(False))


def find_startxref(content: bytes) -> int:
    at = content.rfind(b"startxref")
    if at < 0:
        raise SyntaxFault("no startxref")
    m = re.compile(rb"\s*(\d+)").match(content, at + 9)
    if m is None:
        raise SyntaxFault("startxref without an offset")
    if int(m[1]) >= len(content):
        raise SyntaxFault("startxref points outside the file")
    return int(m[1])


def xref_entries(content: bytes) -> list[tuple[int, int, int, bool]]:
    """(number, generation, offset, in use) of a traditional table; the later entry for one (number, generation) wins."""
    if not content.startswith(b"%PDF-"):
        raise SyntaxFault("no PDF header")
    at = find_startxref(content)
    m = re.compile(rb"\s*xref\s+").match(content, at)
    if m is None:
        raise SyntaxFault("an xref stream, which isn't supported" if re.compile(rb"\s*\d+\s+\d+\s+obj").match(content, at) else "no xref table at startxref")
    out, at = {}, m.end()
    head, entry = re.compile(rb"\s*(\d+)[ \t]+(\d+)[ \t]*(?:\r\n|\r|\n)"), re.compile(rb"\s*(\d{1,10})[ \t]+(\d{1,5})[ \t]+([nf])")
    while (h := head.match(content, at)) is not None:
        at = h.end()
        for k in range(int(h[2])):
            e = entry.match(content, at)
            if e is None:
                raise SyntaxFault(f"broken xref entry at {at}")
            out[int(h[1]) + k, int(e[2])] = (int(e[1]), e[3] == b"n")
            at = e.end()
    return [(n, g, o, used) for (n, g), (o, used) in out.items()]


def trailer(content: bytes) -> bytes:
    m = re.compile(rb"trailer\s*(<<.*?>>)", re.S).search(content, find_startxref(content) if content.startswith(b"%PDF-") else 0)
    if m is None:
        raise SyntaxFault("no trailer")
    return m[1]


def xref_table(files: DataFrame, strict: bool = True) -> DataFrame:
    """``pdf_id, obj_num, gen, offset, in_use, error``; a file that breaks the rules raises, or gives one row with its error."""

    def make(content: bytes) -> list[tuple]:
        try:
            return [(*e, None) for e in xref_entries(content)]
        except SyntaxFault as fault:
            if strict:
                raise
            return [(None, None, None, None, str(fault))]

    return expand(files, "content", ["pdf_id"], ddl("obj_num long, gen long, offset long, in_use boolean, error string"), make)


def object_at(content: bytes, offset: int) -> tuple[int, int, tuple, bytes | None]:
    """(number, generation, value, stream bytes) of the object at ``offset``; streams are cut by their direct ``/Length``."""
    stream = None
    it = tokens(content, offset, comments=False)
    end = offset
    for t in it:
        if t.type == "eof":
            raise SyntaxFault(f"no endobj after {offset}")
        if t.type == "keyword" and t.value in (b"endobj", b"stream"):
            end = t.start
            stream = t if t.value == b"stream" else None
            break
    n, g, value = parse_indirect(content[offset:end] + b" endobj")
    if stream is None:
        return n, g, value, None
    length = get(value, "Length")
    if length is None or length[0] != "number":
        raise SyntaxFault(f"object {n}: the stream's length isn't given directly")
    start = stream.end + (2 if content[stream.end : stream.end + 2] == b"\r\n" else 1)
    data = content[start : start + length[1]]
    if not re.compile(rb"\s*endstream\s+endobj").match(content, start + length[1]):
        raise SyntaxFault(f"object {n}: its length doesn't lead to endstream")
    return n, g, value, data


def resolved_objects(files: DataFrame) -> DataFrame:
    """Every object in use by the cross-reference table: ``pdf_id, obj_num, gen, kind, value, stream, error``.

    ``value`` is JSON for ``parse_json``; an entry that leads to another object is an error.
    """

    def make(content: bytes) -> list[tuple]:
        out = []
        try:
            entries = xref_entries(content)
        except SyntaxFault as fault:
            return [(None, None, None, None, None, str(fault))]
        for n, g, offset, used in entries:
            if not used:
                continue
            try:
                n2, g2, value, data = object_at(content, offset)
                if (n2, g2) != (n, g):
                    raise SyntaxFault(f"entry {n} {g} leads to {n2} {g2}")
                filters = get(value, "Filter")
                names = [] if filters is None else [x[1].decode() for x in (filters[1] if filters[0] == "array" else [filters])]
                out.append((n, g, "stream" if data is not None else value[0], as_json(value), None if data is None else decode_filters(data, names), None))
            except SyntaxFault as fault:
                out.append((n, g, None, None, None, str(fault)))
        return out

    return expand(files, "content", ["pdf_id"], ddl("obj_num long, gen long, kind string, value string, stream binary, error string"), make)


def require(entries: DataFrame, obj_num: int, gen: int = 0) -> DataFrame:
    """The entry of one object; raises if it is free, gives no row if it is absent."""
    found = entries.filter((F.col("obj_num") == obj_num) & (F.col("gen") == gen))
    return found.withColumn("offset", F.when(F.col("in_use"), F.col("offset")).otherwise(F.raise_error(F.lit(f"object {obj_num} {gen} is free")).cast("long")))


def pdf_tokens(rows: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """``type, value, start, end`` of every token; a fault ends the list with a row of type ``error``."""

    def make(data: bytes) -> list[tuple]:
        out = []
        try:
            for t in tokens(data):
                value = t.value.decode("latin-1") if isinstance(t.value, bytes) else None if t.value is None else str(t.value)
                out.append((t.type, value, t.start, t.end))
        except SyntaxFault as fault:
            out.append(("error", str(fault), len(data), len(data)))
        return out

    return expand(rows, column, keep, ddl("type string, value string, start long, end long"), make)


@pandas_udf(T.StringType())
def value_json(data):
    """A value's JSON for ``parse_json``; null for bytes that aren't one value."""

    def one(b):
        try:
            return None if b is None else as_json(parse_value(bytes(b)))
        except SyntaxFault:
            return None

    return data.map(one)


@pandas_udf(T.BinaryType())
def bytes_of_hex(data):
    """Hexadecimal text to bytes, white space allowed, an odd digit padded on the right."""
    return data.map(lambda s: None if s is None else hex_bytes(s.encode("latin-1")))


# --- lookups over objects


def one_object(objects: DataFrame, obj_num: int) -> DataFrame:
    """The rows of one object number."""
    return objects.filter(F.col("obj_num") == obj_num)


def font_objects(objects: DataFrame) -> DataFrame:
    """Objects whose body says ``/Type /Font``, descriptors included."""
    return objects.filter(F.instr(F.decode("body", "ISO-8859-1"), "/Type /Font") > 0)


def stream_objects(objects: DataFrame, on_error: str = "raw") -> DataFrame:
    """``pdf_id, obj_num, decoded, error`` of objects with a stream that isn't empty; what can't be inflated stays as it is."""
    return pdf_streams(objects, on_error=on_error).filter(F.octet_length("decoded") > 0)


def cmap_objects(objects: DataFrame) -> DataFrame:
    """Streams that hold a character map."""
    return stream_objects(objects).filter(F.instr(F.decode("decoded", "ISO-8859-1"), "begincmap") > 0)


def of_kind(resolved: DataFrame, kind: str) -> DataFrame:
    """Rows of ``resolved_objects`` that are of a kind, as ``dict`` or ``stream``; a row of another raises."""
    wrong = F.raise_error(F.format_string(f"object %d is no {kind}", F.col("obj_num"))).cast("string")
    return resolved.withColumn("kind", F.when(F.col("kind") == kind, F.col("kind")).otherwise(wrong))
