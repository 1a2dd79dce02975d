"""From objects to pages, fonts and content: field access and reference joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: References are followed so many times at most: joins of the chain with itself, and steps.
DOUBLINGS = 3
DEPTH = 2**DOUBLINGS
WHOLE_REF = r"^\s*\[?\s*(\d+)\s+\d+\s+R\s*\]?\s*$"


def latin(body: Column) -> Column:
    return F.decode(body, "ISO-8859-1")


def field(text: Column, key: str) -> Column:
    """The first value of ``/key``: an array, a dictionary up to its first ``>>``, a reference, a name or a number; null if there is none."""
    pattern = rf"(?s)/{key}(?![A-Za-z0-9])\s*(\[.*?\]|<<.*?>>|\d+\s+\d+\s+R|/[^\s/<>\[\]()]+|[-+]?[.\d]+)"
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def first_ref(value: Column) -> Column:
    """The object number of a value that is one reference, or an array of one."""
    return F.nullif(F.regexp_extract(value, WHOLE_REF, 1), F.lit("")).cast("long")


def all_refs(value: Column) -> Column:
    return F.transform(F.regexp_extract_all(value, F.lit(r"(\d+)\s+\d+\s+R"), F.lit(1)), lambda x: x.cast("long"))


def reference_edges(objects: DataFrame) -> DataFrame:
    """``pdf_id, obj_num, to`` of objects whose body is a reference."""
    return objects.select("pdf_id", "obj_num", first_ref(latin(F.col("body"))).alias("to")).filter("to is not null")


def resolved(objects: DataFrame, doublings: int = DOUBLINGS, edges: DataFrame | None = None) -> DataFrame:
    """``objects`` with each body that is a reference replaced by the body that it leads to.

    Only such objects take part in the self-joins, as pairs of numbers; every join
    doubles the steps taken, so three of them follow up to ``2 ** 3`` references. A
    missing object gives a null body; after the last step the body reached stands.
    ``edges`` are the objects' ``reference_edges``, if they are at hand: each join reads them again.
    """
    edges = reference_edges(objects) if edges is None else edges
    for _ in range(doublings):
        jump = edges.select("pdf_id", F.col("obj_num").alias("to"), F.col("to").alias("beyond"))
        edges = edges.join(jump, ["pdf_id", "to"], "left").select("pdf_id", "obj_num", F.coalesce("beyond", "to").alias("to"))
    there = edges.join(objects.select("pdf_id", F.col("obj_num").alias("to"), F.col("body").alias("there")), ["pdf_id", "to"], "left").select("pdf_id", "obj_num", "to", "there")
    both = objects.join(there, ["pdf_id", "obj_num"], "left")
    return both.select("pdf_id", "obj_num", F.when(F.col("to").isNotNull(), F.col("there")).otherwise(F.col("body")).alias("body"))


def follow(rows: DataFrame, start: str, bodies: DataFrame, out: str) -> DataFrame:
    """``rows`` with ``out``, the body of the object ``start`` in ``bodies``, which are resolved; null if there is none."""
    return rows.join(bodies.select("pdf_id", F.col("obj_num").alias(start), F.col("body").alias(out)), ["pdf_id", start], "left")


def reference_chain(edges: DataFrame, roots: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``root, node, d`` of every node met from ``roots(root)`` over ``edges(src, dst)``, ``depth`` steps at most: a recursive self-join, unrolled."""
    level = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("d"))
    out = level
    for d in range(1, depth + 1):
        level = level.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), F.lit(d).alias("d"))
        out = out.unionAll(level)
    return out


def pages(objects: DataFrame) -> DataFrame:
    """``pdf_id, page_no, obj_num, body``: page objects numbered by object number."""
    found = objects.filter(latin(F.col("body")).rlike(r"/Type\s*/Page[\s/>]"))
    return found.select("pdf_id", F.row_number().over(Window.partitionBy("pdf_id").orderBy("obj_num")).alias("page_no"), "obj_num", "body")


def one_page(all_pages: DataFrame, page: Column) -> DataFrame:
    """Rows of one page of each file; raises for a file that doesn't have it."""
    w = Window.partitionBy("pdf_id")
    last = F.max("page_no").over(w)
    checked = all_pages.withColumn("__last", last).withColumn("page_no", F.when(page.between(1, F.col("__last")), F.col("page_no")).otherwise(F.raise_error(F.format_string("page %d outside 1..%d", page, F.col("__last"))).cast("int")))
    return checked.filter(F.col("page_no") == page).drop("__last")


def content_refs(all_pages: DataFrame) -> DataFrame:
    """``pdf_id, page_no, content_ord, content_object`` in the order of ``/Contents``."""
    refs = all_refs(field(latin(F.col("body")), "Contents"))
    return all_pages.select("pdf_id", "page_no", F.posexplode(refs).alias("content_ord", "content_object"))


_EDGE = re.compile(r"<<|>>")


def balanced(text: str | None, key: str) -> str | None:
    """The dictionary after ``/key`` with all that is nested in it."""
    if text is None or (m := re.search(rf"/{key}(?![A-Za-z0-9])\s*(?=<<)", text)) is None:
        return None
    depth = 0
    for e in _EDGE.finditer(text, m.end()):
        depth += 1 if e[0] == "<<" else -1
        if not depth:
            return text[m.end() : e.end()]
    return None


@pandas_udf(T.StringType())
def resources_text(text):
    return text.map(lambda t: balanced(t, "Resources"))


def page_resources(all_pages: DataFrame, bodies: DataFrame) -> DataFrame:
    """``pdf_id, page_no, resources``: the page's own dictionary or the one that it refers to; none is inherited."""
    text = latin(F.col("body"))
    own = all_pages.select("pdf_id", "page_no", resources_text(text).alias("own"), first_ref(field(text, "Resources")).alias("ref"))
    return follow(own, "ref", bodies, "there").select("pdf_id", "page_no", F.coalesce("own", latin(F.col("there"))).alias("resources"))


def font_entries(resources: DataFrame) -> DataFrame:
    """``pdf_id, page_no, font_ord, resource, font_object``: fonts in order, each object once; without a ``/Font`` dictionary every named reference counts.

    A dictionary counts up to 10,000 characters, as in the program whose results
    are matched; where a longer one's end isn't found, every named reference counts.
    """
    block = F.regexp_extract("resources", r"(?s)/Font\s*<<(.{0,10000}?)>>", 1)
    named = F.when(block != "", block).otherwise(F.col("resources"))
    pairs = F.zip_with(
        F.regexp_extract_all(named, F.lit(r"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R"), F.lit(1)),
        F.regexp_extract_all(named, F.lit(r"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R"), F.lit(2)),
        lambda n, o: F.struct(n.alias("resource"), o.cast("long").alias("font_object")),
    )
    rows = resources.filter("resources is not null").select("pdf_id", "page_no", F.posexplode(pairs).alias("font_ord", "f")).select("pdf_id", "page_no", "font_ord", "f.*")
    first = F.row_number().over(Window.partitionBy("pdf_id", "page_no", "font_object").orderBy("font_ord"))
    return rows.withColumn("__n", first).filter("__n = 1").drop("__n")


def font_info(entries: DataFrame, objects: DataFrame, bodies: DataFrame) -> DataFrame:
    """Entries with ``base_font, encoding, descendant_font, font_descriptor, font_file2, tounicode``: font to descendant to descriptor to file, by joins."""
    fonts = entries.select("pdf_id", "font_object").distinct()
    body = lambda c: latin(F.col(c))
    name = lambda c, k: F.ltrim(field(body(c), k), F.lit("/"))
    a = follow(fonts, "font_object", bodies, "b")
    a = a.select("pdf_id", "font_object", name("b", "BaseFont").alias("base_font"), name("b", "Encoding").alias("encoding"), first_ref(field(body("b"), "ToUnicode")).alias("tounicode"), first_ref(field(body("b"), "DescendantFonts")).alias("d0"), first_ref(field(body("b"), "FontDescriptor")).alias("own"))
    # the descendants may be an array object of their own
    one = objects.select("pdf_id", F.col("obj_num").alias("d0"), first_ref(latin(F.col("body"))).alias("via"))
    a = a.join(one, ["pdf_id", "d0"], "left").select("*", F.coalesce("via", "d0").alias("descendant_font")).drop("d0", "via")
    a = follow(a, "descendant_font", bodies, "b").withColumn("font_descriptor", F.coalesce(first_ref(field(body("b"), "FontDescriptor")), F.col("own"))).drop("b", "own")
    a = follow(a, "font_descriptor", bodies, "b").withColumn("font_file2", first_ref(field(body("b"), "FontFile2"))).drop("b")
    return entries.join(a, ["pdf_id", "font_object"], "left")
