"""Pictures of glyphs, for reviewing what no mapping knows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import truetype
from ..sources import pdf, sinks


def glyph_pictures(ttf: DataFrame, gids: DataFrame) -> DataFrame:
    """``fkey, gid, svg`` for the distinct ``gids(fkey, gid)`` of each font."""
    wanted = gids.groupBy("fkey").agg(F.array_sort(F.collect_set("gid")).alias("gids"))
    rows = ttf.dropDuplicates(["fkey"]).join(wanted, "fkey")
    packed = rows.select("fkey", F.concat(F.encode(F.to_json("gids"), "UTF-8"), F.lit(b"\n"), F.col("ttf")).alias("b"))

    def make(data: bytes) -> list[tuple]:
        import json

        head, _, body = data.partition(b"\n")
        try:
            font = truetype.Font(body)
        except truetype.FontFault:
            return []
        return [(g, truetype.glyph_svg(font, g)) for g in json.loads(head) if 0 <= g < font.count]

    return pdf.expand(packed, "b", ["fkey"], pdf.ddl("gid int, svg string"), make)


def review_pages(ttf: DataFrame, lines: DataFrame) -> DataFrame:
    """``fkey, gid, html``: the line of glyphs ``lines(fkey, gid, cids, label)`` with the one in question in colour."""
    rows = ttf.dropDuplicates(["fkey"]).select("fkey", "ttf").join(lines, "fkey")
    head = F.encode(F.to_json(F.struct("gid", "cids")), "UTF-8")
    packed = rows.select("fkey", "gid", "label", F.concat(head, F.lit(b"\n"), F.col("ttf")).alias("b"))

    def make(data: bytes) -> list[tuple]:
        import json

        head, _, body = data.partition(b"\n")
        asked = json.loads(head)
        try:
            return [(truetype.line_svg(truetype.Font(body), asked["cids"], asked["gid"]),)]
        except truetype.FontFault:
            return []

    drawn = pdf.expand(packed, "b", ["fkey", "gid", "label"], pdf.ddl("svg string"), make)
    title = sinks.html_escape(F.col("label"))
    return drawn.select("fkey", "gid", F.concat(F.lit('<!doctype html><meta charset="utf-8"><title>'), title, F.lit("</title><body><h1>"), title, F.lit("</h1>"), F.col("svg"), F.lit("</body>")).alias("html"))
