"""``python -m lipikar FILES``: texts and reports of PDF files, on a local session."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F


def main(args: list[str] | None = None) -> int:
    """0: done; 1: failed; 2: codes stay unresolved."""
    p = argparse.ArgumentParser(prog="lipikar")
    p.add_argument("pdf", help="a file or a folder")
    p.add_argument("--page", type=int, help="one page only")
    p.add_argument("--mapping", help="JSON of base font to code to text")
    p.add_argument("--learned", help="JSON of learned glyphs")
    p.add_argument("--corrections", help="JSON of wrong to right")
    p.add_argument("--preset", default="documented", choices=["documented", "reference_text", "reference_report", "extract", "review"])
    p.add_argument("--text", help="write texts to this folder")
    p.add_argument("--json", help="write page reports to this folder")
    p.add_argument("--dump", help="write pictures of unresolved glyphs to this folder")
    p.add_argument("--profile", action="store_true", help="say how long each stage takes")
    p.add_argument("--generate-ttf", help="write a font with the confirmed mappings")
    a = p.parse_args(args)

    from .operators import decode, learned, resolve
    from .plans import pages, pictures
    from .session import local_session
    from .sources import mappings, pdf, sinks

    spark = local_session()
    try:
        read = lambda path: mappings.whole_text(spark, path)
        legacy = mappings.legacy_mapping(read(a.mapping)) if a.mapping else None
        glyphs = mappings.learned_glyphs(read(a.learned)) if a.learned else None
        own = mappings.read_corrections(read(a.corrections)) if a.corrections else None
        files = pdf.read_files(spark, a.pdf, "*")
        if a.profile:
            print(json.dumps({k: round(v, 3) for k, v in pages.stage_seconds(files, legacy, glyphs, a.preset, own).items()}), file=sys.stderr)
        parts = pages.read_parts(files)
        if a.page:
            parts.pages = resolve.one_page(parts.pages, F.lit(a.page))
            parts.codes = parts.codes.filter(F.col("page_no") == a.page)
            parts.ops = parts.ops.filter(F.col("page_no") == a.page)
        mapping = pages.effective_map(parts, legacy, glyphs, a.preset)
        texts = sinks.document_text(pages.page_texts(parts, mapping, own))
        missing = decode.missing_codes(parts.codes, mapping, [*pages.PAGE, "cid"])
        if a.text:
            sinks.write_text(texts, a.text)
        else:
            for r in texts.toLocalIterator():
                print(r["text"])
        if a.json:
            sinks.write_json(pages.page_reports(parts, mapping), a.json)
        if a.dump:
            keyed = parts.fonts.join(parts.ttf.select("pdf_id", "font_file2", "fkey"), ["pdf_id", "font_file2"])
            gids = missing.join(keyed.select(*pages.PAGE, "fkey"), pages.PAGE).select("fkey", F.col("cid").alias("gid")).distinct()
            pictures.glyph_pictures(parts.ttf, gids).write.mode("overwrite").json(a.dump)
        if a.generate_ttf:
            entries = learned.confirmed_entries(legacy if legacy is not None else spark.createDataFrame([], "cid int, text string, ord long"), glyphs if glyphs is not None else mappings.empty_learned(spark))
            font, counts = pages.generate_font(bytes(parts.ttf.orderBy("fkey").first()["ttf"]), entries)
            with open(a.generate_ttf, "wb") as f:
                f.write(font)
            print(json.dumps(counts), file=sys.stderr)
        return 2 if a.page and missing.take(1) else 0
    except Exception as e:  # the exit code tells
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
