"""Decoding PDFs as they arrive.

Each micro-batch is decoded with the learned glyphs as they stand when it starts,
so glyphs confirmed meanwhile count from the next batch on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import pages

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, glob: str = "*.pdf", files_at_once: int = 1000) -> DataFrame:
    rows = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_at_once).load(path)
    return rows.select(F.col("path").alias("pdf_id"), "length", "content")


def decode_arriving(files: DataFrame, out: str, checkpoint: str, glyphs: Callable[[], DataFrame] | None = None, preset: str = "documented", once: bool = True) -> StreamingQuery:
    """Writes ``pdf_id, text, n_pages`` to ``out/batch=<n>``; a batch that is repeated replaces its own output."""

    def batch(rows: DataFrame, number: int) -> None:
        texts = pages.document_texts(rows, glyphs=glyphs() if glyphs else None, preset=preset)
        texts.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
