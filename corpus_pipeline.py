"""From raw documents to packed training sequences.

Toxic documents go, of near duplicates one stays, secrets are blanked out, sources
are interleaved by target weight, and the result is packed. ``STAGES`` are applied
one after the other; each reads the Parquet files that the one before wrote. The
mixed order is the order of rows in those files, which packing follows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lipikar.llm import mixing, neardup, packing, secrets, toxicity
from lipikar.llm.common import clear_stored, drop_stored, fresh, remainder, stored, stored_so_far, table
from lipikar.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose score stays below the threshold.

    The model learns from labels and ``documents`` as operator 6's query does.
    Null and empty texts are scored as texts without evidence, repeated rows alike;
    nulls in other columns, an empty table and any columns are passed on as they are.
    """
    params = toxicity.ToxicityParams()
    learned = table(spark, sf_dir, "labels").filter(remainder(F.col("doc_id"), 3) != 1)
    model = toxicity.fit_toxicity(table(spark, sf_dir, "documents"), learned, params)
    score, evidence = fresh(docs, "toxic_score", "toxic_evidence")
    scored = toxicity.score_toxicity(docs, model, names=(score, evidence))
    return scored.filter(F.col(score) < params.threshold).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the least id.

    Null and empty texts are one class; of rows that repeat id and text one stays;
    a null id counts after all others. Other columns are passed on as they are, an
    empty table stays empty.
    """
    return neardup.deduplicate(docs)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text becomes a mark; ``n_chars``, where there is such a column, follows the text.

    A null text stays null, with its ``n_chars``; rows and other columns stay as they are.
    """
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    n = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.withColumn("n_chars", n).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, file by file in the order of the mix.

    A null source is a source of its own; null ids and texts and repeated rows are
    rows like any other; columns stay as they are, an empty table stays empty.
    """
    return mixing.in_mixed_order(docs)


def file_order(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__file`` and ``__row``, the place of each row in the files it was read from; by id, nulls first, where it wasn't."""
    try:
        return docs.select("*", F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return docs.select("*", F.lit(0).cast("long").alias("__file"), F.col("doc_id").cast("long").alias("__row"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, one row for each piece of a document, packed in the order of the mix.

    A null or empty text is its end mark alone; null ids and repeated rows are
    documents like any other. An empty table gives no pieces; other columns don't
    come out.
    """
    placed = file_order(docs)
    return packing.pack_documents(placed, tokenizer_path(), order=[F.col("__file"), F.col("__row")])


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("secrets", blank_secrets), ("mixing", mix), ("packing", pack)]

#: The first stage learns a model and the second samples: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result; what a stage leaves behind goes once its rows are written, but for what the last one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = stored_so_far()
        now = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        clear_stored(spark, before, keep=(now,))
        drop_stored(docs)
        docs = now
    return STAGES[-1][1](spark, docs, sf_dir)
