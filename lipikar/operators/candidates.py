"""Conjunct candidates: curated ones and all pairs and triples of consonants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.script import CONSONANTS, VIRAMA

# Consonants that stand second and third in generated triples.
TAIL = "করগঘলমযরবভশষসতদনপফ"


def letters(spark: SparkSession, values: str, name: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in dict.fromkeys(values)], f"{name} string")


def generate(spark: SparkSession, curated: DataFrame, generated: bool = True) -> DataFrame:
    """``text``, each once. The generated part joins three fixed alphabets: ten thousand rows, whatever the data."""
    if not generated:
        return curated.select("text").distinct().orderBy("text")
    first = CONSONANTS[:32]
    v = F.lit(VIRAMA)
    a, b, c = letters(spark, first, "a"), letters(spark, first, "b"), letters(spark, TAIL, "c")
    pairs = a.crossJoin(b).select(F.concat("a", v, "b").alias("text"))
    triples = a.crossJoin(letters(spark, TAIL, "b")).crossJoin(c).select(F.concat("a", v, "b", v, "c").alias("text"))
    return curated.select("text").union(pairs).union(triples).distinct().orderBy(F.length("text"), "text")
