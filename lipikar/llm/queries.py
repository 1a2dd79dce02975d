"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, katz, licenses, mixing, neardup, packing, secrets, sharding, topk, toxicity
from .common import remainder, table

N_SHARDS = 8


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizers' package keeps a file; LIPIKAR_TOKENIZER names another."""
    if own := os.environ.get("LIPIKAR_TOKENIZER"):
        return own
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def _sorted_spans(found: str) -> F.Column:
    return F.array_join(F.transform(F.col(found), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("secret_base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_sorted_spans("secret_base").cast("binary"), 256).alias("base_sha256"),
        _sorted_spans("secret_spans").alias("spans"),
    )


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), N_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "checked_links")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, params = table(spark, sf_dir, "documents"), toxicity.ToxicityParams()
    learned = table(spark, sf_dir, "labels").filter(remainder(F.col("doc_id"), 3) != 1)
    model = toxicity.fit_toxicity(docs, learned, params)
    scored = toxicity.score_toxicity(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), 3) == 1).alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= params.threshold).cast("int").alias("predicted"),
        F.array_join(F.transform("toxic_evidence", lambda e: e["doc_id"].cast("string")), ",").alias("evidence"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 10) == 0)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    label = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        label(base).alias("base_labels"),
        label(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: F.least(p["coverage"], F.lit(1.0)))), F.lit(0.0)).alias("score"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operator 2's contract fixes, for its SQL."""
    return op2_secrets(spark, sf_dir).drop("spans")


def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What operator 9's contract fixes, for its SQL."""
    return op9_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of operator 1 SQL can say: the edited texts, and which fingerprints must be equal."""
    found = op1_fingerprints(spark, sf_dir)
    return found.select("doc_id", "n_chars", "edited_sha256", (F.col("fingerprint") == F.col("edited_fingerprint")).alias("unchanged"), (F.col("near_next") == 1.0).alias("next_equal"))


def queries() -> dict:
    return {f.__name__: f for f in (base_secrets, base_licenses, base_fingerprints, op1_fingerprints, op2_secrets, op3_topk, op4_sharding, op5_neardup, op6_toxicity, op7_packing, op8_katz, op9_licenses, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": OP3, "op4_sharding": OP4, "base_secrets": BASE2, "base_licenses": BASE9, "base_fingerprints": BASE1}


OP3 = """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""


def _crc_table() -> str:
    """The 256 steps of CRC-32, from its polynomial."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(f"{c}::BIGINT")
    return f"[{', '.join(table)}]"


# doc_id is a key here, so the hash that orders equal keys isn't asked for.
OP4 = rf"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 1 AS BIGINT) AS size,
    list_transform(list_filter(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\1 ', 'g'), ' '), lambda x: x <> ''), lambda x: CAST('0x' || x AS BIGINT)) AS bytes
  FROM documents
), c AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda crc, b: xor(crc >> 8, {_crc_table()}[(xor(crc, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM d
), s AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS before, sum(size) OVER () AS total FROM c
), p AS (
  SELECT *, CAST(least(7, (2 * before + size) * 8 // (2 * total)) AS INTEGER) AS shard FROM s
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p
"""

_ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww](?:[Oo][Rr])?[Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _marked(kind: str, k: int, pattern: str) -> str:
    """A text cut before each match, with a mark behind it: both marks are for private use."""
    return f"SELECT doc_id, '{kind}' AS kind, {k} AS k, string_split(regexp_replace(text, '({pattern})', chr(57344) || '\\1' || chr(57345), 'g'), chr(57344)) AS parts FROM t"


BASE2 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS (
  {_marked("assign", 0, _ASSIGN)} UNION ALL {_marked("access", 1, "AKIA[A-Z0-9]+")} UNION ALL {_marked("hex", 2, "[0-9a-f]+")}
), u AS (
  SELECT doc_id, kind, k, generate_subscripts(parts, 1) AS i, unnest(parts) AS part FROM m
), y AS (
  SELECT *, sum(len(part) - CASE WHEN i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start FROM u
), z AS (
  SELECT doc_id, kind, k, CAST(start AS BIGINT) AS start, split_part(part, chr(57345), 1) AS hit FROM y WHERE i > 1
), f AS (
  SELECT * FROM z WHERE CASE kind WHEN 'assign' THEN len(regexp_extract(hit, '^{_ASSIGN}$', 1)) >= 6 WHEN 'access' THEN len(hit) >= 20 ELSE len(hit) >= 24 END
)
SELECT t.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || (start + len(hit)), ',' ORDER BY start, k) FILTER (WHERE kind IS NOT NULL), '')) AS base_sha256
FROM t LEFT JOIN f ON t.doc_id = f.doc_id GROUP BY t.doc_id
"""


def _places(phrase: str) -> str:
    words = phrase.split()
    return f"list_transform(list_filter(range(1, len(w) - {len(words) - 2}), lambda i: w[i:i + {len(words) - 1}] = {words!r}), lambda i: i - 1)"


BASE9 = rf"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), h AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, {_places("under the mit license")} AS mit, {_places("apache license version 2")} AS apache, {_places("cc by nc")} AS cc FROM d
)
SELECT doc_id, n_words, CAST(len(mit) + len(apache) + len(cc) AS BIGINT) AS n_base, least(list_min(mit), list_min(apache), list_min(cc)) AS first_word,
  greatest(list_max(mit), list_max(apache), list_max(cc)) AS last_word,
  concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache-2' END, CASE WHEN len(cc) > 0 THEN 'cc-by-nc' END, CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels
FROM h
"""

BASE1 = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), n AS (
  SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS following FROM t
), e AS (
  SELECT *, substring(text, 1, len(text) - len(text) // 2) || substring(following, 1, len(text) // 2) AS edited FROM n
)
SELECT doc_id, len(text) AS n_chars, sha256(edited) AS edited_sha256, edited = text AS unchanged, following = text AS next_equal FROM e
"""
