"""One query for each operator, over whole tables, and the SQL where SQL can express it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontam, fingerprint, history, lm_scores, mixing, near_dedup, nearest, quality, sharding, substring_dedup, suffix_dedup, tokens
from .core import documents, prepare


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve_index")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{prepare(spark)}/token_ids-{uuid.uuid4().hex}"
    tokens.write_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end=2, folder=folder)
    return tokens.read_tokens(*tokens.open_tokens(spark, folder))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scores.backoff_scores(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 4).alias("mean_log_score"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = quality.scored(docs, model)
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.near_duplicates(documents(spark, sf_dir), shingle=2)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir)).select("doc_id", "n_removed", "removed_bytes", "kept_sha256")


def op11_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), "embedding")
    return nearest.nearest(vectors, vectors.where("id % 100 = 0"), k=10)


def op12_dimension_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = history.versions(history.document_changes(documents(spark, sf_dir)))
    return out.select(F.col("key").alias("doc_id"), "version", "valid_from", "valid_to", "value")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = alignment.aligned(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_suffix_dedup, op3_hilbert_shards, op4_token_files, op5_decontaminate, op6_backoff_scores, op7_fingerprints, op8_quality, op9_near_duplicates, op10_substring_dedup, op11_nearest_vectors, op12_dimension_history, op13_token_alignment)}

ORACLE_SQL = {
    "op6_backoff_scores": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
t AS (SELECT doc_id, unnest(ws) AS w, unnest(list_prepend('', ws[:-2])) AS p FROM w WHERE len(ws) > 0),
tf AS (SELECT doc_id, p, w, count(*) AS n FROM t GROUP BY ALL),
own AS (SELECT doc_id, p, count(*) AS n FROM t GROUP BY ALL),
c2 AS (SELECT p, w, count(*) AS n FROM t GROUP BY ALL),
cp AS (SELECT p, count(*) AS n FROM t GROUP BY ALL),
c1 AS (SELECT w, count(*) AS n FROM t GROUP BY ALL),
s AS (
  SELECT tf.doc_id, sum(tf.n * CASE WHEN c2.n > tf.n THEN ln((c2.n - tf.n) / (cp.n - own.n)) ELSE ln(0.4 * c1.n / (SELECT count(*) FROM t)) END) AS s
  FROM tf JOIN own USING (doc_id, p) JOIN c2 USING (p, w) JOIN cp USING (p) JOIN c1 USING (w) GROUP BY tf.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(s.s, 0), 3) AS log_score, round(CASE WHEN len(ws) > 0 THEN coalesce(s.s, 0) / len(ws) ELSE 0 END, 4) AS mean_log_score FROM w LEFT JOIN s USING (doc_id)
""",
    # Day by day, and every change held against every day: the query works on boundaries instead.
    "op12_dimension_history": r"""
WITH one AS (SELECT doc_id AS d, max(source) AS source FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
h AS (SELECT d, j, source, CAST('0x' || substr(sha256(d || ':' || j), 1, 12) AS BIGINT) AS h FROM one, (VALUES (0), (1)) AS js(j)),
c AS (
  SELECT d - d % 10 AS k, source, h % 60 AS start, (h // 1000) % 10 AS kind,
         row_number() OVER (ORDER BY h, d, j) AS arrived FROM h),
days AS (SELECT k, day FROM (SELECT DISTINCT k FROM c), (SELECT unnest(generate_series(0, 70)) AS day)),
b AS (
  SELECT k, day, arg_max({'v': source, 'gone': kind < 2}, start * 1000000000000 + arrived) AS x
  FROM days JOIN c USING (k) WHERE kind NOT BETWEEN 2 AND 4 AND start <= day GROUP BY k, day),
r AS (
  SELECT k, day, arg_max({'v': source, 'gone': false}, arrived) AS x
  FROM days JOIN c USING (k) WHERE kind BETWEEN 2 AND 4 AND start <= day AND day < start + 10 GROUP BY k, day),
p AS (
  SELECT k, day, coalesce(r.x, b.x) AS x FROM days LEFT JOIN b USING (k, day) LEFT JOIN r USING (k, day)
  WHERE NOT coalesce(r.x, b.x)['gone']),
n AS (SELECT k, day, x['v'] AS value, day - row_number() OVER (PARTITION BY k, x['v'] ORDER BY day) AS run FROM p)
SELECT k AS doc_id, CAST(row_number() OVER (PARTITION BY k ORDER BY min(day)) AS INTEGER) AS version, min(day) AS valid_from,
       CASE WHEN max(day) = 70 THEN NULL ELSE max(day) + 1 END AS valid_to, value
FROM n GROUP BY k, value, run
""",
}
