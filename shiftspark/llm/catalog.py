"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftspark.llm.bpe import encode_decode
from shiftspark.llm.classifier import quality_scores
from shiftspark.llm.common import load
from shiftspark.llm.exact_dedup import exact_duplicates
from shiftspark.llm.jaccard import jaccard_components
from shiftspark.llm.kneser_ney import language_model_scores
from shiftspark.llm.language import language_id
from shiftspark.llm.packing import pack
from shiftspark.llm.quality_rules import quality_rules
from shiftspark.llm.resample import resample
from shiftspark.llm.shards import byte_shards
from shiftspark.llm.topk import top_k
from shiftspark.llm.va_file import cluster
from shiftspark.llm.warc import derivatives, responses

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def held_out(folds: int) -> Column:
    """Whether a row belongs to the fold that no model learns from; rows without an id don't."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == 2, F.lit(False))


@query
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id(docs, docs.filter(~held_out(4)))
    return found.withColumn("held_out", held_out(4))


@query
def op4_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_decode(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), as_bytes=True)
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return found.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = byte_shards(load(spark, sf_dir, "documents"), 8)
    return found.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


@query
def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


ORACLES["op1_topk_search"] = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id,
                  CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
           FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    labels = load(spark, sf_dir, "labels").filter(~held_out(4)).select("doc_id", F.col("quality").alias("label"))
    found = quality_scores(docs, labels)
    return found.withColumn("held_out", held_out(4)).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return language_model_scores(docs, docs.filter(~held_out(7)), order=3).withColumn("held_out", held_out(7))


@query
def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = derivatives(responses(load(spark, sf_dir, "pages")))
    return found.withColumn("content_length", F.octet_length("content").cast("long")).withColumn("record_sha256", F.sha2("record", 256)).drop("content", "record")


@query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLES["op13_exact_dedup"] = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(text) AS text_sha256
FROM t WINDOW same AS (PARTITION BY text)
"""


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(load(spark, sf_dir, "embeddings"))


def kmeans_sql(k: int, dims: int, scale: int, rounds: int, seed: int) -> str:
    """Lloyd's rounds written out one after the other; m holds distance and cluster of a vector in one number."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT rid, min(CAST(list_sum(list_transform(range(1, {dims + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) * {k} + k) AS m
  FROM kept, c{r} GROUP BY rid)""")
        if r < rounds:
            steps.append(f"""
s{r} AS MATERIALIZED (SELECT k, list(mean ORDER BY i) AS c FROM (
  SELECT k, i, (total - ((total % n) + n) % n) // n AS mean FROM (
    SELECT m % {k} AS k, i, CAST(sum(v[i]) AS BIGINT) AS total, count(*) AS n FROM a{r} JOIN kept USING (rid), range(1, {dims + 1}) AS d(i) GROUP BY ALL)) GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(s{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN s{r} ON s{r}.k = c{r}.k)""")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT v, sha256('{seed}:' || vec_id) AS h FROM kept ORDER BY h, v LIMIT {k})),
{",".join(steps)}
SELECT vec_id, CAST(m % {k} AS INTEGER) AS cluster, m // {k} AS distance, CAST(sum(m // {k}) OVER (PARTITION BY m % {k}) AS BIGINT) AS cluster_inertia,
       CAST(sum(m // {k}) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (rid) JOIN c{rounds} ON c{rounds}.k = m % {k}
"""


ORACLES["op11_centroid_clustering"] = kmeans_sql(8, 64, 1024, 10, 3)
