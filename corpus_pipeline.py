"""From raw documents to packed training sequences: quality rules, language ID, near-duplicate removal, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Verdicts are joined back by a hash of the whole row, so
rows that share a doc_id are judged one by one, and equal rows alike.

For all stages: a null text counts as empty, which the base rules reject and which is near to no other; null ids, languages and sources
are values like any other; texts of any length are read whole; further columns of any type are kept, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftspark.llm.common import kept, load
from shiftspark.llm.jaccard import jaccard_components
from shiftspark.llm.language import UNKNOWN, language_id
from shiftspark.llm.packing import pack
from shiftspark.llm.quality_rules import quality_rules

#: Texts nearer to no language than this are rejected: noise without words of any learned language.
LEAST_LANGUAGE_SCORE = 0.3
#: Name of the column with the hash of a row; documents that have such a column keep it, under another name meanwhile.
KEY, OWN = "__row", "__row of the documents"


def keyed(docs: DataFrame) -> DataFrame:
    """The documents with a hash of all their columns as KEY; maps, which have no hash, count by their JSON text."""
    docs = docs.withColumnRenamed(KEY, OWN)
    values = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]
    return docs.withColumn(KEY, F.xxhash64(*values, *(F.col(f"`{c}`").isNull() for c in docs.columns)))


def unkeyed(rows: DataFrame) -> DataFrame:
    """The documents without their KEY."""
    return rows.drop(KEY).withColumnRenamed(OWN, KEY)


def judged(docs: DataFrame) -> DataFrame:
    """What the operators judge: the texts and what they are grouped by, each under the hash of its row as doc_id."""
    return keyed(docs).select(F.col(KEY).alias("doc_id"), *(c for c in ("text", "lang", "source") if c in docs.columns))


def of_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents whose KEY is among those of `rows`."""
    return unkeyed(keyed(docs).join(rows.select(KEY).distinct(), KEY, "left_semi")).select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    found = quality_rules(judged(docs))
    return of_rows(docs, found.filter("kept").select(F.col("doc_id").alias(KEY)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: with letters, and near enough to a profile learned from all documents with a declared language."""
    found = language_id(judged(docs), docs.select("lang", "text"))
    good = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return of_rows(docs, found.filter(good).select(F.col("doc_id").alias(KEY)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id, a null one only where a group has no other; documents
    without words all stay."""
    rows = keyed(docs)
    found = jaccard_components(judged(docs))
    found = kept(found.select(F.col("doc_id").alias(KEY), "component_id", F.col("class").isNull().alias("empty")).distinct())
    named = found.filter("not empty").join(rows.select(KEY, "doc_id"), KEY)
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", KEY)
    first = named.groupBy("component_id").agg(F.min(order).alias("first")).select(f"first.{KEY}")
    one = unkeyed(rows.join(kept(first), KEY, "left_semi").dropDuplicates([KEY]))
    return one.select(docs.columns).union(of_rows(docs, found.filter("empty")).select(docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("language ID", language), ("near duplicates", near_duplicates), ("packing", packing)]

#: Language profiles and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
