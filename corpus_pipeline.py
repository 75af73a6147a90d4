"""A corpus pipeline of four stages: quality rules, language ID, near-duplicate removal, packing.

Every stage takes all that the one before kept, as a stored table. Stages but the last return the columns
of ``documents``. SQL cannot express the learned and the near-duplicate stages, so tests hold ``run``
against a plain version of each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattspan.llm import jaccard_join, language_id, packing, quality_rules
from wattspan.llm.common import materialise
from wattspan.ship import ship

#: A document whose average marginal of its best language is below this is rejected.
LEAST_LANGUAGE_SCORE = 0.4


def _with_row(docs: DataFrame, *used: str) -> DataFrame:
    """The columns that an operator reads, and the whole row beside them: its own columns then replace none."""
    return docs.select(*used, F.struct(*docs.columns).alias("_row"))


def keep_good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ship(spark)
    return quality_rules.judge(_with_row(docs, "doc_id", "text")).where("kept").select("_row.*")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language and a score that is not low."""
    ship(spark)
    named = language_id.identify(_with_row(docs, "doc_id", "text", "lang"), carry=["_row"])
    return named.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("_row.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of near copies: that of least id, then of least key; null ids come last.

    A document is a row's id and text together, so rows that repeat an id with another text are documents of their
    own and stay unless they are near copies of one that stays; rows that repeat both are one document. The key is a
    64-bit hash of both.
    """
    ship(spark)
    key = F.xxhash64("doc_id", "text")
    groups = jaccard_join.jaccard_components(docs.select(key.alias("key"), "text"), percent=75, id_col="key")
    member = groups.select(F.col("doc_id").alias("member"), "component_id").distinct()
    ids = docs.select(key.alias("key"), "doc_id").distinct()
    named = member.join(ids, F.col("member") == F.col("key"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least")
    chosen, _ = materialise(named.groupBy("component_id").agg(least).select(F.col("least.key").alias("chosen")), "chosen")
    own = "_key"
    while own in docs.columns:
        own += "_"
    kept = docs.withColumn(own, key).join(chosen, F.col(own) == F.col("chosen"), "left_semi")
    return kept.dropDuplicates([own, "doc_id", "text"]).drop(own)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document stands in the packed sequences."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("quality_rules", keep_good_text),
    ("language_id", keep_known_language),
    ("jaccard_join", keep_one_of_each_group),
    ("best_fit_packing", pack_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
