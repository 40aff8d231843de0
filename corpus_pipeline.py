"""The document pipeline: stages of llm operators, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm import language_id, line_templates, packing, simhash, source_mix
from factlake.plans.scratch import Scratch


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents without text, without a letter or in no learned language go."""
    return language_id.keep_known(docs, language_id.fit(docs))


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: lines whose template recurs across documents go, but for the first document's; every document stays."""
    kept, _ = line_templates.drop_recurring(docs)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: each source has its share of words; documents are left out or stand once or twice."""
    return source_mix.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one row for each piece of a document in a sequence."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_recurring_lines),
    ("simhash_dedup", one_of_each_group),
    ("source_mix", mixed_sources),
    ("packing", packed),
]

#: Language models, fingerprints and tokens have no SQL form; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir)).df
    return docs
