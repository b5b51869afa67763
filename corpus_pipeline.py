"""Corpus pipeline: five stages over ``documents``, each written as Parquet to the shared folder and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. The first four return the
columns of ``documents``; the last returns of every kept document how much the mix takes, which runs of words, and its
mixed text, which is empty where nothing is taken.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailsleuth.llm import decontaminate, language_id, ngram_join, secret_scan, source_mix
from mailsleuth.llm.common import stored

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")

LEAST_SCORE, SURE_TRIGRAMS = 0.12, 100


def apart(stage):
    """The stage, with columns beyond those of documents under names of its own while it works, so that none can meet a
    column that an operator adds."""
    @functools.wraps(stage)
    def work(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = {c: c if c in DOCUMENTS else f"extra_{i}_of_documents" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.toDF(*own.values()), sf_dir)
        return out.select(*[F.col(name).alias(c) for c, name in own.items()])

    return work


@apart
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (null and empty ones among them), and texts that are like none of the languages.
    The score that a text of few trigrams can reach is less, so what is asked of it falls with the fourth root of their
    number; by chance a text scores about 0.03 at every length."""
    languages, prototypes = language_id.learn(docs)
    judged = language_id.predict(docs, languages, prototypes)
    asked = LEAST_SCORE * F.pow(F.least(F.lit(1.0), F.col("trigrams") / SURE_TRIGRAMS), 0.25)
    return judged.where((F.col("lang_pred") != language_id.NONE) & (F.col("score") >= asked))


@apart
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near duplicates stays, the one with the smallest id."""
    return ngram_join.keep_one(docs)


@apart
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@apart
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a placeholder; every document stays, with its new length."""
    return secret_scan.redact_secrets(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document, and its text in the mix."""
    return source_mix.mix_sources(docs, with_text=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("secrets", secrets), ("mix", mix)]

# trained models and minimum hashes have no SQL; tests/llm holds the run against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
