"""The operators as queries over the given tables, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import new_folder
from . import centroid_clusters, decontaminate, filter_audit, language_id, license_scan, lz_fingerprint, near_dedup, ngram_join, quality, secret_scan, source_mix, url_filter, warc_archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_ngram_join(spark, sf_dir):
    """Class of near duplicates and number of links of every document."""
    return ngram_join.link_documents(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


@query
def op2_secret_scan(spark, sf_dir):
    """Every candidate of every document with the forest's score; values as digests."""
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "nth", F.col("start").cast("long").alias("start"), "length", F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), "secret")


@query
def op3_lz_fingerprint(spark, sf_dir):
    """Phrase fingerprint of every document, and its likeness to an edited form and to the next document."""
    return lz_fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


@query
def op4_decontaminate(spark, sf_dir):
    """Words of every document that stand in windows of benchmark items, and those items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", *decontaminate.RESULTS)


def held_out():
    return F.coalesce(language_id.remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")


@query
def op5_language_id(spark, sf_dir):
    """Language of every document, by prototypes learnt from the folds that are not held out."""
    docs = table(spark, sf_dir, "documents")
    languages, prototypes = language_id.learn(docs)
    return language_id.predict(docs.select("doc_id", "text"), languages, prototypes).select("doc_id", held_out(), "lang_pred", "score")


@query
def op6_url_filter(spark, sf_dir):
    """Rule, verdict and host of every page; the list is made of the pages' own spam hosts."""
    pages = table(spark, sf_dir, "pages")
    judged = url_filter.judge_urls(pages, url_filter.listed_urls(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op7_license_scan(spark, sf_dir):
    """License phrases and matching license templates of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan_licenses(docs).select("doc_id", *license_scan.RESULTS)


@query
def op8_source_mix(spark, sf_dir):
    """Words that a mix of 150 % of all words takes from every document."""
    return source_mix.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_warc_archive(spark, sf_dir):
    """Every page as a WARC record, written to an archive and read back."""
    folder = new_folder(spark, "op9-archive")
    warc_archive.write_archive(table(spark, sf_dir, "pages"), folder)
    records = warc_archive.read_archive(spark, folder)
    number = lambda c: F.col(c).cast("long").alias(c)
    return records.select(F.col("record_of").cast("long").alias("page_id"), F.col("length").alias("payload_bytes"),
                          F.col("read_sha1").alias("payload_digest"), "record_type", number("refers_to"))


@query
def op10_quality(spark, sf_dir):
    """Quality score of every document, by weights learnt from the folds that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op11_near_dedup(spark, sf_dir):
    """Component of near duplicates of every document, and whether it is the one of it that stays."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op12_centroid_clusters(spark, sf_dir):
    """Cluster of every vector that counts, after ten rounds from eight start vectors."""
    return centroid_clusters.cluster_vectors(table(spark, sf_dir, "embeddings"))[0]


@query
def op13_filter_audit(spark, sf_dir):
    """What five filters remove of every source in each order and step."""
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
