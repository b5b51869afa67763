"""The kept gram index against plain substring search, over batches, replays and broken batches."""

import random

import pytest
from pyspark.sql import functions as F

from mailsleuth.sources import gram_index
from mailsleuth.sources.gram_index import GramIndex
from mailsleuth.streaming import ledger


def found(spark, index, terms, texts):
    rows = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = index.candidates(spark.createDataFrame([(t,) for t in terms], "term string")).join(rows, "id").where(F.contains(F.lower("text"), F.lower("term")))
    return {(r["term"], r["id"]) for r in got.collect()}


@pytest.mark.parametrize("pushed", [64, 2])
def test_searches_before_and_after_appends(spark, tmp_path, monkeypatch, pushed):
    monkeypatch.setattr(gram_index, "PUSHED", pushed)
    rng, index, texts = random.Random(6), GramIndex(spark, str(tmp_path / "index"), 4), {}
    terms = ["a", "B", "ab", "abc", "é", "c%_", "none", "", "\\", "abcab"]
    for batch in range(3):
        new = {batch * 100 + i: rng.choice([None, "", "".join(rng.choice("aBcé%_\\ ") for _ in range(12))]) for i in range(60)}
        texts |= new
        rows = spark.createDataFrame(list(new.items()), "id long, text string")
        assert index.append(rows, batch) and not index.append(rows, batch)
        want = {(t, i) for t in terms if t for i, x in texts.items() if x and t.lower() in x.lower()}
        assert found(spark, index, terms, texts) == want


def test_only_the_buckets_of_the_rarest_gram_are_read(spark, tmp_path):
    index = GramIndex(spark, str(tmp_path / "index"), 16)
    index.append(spark.range(2000).select("id", F.concat(F.lit("common "), F.when(F.col("id") % 500 == 0, "quiz").otherwise("text")).alias("text")), 0)
    hits = index.candidates(spark.createDataFrame([("common quiz",)], "term string"))
    assert hits.count() == 4
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200] and "In(gram" in plan or "EqualTo(gram" in plan


def test_a_broken_append_is_not_there(spark, tmp_path, monkeypatch):
    index = GramIndex(spark, str(tmp_path / "index"), 4)
    index.append(spark.createDataFrame([(1, "abc")], "id long, text string"), 0)
    bad = spark.createDataFrame([(2, "abcd")], "id long, text string").withColumn("text", F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception):
        index.append(bad, 1)
    assert [r["id"] for r in index.candidates(spark.createDataFrame([("abc",)], "term string")).collect()] == [1]
    assert ledger.ledger(spark, index.path).select("batch_id").distinct().count() == 1
