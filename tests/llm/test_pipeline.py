"""The pipeline stage by stage against a plain version."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as P
from mailsleuth.llm import secret_scan

from .test_operators import plain_links, words

SF_DIR = "/root/testdata/sf0.001"
ALIEN = "他在北京大学学习历史已经三年了每天早上都坐地铁去图书馆看书"


def test_stages_keep_columns_of_any_name(spark):
    names = ["score", "lang_pred", "trigrams", "_key", "_id", "_hit", "_path", "_v", "_p", "_nth", "digest", "label"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(60)
    docs = docs.select(*[F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")).alias(c) for c in names], "*")
    for _, stage in P.STAGES[:4]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns
        kept = out.collect()
        assert kept and all(r[c] == f"{c} of {r['doc_id']}" for r in kept for c in names)


def test_stages_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = [(9001, None, "en", "src1", 0), (9002, "123 ...", "en", "src1", 7)]
    extra += [(9003 + i, (ALIEN * 60)[:n], "en", "src1", n) for i, n in enumerate((20, 99, 120, 2000))]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = P.STAGES[0][1](spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    odd = {d for d, *_ in extra}
    assert ids == set(rows) - odd - {d for d, r in rows.items() if not re.search("[^\\W\\d_]", r["text"] or "")}

    single = P.STAGES[1][1](spark, kept, SF_DIR)
    assert single.columns == docs.columns
    want = {c for _, c, _ in plain_links([(d, rows[d]["text"]) for d in sorted(ids)])}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(want)

    clean = P.STAGES[2][1](spark, single, SF_DIR)
    windows = set()
    for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    leaks = lambda w: any(tuple(w[i:i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    want = {d for d in want if not leaks(words(rows[d]["text"]))}
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == sorted(want)

    safe = P.STAGES[3][1](spark, clean, SF_DIR)
    assert safe.columns == docs.columns
    got = {r["doc_id"]: r for r in safe.collect()}
    assert set(got) == want
    for d, r in got.items():
        assert r["text"] == re.sub(r'(?i)(token = ")[0-9a-f]{40}"', rf'\1{secret_scan.PLACEHOLDER}"', rows[d]["text"]) and r["n_chars"] == len(r["text"])

    mixed = P.STAGES[4][1](spark, safe, SF_DIR)
    assert {r["doc_id"] for r in mixed.collect()} == want


def test_run_agrees_with_itself(spark):
    a, b = (sorted(map(tuple, P.run(spark, SF_DIR).collect()), key=repr) for _ in range(2))
    assert a and a == b
