"""Findings of the review: each test failed before its change."""

import re

import pytest

import corpus_pipeline
from mailsleuth.llm import decontaminate, language_id, quality, secret_scan

SF_DIR = "/root/testdata/sf0.001"
KEY = "9f3cAb12Zk77Qw0pLx5T"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "src") for i, t in enumerate(texts)], "doc_id long, text string, source string")


@pytest.mark.parametrize("context", ["alone", "with a forest"])
def test_usual_forms_of_secrets_are_found(spark, context):
    forms = [f'password = "{{}}"', f"API_KEY={{}}", f"aws_secret_access_key={{}}", f"aws_secret_access_key: '{{}}'", f'"db_password": "{{}}"', "TOKEN={}\nNAME=x"]
    values = ["hunter2x9", KEY, KEY, KEY, "p@s5!w0rd#7k", KEY + "=="]
    texts = [f.format(v) for f, v in zip(forms, values, strict=True)]
    rest = [f"see {w}wordwithoutanynumbers and 20240101202401{i:04d}" for i, w in enumerate("abcdefghij" * 4)] if context != "alone" else []
    found = secret_scan.scan_secrets(table(spark, texts + rest)).where("secret").collect()
    assert sorted((r["doc_id"], r["value"]) for r in found) == list(enumerate(values))
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact_secrets(table(spark, texts + rest)).collect()}
    assert [clean[i] for i in range(len(forms))] == [f.format(secret_scan.PLACEHOLDER) for f in forms]
    assert all(clean[len(forms) + i] == t for i, t in enumerate(rest))


def test_without_seeded_secrets_clean_texts_stay(spark):
    texts = ["see http://host.example.net/en/7817/page-2024 today", "/var/log/app-2024/01/02/x9.log", "id 123e4567-e89b-12d3-a456-426614174000 done", "md5 9e107d9d372bb6826bd81d3542a419d6 ok"]
    assert secret_scan.scan_secrets(table(spark, texts)).where("secret").collect() == []
    assert sorted(r["text"] for r in secret_scan.redact_secrets(table(spark, texts)).collect()) == sorted(texts)


def test_mix_gives_its_word_ranges_and_text(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = [(9001, "  one\n two  ", "en", "src", 1), (9002, None, "en", "src", 0), (9003, " \t", "en", "src", 2)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    got = corpus_pipeline.mix(spark, docs, SF_DIR).collect()
    assert {r["doc_id"] for r in got} == set(texts)
    for r in got:
        w = split(texts[r["doc_id"]])
        assert sum((s["stop"] - s["start"]) * s["times"] for s in r["spans"]) == r["taken"] and len(r["spans"]) <= len(w) / 64 + 2
        want = [x for s in r["spans"] for _ in range(s["times"]) for x in w[s["start"]:s["stop"]]]
        assert split(r["text"]) == want and len(want) == r["taken"]
    assert any(r["taken"] not in (0, r["size"]) for r in got)
    whole = [r for r in got if r["taken"] == r["size"] > 0 and all(s["times"] == 1 for s in r["spans"])]
    assert all(r["text"] == texts[r["doc_id"]].strip(" \t\n\r\x0b\x0c") for r in whole)


def test_leaks_keep_their_spans(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs = spark.createDataFrame([(1, f"x {passage} y", "s"), (2, "none", "s"), (3, None, "s")], "doc_id long, text string, spans string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in decontaminate.decontaminate(docs, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    assert got == {1: [(1, 11), (2, 12)], 2: [], 3: []}


def test_rare_languages_are_learnt_at_every_size(spark):
    rows = [(i, f"der hund und die katze {i}", "de") for i in range(2000)] + [(3000 + i, "zażółć gęślą jaźń", "pl") for i in range(3)]
    rows += [(4001, "one row many times", "en")] * 500  # equal ids, all or none of which a draw by id would take
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, _ = language_id.learn(docs, train_docs=30)
    assert names == ["de", "en", "pl"]
    assert language_id.learn(docs.limit(0))[0] == []


def test_quality_bound_holds_for_repeated_ids(spark, monkeypatch):
    original = quality.fit
    rows = [(1, f"good text {i}") for i in range(300)] + [(1, "same text")] * 300 + [(2, "bad one"), (3, "good one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")

    def counted(examples):
        w = original(examples)
        w[0] = len(examples)
        return w

    monkeypatch.setattr(quality, "fit", counted)
    sizes = [int(quality.learn(docs, labels, train_docs=n)[0]) for n in (20, 1000)]
    assert sizes[0] == 20 and sizes[1] <= 303
