"""Operators against brute force, round trips, and odd rows; columns with clashing names."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsleuth.llm import common, decontaminate, language_id, license_scan, lz_fingerprint, ngram_join, quality, secret_scan, source_mix, url_filter, warc_archive, wordhash

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASH = ["score", "label", "size", "words", "s", "h", "pos", "value", "nth", "path", "comp", "start", "n", "target", "digest"]


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def clashing(df):
    for c in CLASH:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def test_word_hashes_are_words():
    texts = ["The É the", "", None, "a-b A\x00b", "日本 x9", "..."]
    hasher, seen = wordhash.WordHasher(), {}
    for begin, own in wordhash.slices(texts, limit=4):
        hashes, places = hasher.words(own)
        for i in range(len(own)):
            want = words(texts[begin + i])
            assert places[i + 1] - places[i] == len(want)
            for w, h in zip(want, hashes[places[i]:places[i + 1]], strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_bloom_filter_misses_no_key(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bloom = common.Bloom(keys, "h", bits_per_key=12)
    assert keys.where(bloom.may_hold(F.col("h"))).count() == 5000
    others = spark.range(10_000, 30_000).select(F.xxhash64("id").alias("h"))
    assert others.where(bloom.may_hold(F.col("h"))).count() < 1000


def plain_links(rows, width=5, threshold=0.8):
    """Number of links and smallest id of the class, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append(frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else ("text", text))
    linked = lambda a, b: a == b if isinstance(a, tuple) or isinstance(b, tuple) else len(a & b) >= threshold * len(a | b) - 1e-9
    root, links = list(range(len(rows))), collections.Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if linked(sets[i], sets[j]):
            links[i] += 1
            links[j] += 1
            root[max(find(i), find(j))] = min(find(i), find(j))
    low = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        low[find(i)].append(doc_id)
    best = {k: min((x for x in v if x is not None), default=None) for k, v in low.items()}
    return sorted(((rows[i][0], best[find(i)], links[i]) for i in range(len(rows))), key=repr)


def near_copies(n, changes):
    base = [f"w{i}" for i in range(120)]
    out = []
    for k in range(n):
        own = list(base)
        for c in range(changes):
            own[(k * 7 + c * 31) % 120] = f"x{k}y{c}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [256, 4])
def test_ngram_join_loses_no_link(spark, docs, block):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(9000 + i, t) for i, t in enumerate(near_copies(30, 1) + near_copies(10, 2))]
    rows += [(None, None), (9100, None), (9101, ""), (9102, ""), (9103, "two words"), (9104, "TWO words!"), (9104, "two words"), (9105, "!?"), (9106, "a b c d e"), (None, "a b c d e")]
    table = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = ngram_join.link_documents(table, block=block).select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got), key=repr) == plain_links(rows)
    kept = ngram_join.keep_one(table, block=block)
    assert kept.columns == table.columns
    classes = {(c, d is None and 0) for d, c, _ in plain_links(rows)}
    assert kept.count() == len({c for c in classes if c[0] is not None}) + 0


def test_prefix_is_shortened_until_the_target():
    d = ngram_join.prefix_length(16, 0.8, 8, 0.999)
    recall = lambda k: 1 - (1 - 0.8 ** k) ** 16
    assert recall(d) >= 0.999 > recall(d + 1)
    assert ngram_join.prefix_length(1, 0.5, 8, 0.999) == 1


def test_fingerprints(spark, docs):
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in lz_fingerprint.fingerprint_edits(clashing(docs), partitions=5).collect()}
    assert len(got) == len(rows)
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        k = len(text) // 3
        edited = text[:len(text) - k] + after[:k]
        assert got[doc_id]["n_chars"] == len(text) and got[doc_id]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    near, other = (np.median([r[c] for r in got.values()]) for c in ("near_edited", "near_next"))
    assert near > 0.4 and other < 0.2
    by_text = collections.defaultdict(set)
    for doc_id, text in rows:
        by_text[text].add(got[doc_id]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_phrases_are_lempel_ziv():
    seen = set()
    assert lz_fingerprint.extend([1, 1, 1, 2, 1, 2], seen, 0) == 0 and len(seen) == 4  # 1 | 1 1 | 2 | 1 2
    assert lz_fingerprint.likeness(lz_fingerprint.sketch(set()), lz_fingerprint.sketch(set())) == 1.0
    assert lz_fingerprint.likeness(lz_fingerprint.sketch(seen), lz_fingerprint.sketch(set())) == 0.0


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names, table = language_id.learn(docs)
    assert names == sorted(names) and np.allclose(np.linalg.norm(table, axis=1), 1, atol=1e-5)
    got = language_id.predict(clashing(docs), names, table).collect()
    mine = [r for r in got if held_out(r["doc_id"])]
    assert sum(r["lang"] == r["lang_pred"] for r in mine) > 0.97 * len(mine) and all(0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ..."), (4, "\U00010400 日本"), (5, "x" * 300_000)], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in sorted(language_id.predict(odd, names, table).collect())] == [True, True, True, False, False]
    assert {r["lang_pred"] for r in language_id.predict(odd, [], table[:0]).collect()} == {"und"}


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    weights = quality.learn(docs, clashing(labels))
    scored = quality.score(docs, weights).join(labels, "doc_id").collect()
    mine = [r for r in scored if held_out(r["doc_id"])]
    assert sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in mine) > 0.97 * len(mine)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x")], "doc_id long, text string")
    a, b, c = (r["score"] for r in quality.score(odd, weights).orderBy(F.col("doc_id").asc_nulls_last()).collect())
    assert a == b and 0 < c < 1


def test_secrets_are_found_and_replaced(spark, docs):
    extra = [(9001, 'x token = "0123456789abcdef0123456789abcdef01234567" y token = "89abcdef0123456789abcdef0123456789abcdef"', "en", "src", 1), (9002, None, None, None, None), (9003, "averyverylongplainwordwithoutnumbers 4111111111111111", "en", None, 1)]
    table = docs.unionByName(spark.createDataFrame(extra * 2, docs.schema))
    found = secret_scan.scan_secrets(clashing(table))
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    got = found.collect()
    assert all(texts[r["doc_id"]][r["start"]:r["start"] + r["length"]] == r["value"] for r in got)
    want = {(d, m.start(1)) for d, t in texts.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t or "")}
    assert {(r["doc_id"], r["start"]) for r in got if r["secret"]} == want
    clean = secret_scan.redact_secrets(clashing(table))
    assert clean.columns == clashing(table).columns and clean.count() == table.count()
    after = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert after[9001] == f'x token = "{secret_scan.PLACEHOLDER}" y token = "{secret_scan.PLACEHOLDER}"'
    assert all(after[d] == t for d, t in texts.items() if d not in {d for d, _ in want})


def test_secrets_by_reviewed_labels(spark):
    rows = [(i, f"id {i:016d}{'a' * (i % 5)} end", "p", i % 2) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, y int")
    labels = table.select("doc_id", F.lit(0).alias("nth"), (F.col("doc_id") % 5 > 1).cast("int").alias("label"))
    got = {r["doc_id"]: r["secret"] for r in secret_scan.scan_secrets(table, labels=labels).collect()}
    assert got == {i: i % 5 > 1 for i in range(60)}


def test_decontamination_keeps_other_columns(spark, docs):
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    found = decontaminate.decontaminate(clashing(docs), items)
    assert set(CLASH) <= set(found.columns) and found.count() == docs.count()
    kept = decontaminate.drop_contaminated(clashing(docs), items)
    assert kept.columns == clashing(docs).columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in found.where("not contaminated").select("doc_id").collect()}
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == docs.count()


def test_license_threshold(spark):
    rows = [(1, "Permission is hereby granted, free of charge, to any person obtaining a copy."), (2, "to any person of a copy"), (3, None)]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan_licenses(clashing(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[1] == ("mit", 13 / 16) or got[1][0] == "mit"
    assert got[2] == ("", 0.0) and got[3] == ("", 0.0)


def test_mix_comes_near_targets(spark, docs):
    got = source_mix.mix_sources(clashing(docs)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, source_mix.mix_sources(docs).collect()), key=repr)
    taken, target, size = collections.Counter(), {}, collections.Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-3
    assert all(abs(taken[s] - target[s]) <= 3 * 64 and target[s] <= 2 * size[s] + 1e-6 for s in target)


def test_seats_follow_highest_quotients(spark):
    votes = [53, 24, 23, 7, 0]
    units = spark.createDataFrame([(f"u{i}", float(v), 100, 107.0, 5, 21) for i, v in enumerate(votes)], "unit string, votes double, most int, total double, n_units int, n_seats int")
    got = {r["unit"]: r["q"] for r in source_mix.seats(units, [], "q").collect()}
    order = sorted(((v / (2 * k + 1), f"u{i}") for i, v in enumerate(votes) for k in range(50)), key=lambda x: (-x[0], x[1]))[:21]
    assert got == {f"u{i}": sum(u == f"u{i}" for _, u in order) for i in range(5)}


def test_archive_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "<p>é"), (2, "http://b/", "<p>é"), (3, None, None), (4, "http://c\r\n/", ""), (5, "http://d/", "WARC/1.1\r\n\r\nx")]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    warc_archive.write_archive(pages, f"{tmp_path}/a")
    assert spark.read.parquet(f"{tmp_path}/a/payloads").count() == 3
    back = warc_archive.read_archive(spark, f"{tmp_path}/a")
    got = {int(r["record_of"]): r for r in back.collect()}
    for page_id, _, html in rows:
        r = got[page_id]
        assert bytes(r["payload"]).decode() == (html or "") and r["record_type"] == ("revisit" if page_id in (2, 4) else "response")
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and block == (b"" if r["record_type"] == "revisit" else (html or "").encode()) + b"\r\n\r\n"
    warc_archive.export_warc(back.coalesce(1).orderBy("record_of"), f"{tmp_path}/w")
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    found = []
    while data:  # as a plain reader does: header block, then as many bytes as it says
        head, _, rest = data.partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        found.append((int(re.search(rb"x-page:(\d+)", head)[1]), rest[:n]))
        assert rest[n:n + 4] == b"\r\n\r\n"
        data = rest[n + 4:]
    assert found == [(i, b"" if i in (2, 4) else (h or "").encode()) for i, _, h in rows]


def test_broken_payload_stops_the_read(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a")], "page_id long, url string, html string")
    warc_archive.write_archive(pages, f"{tmp_path}/a")
    bad = spark.read.parquet(f"{tmp_path}/a/payloads").withColumn("payload", F.lit("b").cast("binary")).collect()
    spark.createDataFrame(bad, "digest string, length long, sha1 string, payload binary").write.parquet(f"{tmp_path}/b/payloads")
    with pytest.raises(Exception, match="does not match its digest"):
        warc_archive.read_payloads(spark, f"{tmp_path}/b").collect()


def test_canonical_urls(spark):
    rows = ["http://A.b/x/?utm_a=1&c=2&b=1#f", "http://a.b/x", None, "x", "https://a.b"]
    got = [r["c"] for r in spark.createDataFrame([(u,) for u in rows], "url string").select(url_filter.canonical(F.col("url")).alias("c")).collect()]
    assert got == ["a.b/x?b=1&c=2", "a.b/x", None, None, "a.b"]
