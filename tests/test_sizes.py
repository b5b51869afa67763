"""Queries on rows and tables larger than those of the test data."""

import email.policy
import random

from pyspark.sql import functions as F

from mailsleuth.functions import rules as R, text as TX
from mailsleuth.operators import correlation, indicators
from mailsleuth.operators.components import PARENT_ROW
from mailsleuth.plans.catalog import QUERIES, stream_of
from mailsleuth.plans.fixtures import Views
from mailsleuth.session import children, shared_folder
from mailsleuth.sources import mail_files
from mailsleuth.sources.gram_index import SEP, GramIndex
from mailsleuth.sources.keyed_table import KeyedTable
from mailsleuth.streaming import ledger


class Own(Views):
    """The views over tables of a test's own where it has them, over the smallest test tables else."""

    def __init__(self, spark, **tables):
        super().__init__(spark, "/root/testdata/sf0.001")
        self.tables = tables

    def base(self, table):
        return self.tables[table] if table in self.tables else super().base(table)


def test_gate_of_a_long_text(spark):
    """100,000 times the size of 30,000 bytes is beyond 32 bits."""
    docs = spark.createDataFrame([(1, 30_000), (2, 30_000), (20, 30_000)], "doc_id long, n_chars long").withColumn("text", F.repeat(F.lit("x"), F.col("n_chars").cast("int")))
    rows = {r["message_id"]: (r["size_bytes"] > 2 ** 31, r["gate"]) for r in QUERIES["p10_message_gate"](Own(spark, documents=docs)).collect()}
    assert rows == {"m1": (True, "552 5.3.4 Message size exceeds fixed limit"), "m2": (False, None), "m20": (False, "550 5.6.0 Empty message payload")}


def test_index_costs_a_row_its_values_not_its_grams(spark, tmp_path):
    """2,000 rows of three columns that repeat: six entries at most a row, and postings of the distinct columns alone."""
    index = GramIndex(spark, str(tmp_path / "index"), 4)
    n = F.col("id") % 5
    text = F.concat_ws(SEP, F.lit("Common subject of all"), F.concat(F.lit("sender"), n, F.lit("@corp.example.com")), F.lit(""), F.lit("common subject of ALL"))
    rows = spark.range(2000).select("id", text.alias("text"))
    assert index.append(rows.where("id < 1000"), 0) and index.append(rows.where("id >= 1000"), 1)
    counts = {r["table_name"]: r["n"] for r in ledger.ledger(spark, index.path).groupBy("table_name").agg(F.sum("n_rows").alias("n")).collect()}
    assert counts["postings"] < 6 * 3 * 30 and counts["entries"] == 2 * 2000
    terms = ["SENDER3", "common", "of all", "@corp", "3@c", "m", "all" + SEP + "sender3@", "allsender", "sender9"]
    got = index.candidates(spark.createDataFrame([(t,) for t in terms], "term string")).join(rows, "id").where(F.contains(F.lower("text"), F.lower("term")))
    found = {r["term"]: r["n"] for r in got.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert found == {"SENDER3": 400, "common": 2000, "of all": 2000, "@corp": 2000, "3@c": 400, "m": 2000, "all" + SEP + "sender3@": 400}


def test_search_without_an_index_cuts_distinct_columns(spark):
    scans = spark.range(3000).select(F.col("id").alias("scan_id"), F.col("id").alias("scan_time"), F.lit("http://a.example/x").alias("urls_text"), F.lit("").alias("iocs_text"),
                                     F.concat(F.lit("S"), F.col("id") % 3, F.lit("@b.example")).alias("sender"), F.lit(None).cast("string").alias("subject"))
    terms = spark.createDataFrame([("s1@",), ("Example",), ("x" + SEP,), ("none",)], "term string")
    entries, kept = [], indicators.stored
    indicators.stored = lambda df, name: (entries.append((name, df.count())), kept(df, name))[1]
    try:
        rows = {r["term"]: (r["matches_count"], r["scan_ids"]) for r in indicators.search_terms(terms, scans, 2).collect()}
    finally:
        indicators.stored = kept
    assert rows == {"s1@": (1000, [2995, 2998]), "Example": (3000, [2998, 2999]), "x" + SEP: (3000, [2998, 2999]), "none": (0, None)}
    assert dict(entries)["values"] == 4 and max(n for name, n in entries if name != "scan-values") < 200


def test_labels_are_searched_once(spark):
    plan = QUERIES["f04_content_patterns"](Views(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and "size(" not in plan


def test_bodies_go_to_python_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for name in ("a13_content_penalty", "a15_upload_score"):
        spark.conf.set(key, "10000")
        QUERIES[name](Views(spark, "/root/testdata/sf0.001"))
        assert int(spark.conf.get(key)) <= 256
        spark.conf.set(key, "100")
        QUERIES[name](Views(spark, "/root/testdata/sf0.001"))
        assert int(spark.conf.get(key)) == 100
    spark.conf.unset(key)


def test_a_batch_lands_in_a_file_for_every_core(spark):
    top = shared_folder(spark)
    before = set(children(spark, top))
    stream_of(Views(spark, "/root/testdata/sf0.001"), "messages", "documents", 3)
    folder, = [c for c in children(spark, top) if c not in before and c.startswith("landed-documents")]
    files = [c for c in children(spark, f"{top}/{folder}") if c.endswith(".parquet")]
    assert len(files) == 3 * spark.sparkContext.defaultParallelism


def campaign_scans(spark, rows):
    scans = spark.createDataFrame(rows, "scan_id long, sender string, urls_text string")
    return scans.withColumns({"receiver": F.lit("r@y.example"), "subject": F.lit("s"), "verdict": F.lit("Low Risk"), "risk_score": F.lit(1), "scan_time": F.lit("2024-01-01")})


def campaigns_by_loop(rows):
    """Smallest scan reachable over shared domains and hosts; rows of one scan count as one, those without an id tie nothing."""
    of = {i: i for i, *_ in rows}
    while True:
        low = {}
        for i, sender, urls in rows:
            for n in [sender.split("@")[-1].lower()] * (sender != "") + ["u" + u.split("/")[2].lower() for u in urls.split(";") if u]:
                if i is not None:
                    low[n] = min(of[i], low.get(n, of[i]))
        new = dict(of)
        for i, sender, urls in rows:
            for n in [sender.split("@")[-1].lower()] * (sender != "") + ["u" + u.split("/")[2].lower() for u in urls.split(";") if u]:
                if i is not None:
                    new[i] = min(new[i], low[n])
        if new == of:
            return of
        of = new


def odd_scans():
    rng = random.Random(5)
    url = lambda: f"http://H{rng.randrange(45)}.example/{rng.randrange(9)}"
    rows = [(i, rng.choice(["", f"a@D{rng.randrange(40)}.example", f"b@d{rng.randrange(40)}.example"]), ";".join(url() for _ in range(rng.choice([0, 0, 0, 1, 2])))) for i in range(100, 160)]
    rows += [(100, "x@again.example", ""), (159, "y@AGAIN.example", ""), (130, "", ""), (131, "", "http://late.example/a"), (132, "z@late.example", "http://late.example/b")]
    return rows + [(None, "n@d1.example", "http://h2.example/"), (None, "n@d2.example", "")]


def test_campaigns_of_repeated_and_unnamed_scans(spark, tmp_path):
    rows = odd_scans()
    want = campaigns_by_loop(rows)
    assert 3 < len(set(want.values())) < 50
    got = correlation.campaign_components(campaign_scans(spark, rows)).collect()
    assert len(got) == len(want) and {r["scan_id"]: r["component"] for r in got} == want
    nodes = KeyedTable(spark, str(tmp_path / "nodes"), correlation.NODE_ROW, ["node_id"], ["step"], buckets=2)
    parents = KeyedTable(spark, str(tmp_path / "forest"), PARENT_ROW, ["v"], ["step"], buckets=2)
    for n in range(3):  # later batches hold smaller scans of known nodes, and other rows of known scans
        for _ in range(2 if n == 1 else 1):  # one is replayed
            correlation.grow_campaigns(nodes, parents, campaign_scans(spark, [r for k, r in enumerate(reversed(rows)) if k % 3 == n]), n)
    got = correlation.kept_campaigns(nodes, parents, campaign_scans(spark, rows)).collect()
    assert len(got) == len(want) and {r["scan_id"]: r["component"] for r in got} == want


def test_campaigns_link_nodes_not_scans(spark, tmp_path, monkeypatch):
    """3,000 mails over three domains and ten hosts: as few edges as there are pairs of nodes, and no kept row for a mail."""
    rows = [(i, f"a@d{i % 3}.example", f"http://h{i % 10}.example/") for i in range(3000)]
    edges, plain = [], correlation.components
    monkeypatch.setattr(correlation, "components", lambda e, name: (edges.append(e.count()), plain(e, name))[1])
    got = correlation.campaign_components(campaign_scans(spark, rows)).collect()
    assert len(got) == 3000 and {r["component"] for r in got} == {0} and edges and sum(edges) <= 30
    nodes = KeyedTable(spark, str(tmp_path / "nodes"), correlation.NODE_ROW, ["node_id"], ["step"], buckets=2)
    parents = KeyedTable(spark, str(tmp_path / "forest"), PARENT_ROW, ["v"], ["step"], buckets=2)
    for n in range(2):
        correlation.grow_campaigns(nodes, parents, campaign_scans(spark, rows[n::2]), n)
    assert nodes.read().count() == 13 and parents.read().count() <= 26


def test_a_header_of_many_mails_is_parsed_once(monkeypatch):
    part = '--B\nContent-Type: {}\nContent-Disposition: {}\nContent-Transfer-Encoding: {}\n\n{}\n'
    mails = [("Subject: s\nContent-Type: multipart/mixed; boundary=B\n\n" + part.format("text/plain; charset=utf-8", "inline", "8bit", f"caf\u00e9 {i}")
              + part.format("text/html; charset=latin-1", "inline", "quoted-printable", f"<p>{i} =E9</p>") + part.format("image/png", f'attachment; filename="{"x" * 2000 * (i == 7)}{i % 3}.png"', "base64", "Ynl0ZXM=")
              + part.format("text/plain; charset=none-such", "inline", "8bit", "odd") + "--B--\n").encode() for i in range(50)] + [b"", b"Subject: plain\n\nbody", b"Content-Type: text/html;;=\n\n\xff"]
    want = [mail_files._decode_one(m, None, email.policy.default) for m in mails]
    parsed, kind = [], type(email.policy.default.header_factory)
    plain = kind.__call__
    monkeypatch.setattr(kind, "__call__", lambda self, name, value: (parsed.append((name, value)), plain(self, name, value))[1])
    policy = mail_files._mail_policy()
    assert [mail_files._decode_one(m, None, policy) for m in mails] == want and len(want[0][4]) == 1 and want[7][4][0][1].startswith("xxx")
    short = [p for p in parsed if len(p[1]) <= 1024]
    assert len(short) == len(set(short)) < 20


def test_rescan_makes_no_texts_it_does_not_return(spark):
    plan = QUERIES["c06_mailbox_rescan"](Views(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Embedded Credentials in URL" not in plan and "uses double extension deception" not in plan


def test_patterns_are_searched_in_texts_with_their_words(spark):
    """The literal tests before a pattern let every text pass that it matches, in any case and between any blanks."""
    assert TX._outer_words(r"\b(?:a|b)\s+(?:c|d)\b") == [["a", "b"], ["c", "d"]]
    assert [TX._outer_words(p) for p in (r"\b(?:a|b)?x", r"\b(?:a|b)x|y", r"(?:a|)\b", r"x(?:a[b])\b", r"\b(?:a)|(?:b)\b")] == [[], [], [], [], []]
    texts = ["VERIFY your\tPassWord", "verify password", "verify passwords", "gift urgent", "overdue  gift card", "unusual sign-in", "tax amount, update mfa", "İ service will be locked", "&#118;erify pass​word", "a\x1cb \x85 c", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(TX.content_text(F.col("t")).alias("c")).select("c", TX.content_labels(F.col("c")).alias("l"))
    assert "Contains(" in got._jdf.queryExecution().optimizedPlan().toString()
    names = [n for n, _ in R.CONTENT_PATTERNS]
    assert [[names.index(x) for x in r["l"]] for r in got.collect()] == [[0], [0], [], [], [2], [3], [0, 4], [1], [0], [], []]
    assert [r["c"] for r in got.collect()][-3:] == ["verify password", "a\x1cb c", ""]
