"""Queries against their DuckDB statements, on the smallest tables and on a table of odd rows."""

import duckdb
import pytest

from mailsleuth.llm.queries import QUERIES
from mailsleuth.llm.statements import STATEMENTS

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "embeddings")


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order)) for r in found)


def compare(spark, folder, name):
    df = QUERIES[name](spark, folder)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'/*.parquet' if not folder.startswith('/root/testdata') else ''}'")
    cur = con.execute(STATEMENTS[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    got = rows(df.collect(), df.columns)
    assert got == rows(cur.fetchall(), columns)
    return got


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_statement(spark, name):
    assert compare(spark, SF_DIR, name)


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    """Nulls in every column, empty, wordless and long texts, repeated rows, ties, short items."""
    folder = str(tmp_path_factory.mktemp("odd"))
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = [(1, f"Start {passage} end.\nLicensed under CC BY-NC 4.0.", "en", "b", 1), (1, f"Start {passage} end.\nLicensed under CC BY-NC 4.0.", "en", "b", 1),
            (2, None, None, None, None), (3, "", "en", "", 0), (4, "...!!!", "en", "a", 6), (None, f"x {passage}", "en", "a", None), (5, "All rights reserved. cc by cc by", None, "ä", 3),
            (6, "one two Three", "de", None, 9), (7, ("lorem ipsum " * 3000) + passage, "en", "b", 1), (8, "General PUBLIC License\x00É é 日本", "fr", "Z", 5), (9, "one two three one two three", "en", "a", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    items = [(1, passage.upper()), (1, passage), (2, "one two three"), (None, passage), (3, None), (4, "?!"), (5, "reserved")]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    pages = [(1, "http://A.Example.NET/en/x?b=2&a=1#f", "<p>"), (2, "https://spam.example.org/x/?utm_source=q", None), (3, "https://spam.example.org/x", ""), (3, "https://spam.example.org/x", ""),
             (None, None, "<p>"), (4, "no scheme", "<p>é"), (5, "ftp://org/fr/", None), (6, "http://example.com/de/a", "x" * 5000), (7, "http://net", "<p>"), (None, "://net/", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(odd_vectors(), "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return folder


def odd_vectors():
    """Ties, repeated rows, null ids, and vectors that don't count."""
    line = lambda x, y=0.0: [x] * 63 + [y]
    rows = [(i, line(float(i % 5), i / 7), 0) for i in range(20)] + [(3, line(3.0, 3 / 7), 1), (None, line(-1.25), None), (30, None, 0), (31, [], 0), (32, [1.0] * 63, 0), (33, [1.0] * 65, 0)]
    return rows + [(34, line(1.0, float("nan")), 0), (35, line(1.0, float("inf")), 0), (36, line(1.0, None), 0), (37, line(2.0, float("-inf")), 0), (38, line(-0.0001), 0)]



@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_statement_on_odd_rows(spark, odd_folder, name):
    assert compare(spark, odd_folder, name)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_takes_odd_rows_and_empty_tables(spark, odd_folder, tmp_path, name):
    want = spark.read.parquet(f"{odd_folder}/{'pages' if name.startswith(('op6', 'op9')) else 'documents'}.parquet").count()
    want = {"op12_centroid_clusters": 23, "op13_filter_audit": 5 * 600}.get(name, want)
    got = QUERIES[name](spark, odd_folder)
    assert got.count() == want or name == "op2_secret_scan"
    for t in TABLES:
        spark.read.parquet(f"{odd_folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    empty = QUERIES[name](spark, str(tmp_path))
    assert empty.collect() == [] and empty.dtypes == got.dtypes
