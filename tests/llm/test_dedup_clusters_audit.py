"""Near-dedup, clusters and filter audit against plain versions, with odd rows and clashing names."""

import collections
import hashlib
import itertools
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsleuth.llm import centroid_clusters, filter_audit, near_dedup, wordhash

from .test_operators import near_copies
from .test_statements import odd_vectors

SF_DIR = "/root/testdata/sf0.001"
RUN = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ["label", "size", "hub", "share", "n", "_key", "_id", "digest", "mask", "words", "key", "first", "good", "part", "v", "x", "cluster", "distance", "best", "kept"]


def clashing(df):
    return df.withColumns({c: F.lit("mine") for c in CLASH if c not in df.columns})


def plain_components(rows):
    """n_shingles, component_id and kept of every row, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = RUN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    ids = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[find(i)].append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def family(rng, n, words=60, most=9):
    """A text and copies of it, so far apart that many copies are only linked through the text itself."""
    base = [f"f{rng.randrange(10 ** 6)}" for _ in range(words)]
    out = [" ".join(base)]
    for k in range(n):
        own = list(base)
        at = rng.randrange(words)
        for i in range(rng.randrange(most)):
            own[(at + i) % words] = f"n{k}-{i}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("block", "share"), [(256, 512), (4, 3)])
def test_near_dedup_loses_no_link(spark, block, share):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows, rng = [(r["doc_id"], r["text"]) for r in docs.collect()], random.Random(5)
    rows += [(9000 + i, t) for i, t in enumerate(near_copies(30, 1) + near_copies(12, 3) + family(rng, 40) + family(rng, 25, 90, 20))]
    rows += [(None, None), (9500, None), (9501, ""), (9502, " \t\n"), (9503, "two words"), (9504, "TWO\nwords "), (9504, "two words"), (9505, "two\x00words"), (9506, "two\xa0words"), (None, "a b c d e"), (9507, "A b c d e"), (9507, "x!"), (None, "only null"), (None, "only  null")]
    table = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = near_dedup.near_duplicates(table, block=block, share=share).collect()
    assert sorted(map(tuple, got), key=repr) == plain_components(rows)


def test_bands_find_pairs_at_the_threshold():
    rng, met, tried = np.random.default_rng(3), 0, 400
    for _ in range(tried):
        common = rng.integers(0, 1 << 63, 160, dtype=np.uint64)
        found = np.concatenate([common, rng.integers(0, 1 << 63, 20, dtype=np.uint64), common, rng.integers(0, 1 << 63, 20, dtype=np.uint64)])
        signatures = near_dedup.circulant_signatures(found, np.array([0, 180, 360]), near_dedup.BANDS * near_dedup.ROWS)
        a, b = near_dedup.band_labels(signatures, near_dedup.BANDS, near_dedup.ROWS)
        met += bool((a == b).any())
        assert abs((signatures[0] == signatures[1]).mean() - 0.8) < 0.15
    assert met == tried


def test_permutations_hit_every_place_once():
    for rounds in (near_dedup.SCATTER, near_dedup.VALUES):
        x = np.arange(1 << 22, dtype=np.uint32) * np.uint32(977)
        assert len(np.unique(near_dedup.permuted(x.copy(), rounds, np.empty_like(x)))) == len(x)


def test_long_texts_hash_as_whole_ones(monkeypatch):
    text = (" ".join(f"w{i}\x00é" for i in range(5000)) + "  \t end").encode()
    whole = near_dedup.ShingleSets().sets([text])[0]
    monkeypatch.setattr(near_dedup, "SLICE_BYTES", 64)
    assert (near_dedup.ShingleSets().sets([text])[0] == whole).all() and len(whole) == 4998
    assert near_dedup.ShingleSets().sets([b"x" * 1000])[0].size == 1
    assert [len(s) for s in near_dedup.ShingleSets().sets([b"", b" ", b"a", b"a b c d", b"a b c d e"])] == [0, 0, 1, 1, 2]
    assert wordhash.SLICE_BYTES > 64


def plain_clusters(rows, clusters=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:clusters]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((apart(v, c), k) for k, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        of = [k for _, k in assign()]
        for k in range(len(centroids)):
            own = [v for (_, v), at in zip(kept, of, strict=True) if at == k]
            if own:
                centroids[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found, inertia = assign(), collections.Counter()
    for d, k in found:
        inertia[k] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fits = lambda n: n if n < 1 << 63 else None  # noqa: E731  the columns are long
    return sorted(((i, k, fits(d), fits(inertia[k]), fits(sum(inertia.values())), digest[k]) for (i, _), (d, k) in zip(kept, found, strict=True)), key=repr)


@pytest.mark.parametrize("factor", [1, 3_000_000])
def test_clusters_against_plain_numbers(spark, factor):
    rows = [(i, v and [x if x is None or not math.isfinite(x) else x * factor for x in v], c) for i, v, c in odd_vectors()]
    rows += [(100 + r["vec_id"], [float(x) for x in r["embedding"]], 0) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").limit(60).collect()]
    table = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert centroid_clusters.number_kind(centroid_clusters.integer_vectors(table)) == ("bigint" if factor == 1 else centroid_clusters.WIDE)
    found, centroids = centroid_clusters.cluster_vectors(table)
    assert sorted(map(tuple, found.collect()), key=repr) == plain_clusters(rows) and len(centroids) == 8


def test_few_and_huge_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (None, [-3.0] * 64)]
    found, centroids = centroid_clusters.cluster_vectors(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, found.collect()), key=repr) == plain_clusters(rows) and len(centroids) == 3
    huge = centroid_clusters.cluster_vectors(spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)], schema))[0].collect()
    assert {r["vec_id"]: r["distance"] for r in huge} == {1: 0, 2: 0, 3: 0}
    none, centroids = centroid_clusters.cluster_vectors(spark.createDataFrame([(1, None)], schema))
    assert none.collect() == [] and centroids == []


def plain_audit(docs, labels):
    """Every order applied filter after filter."""
    good, toxic = ({d for d, *flags in labels if d is not None and flags[k] == 1} for k in (0, 1))
    failed = []
    for doc_id, text, source in docs:
        text = text or ""
        w = RUN.findall(text)
        conditions = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)),
                      doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in docs)]
        failed.append((doc_id, source or "", {f for f, c in zip("ABCDE", conditions, strict=True) if c}))
    out = []
    for part in {p for _, p, _ in failed}:
        rows, steps, total = [(d, f) for d, p, f in failed if p == part], [], collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for k, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[1]]
                before, left = left, [r for r in left if letter not in r[1]]
                steps.append((order, k, len(left), len(gone), sum(letter in f for _, f in rows) - sum(letter in f for _, f in before), sum(f == {letter} for _, f in rows), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)))
                total[letter] += len(gone)
        out += [(part, *s, total[s[0][s[1] - 1]]) for s in steps]
    return sorted(out)


def test_audit_against_every_order(spark):
    rng = random.Random(9)
    prose = lambda n, kinds: " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))
    docs = [(i, prose(rng.choice([20, 60, 90]), rng.choice([25, 500])) + rng.choice(["", " #", " " + "A" * 40]), rng.choice(["a", "b", "", None])) for i in range(60)]
    docs += [(100 + i, rng.choice(docs)[1], "b") for i in range(20)] + [(5, docs[5][1], "b"), (5, docs[5][1], "a"), (5, docs[5][1], "a"), (None, docs[5][1], "a"), (None, None, None), (200, None, "a"), (201, "", "c"), (202, "\t \n", "c")]
    docs += [(300, "AB é " * 60, "d"), (301, "é" * 94 + "ABCDE", "d"), (302, "é" * 95 + "ABCDE", "d")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 60, 2)] + [(5, 1, 0), (5, 0, 1), (5, 1, 0), (None, 1, 1), (999, 1, 1)]
    table = clashing(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    marks = clashing(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = filter_audit.audit_filters(table, marks).collect()
    assert sorted(map(tuple, got)) == plain_audit(docs, labels)


def test_least_squares_solution_is_the_mean_over_orders():
    rng = random.Random(1)
    removed = [0] + [rng.randrange(1000) for _ in range(31)]
    for i, multiples in enumerate(filter_audit.shapley_multiples()):
        mean = sum(removed[sum(1 << j for j in order[:order.index(i) + 1])] - removed[sum(1 << j for j in order[:order.index(i)])] for order in itertools.permutations(range(5)))
        assert sum(m * v for m, v in zip(multiples, removed, strict=True)) == mean
    assert filter_audit.solve([[Fraction(0), Fraction(2)], [Fraction(1), Fraction(1)]], [[Fraction(4)], [Fraction(5)]]) == [[3], [2]]
