"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a run of ``LEAST`` or more key-like signs, with ``=`` as padding at its end only, so that the name of an
unspaced assignment is no part of it; in quotes, a run without white space of any other signs too. Where a secret's name
is assigned, ``SHORT`` signs are enough, and between quotes all up to the closing one count. Its features are its length, shares of digits, capitals and
signs, changes between kinds of characters and between vowels and consonants, entropy, the share of it that common
words cover, the path of its document, and the words around it (whether it is assigned or quoted, whether a word for
secrets or for samples stands before it).

The forest is trained on labelled findings, at most ``train_findings`` of them, drawn by a digest (a documented
bound); every candidate of every text is scored. Without labels of a reviewer, ``seed_labels`` labels the clear cases: a
mixed value assigned to a secret's name is one, a plain word, number, address or host name is none; the
forest decides the rest.

Defined results: a null or empty text has no candidates; a null path counts as an empty one; repeated rows have their
findings each; equal candidates of a text are findings each, told apart by ``nth``; if the labels lack one of both
kinds, the seed label itself is the score (0 where there is none: without a forest, only clear cases are secrets); an empty table gives no findings; further columns
are not read by ``scan_secrets`` and stay as they are in ``redact_secrets``.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import LOWER, UPPER, Bloom, content_key, stored

LEAST, SHORT, BEFORE, AFTER = 16, 8, 60, 24
SIGNS = r"A-Za-z0-9+/_.\-"
SECRET_WORDS = "token|secret|passwd|password|pwd|api_?key|access_?key|private_?key|auth|bearer|credential"
SAMPLE_WORDS = "example|sample|dummy|fake|test|placeholder|changeme|your"
COMMON_WORDS = ("the|and|for|with|that|this|from|have|not|are|was|you|your|all|any|can|one|out|use|new|key|name|value|data|file|path|test|user|example|"
                "sample|config|default|string|number|index|list|table|page|home|mail|host|server|client|http|https|www|com|org|net")
# a secret's name and an assignment stand before; the cheap looks back come first
PADDING = rf"(?:={{1,2}}(?![{SIGNS}=\"']))?"
NAMED = rf"(?<=[=:>\s\"'])(?<=[=:>]\s{{0,4}}[\"']?)(?<=(?i:{SECRET_WORDS})[\w\-]{{0,16}}[\"']?\s{{0,4}}[=:>]{{1,2}}\s{{0,4}}[\"']?)"
CANDIDATE = "|".join([
    rf"(?<=\"){NAMED}[^\"\r\n]{{{SHORT},}}+(?=\")", rf"(?<='){NAMED}[^'\r\n]{{{SHORT},}}+(?=')",
    rf"(?<=\")[^\s\"]{{{LEAST},}}+(?=\")", rf"(?<=')[^\s']{{{LEAST},}}+(?=')",
    rf"(?<![{SIGNS}]){NAMED}[{SIGNS}!@#$%^&*?~]{{{SHORT},}}+{PADDING}",
    rf"(?<![{SIGNS}])[{SIGNS}]{{{LEAST},}}+{PADDING}"])
FEATURES = ["f_length", "f_digits", "f_upper", "f_signs", "f_changes", "f_vowel_runs", "f_distinct", "f_entropy", "f_dictionary",
            "f_path_depth", "f_path_sample", "f_named", "f_sample", "f_assigned", "f_quoted", "f_words_before"]
PLACEHOLDER = "[SECRET]"


def split_text(text: Column) -> tuple[Column, Column]:
    """The candidates of a text, and the pieces before, between and after them (one more)."""
    return F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE)


def candidates(docs: DataFrame, doc_id: str, text: str, path: str) -> DataFrame:
    """Stored: _row, _key, doc_id, path, nth, value, gap (characters before it since the last one), before and after (of the
    whole text)."""
    found, pieces = split_text(F.col("_t"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.col(text).alias("_t")).where(F.col("_t").rlike(CANDIDATE))
    rows = rows.select("doc_id", "path", content_key(F.col("_t")).alias("_key"), F.monotonically_increasing_id().alias("_row"), found.alias("_found"), pieces.alias("_pieces"))
    each = rows.select("*", F.posexplode("_found").alias("nth", "value"))
    gap = F.get("_pieces", F.col("nth"))
    # each candidate has SHORT signs or more, so this many neighbours fill what is looked at of the whole text
    part = lambda array, k, cut, n: F.coalesce(cut(F.get(array, F.col("nth") + k), F.lit(n)), F.lit(""))
    before = [part(a, -k, F.right, BEFORE) for k in range(BEFORE // SHORT + 1, 0, -1) for a in ("_pieces", "_found")]
    after = [part(a, k, F.left, AFTER) for k in range(1, AFTER // SHORT + 2) for a in ("_pieces", "_found")]
    return stored(each.select("_row", "_key", "doc_id", "path", "nth", "value", F.char_length(gap).alias("gap"), F.right(F.concat(*before, F.right(gap, F.lit(BEFORE))), F.lit(BEFORE)).alias("before"),
                              F.left(F.concat(*after), F.lit(AFTER)).alias("after")), "secret-candidates")


def with_features(found: DataFrame) -> DataFrame:
    value, n = F.col("value"), F.char_length("value").cast("double")
    low, before, path = F.translate(value, UPPER, LOWER), F.lower("before"), F.lower("path")
    share = lambda signs: 1 - F.char_length(F.regexp_replace(value, signs, "")) / n
    runs = lambda c: F.char_length(F.regexp_replace(c, r"(.)\1+", "$1")).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[A-Z]", "A"), "[a-z]", "a")
    sounds = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, "[^a-z]", "."), "[aeiouy]", "e"), "[b-df-hj-np-tv-xz]", "b")
    chars = F.array_remove(F.split(value, "(?!^)"), "")
    counts = F.transform(F.array_distinct("_c"), lambda c: (n - F.char_length(F.replace(value, c, F.lit("")))) / n)
    bits = F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p))
    flag = lambda c: c.cast("double")
    out = found.withColumn("_c", chars).withColumns({
        "f_length": n, "f_digits": share("[0-9]"), "f_upper": share("[A-Z]"), "f_signs": share("[^A-Za-z0-9]"), "f_changes": runs(kinds) / n, "f_vowel_runs": runs(sounds) / n,
        "f_distinct": F.size(F.array_distinct("_c")).cast("double"), "f_entropy": bits, "f_dictionary": 1 - F.char_length(F.regexp_replace(low, COMMON_WORDS, "")) / n,
        "f_path_depth": F.size(F.split(path, "/")).cast("double"), "f_path_sample": flag(path.rlike(SAMPLE_WORDS)),
        "f_named": flag(before.rlike(rf"({SECRET_WORDS})[\w\-]{{0,16}}\W*$")), "f_sample": flag(before.rlike(SAMPLE_WORDS)),
        "f_assigned": flag(before.rlike(r"[=:]\s*[\"']?$")), "f_quoted": flag(before.rlike("[\"']$") & F.col("after").rlike("^[\"']")),
        "f_words_before": F.size(F.split(before, r"\W+")).cast("double")})
    return out.drop("_c")


def seed_labels() -> Column:
    """1 or 0 for the clear cases, else null."""
    # a short value cannot have 3 bits a sign; it must come near what its length allows
    mixed = (F.col("f_digits") > 0.1) & (F.col("f_digits") < 0.9) & (F.col("f_entropy") > F.least(F.lit(3.0), 0.85 * F.log2("f_length")))
    named = (F.col("f_named") == 1) & (F.col("f_assigned") == 1) & (F.col("f_sample") == 0)
    address = F.col("value").rlike(r"^[0-9.]+$") | F.col("before").endswith("@") | F.col("after").startswith("@") | F.col("value").rlike(r"^[A-Za-z0-9\-]+(\.[a-z0-9\-]+)*\.[a-z]{2,6}$")
    plain = (F.col("f_digits") == 0) | (F.col("f_digits") == 1)
    return F.when(named & mixed, 1.0).when((plain & ~(named & (F.col("f_signs") + F.col("f_upper") > 0))) | address, 0.0)


def fit_forest(labelled: DataFrame, train_findings: int, trees: int, depth: int, seed: int):
    """Forest from rows with the features and ``label``; None if a kind is missing. The rows are dealt by their
    digest, so that a rerun sees them alike."""
    digest = F.xxhash64("_key", "nth", "value")
    known = labelled.where(F.col("label").isNotNull())
    kinds = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        return None
    # half of the places for each kind: findings are rare, and plain words are not
    share = F.lit(0.0)
    for label, n in kinds.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, train_findings / 2 / n))).otherwise(share)
    drawn = known.where(F.pmod(digest, F.lit(1 << 30)) < share * (1 << 30)).select("label", *FEATURES, digest.alias("_d"))
    dealt = stored(drawn.repartition(4, "_d").sortWithinPartitions("_d", *FEATURES), "secret-training")
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(dealt)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(ready)


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source", labels: DataFrame | None = None, threshold: float = 0.5,
                 train_findings: int = 20_000, trees: int = 20, depth: int = 6, seed: int = 5) -> DataFrame:
    """Every candidate: doc_id, nth, start (characters from 0), length, value, score, secret, path, _key.
    ``labels``: doc_id, nth, label of reviewed findings; without it the seed labels are learnt."""
    found = candidates(docs, doc_id, text, path)
    order = W.partitionBy("_row").orderBy("nth").rowsBetween(W.unboundedPreceding, W.currentRow)
    start = F.sum(F.col("gap") + F.char_length("value")).over(order) - F.char_length("value")
    rows = with_features(found.withColumn("start", start))
    labelled = rows.withColumn("label", seed_labels()) if labels is None else rows.join(labels.select("doc_id", "nth", F.col("label").cast("double").alias("label")), ["doc_id", "nth"])
    forest = fit_forest(labelled, train_findings, trees, depth, seed)
    if forest is None:
        scored = rows.withColumn("score", F.coalesce(seed_labels(), F.lit(0.0)))
    else:
        judged = forest.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
        scored = judged.withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select("doc_id", "nth", "start", F.char_length("value").alias("length"), "value", "score", (F.col("score") >= threshold).alias("secret"), "path", "_key")


def redact_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source", **options) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by a placeholder; no row goes. Only texts that a Bloom filter of
    texts with secrets lets through are joined; all others pass as they are."""
    kept = docs.columns
    found = scan_secrets(docs, doc_id=doc_id, text=text, path=path, **options).where("secret")
    per_text = stored(found.groupBy("_key", "path").agg(F.collect_set("nth").alias("_nth")), "secret-places")
    bloom = Bloom(per_text.select(F.xxhash64("_key", "path").alias("h")), "h")
    rows = docs.withColumns({"_key": content_key(F.col(text)), "_path": F.coalesce(F.col(path).cast("string"), F.lit(""))})
    rows = rows.withColumn("_hit", bloom.may_hold(F.xxhash64("_key", "_path")))
    hits = rows.where("_hit").join(per_text.withColumnRenamed("path", "_path"), ["_key", "_path"], "left")
    values, pieces = split_text(F.col(text))
    hits = hits.withColumns({"_v": values, "_p": pieces})
    parts = F.transform("_p", lambda p, i: F.concat(p, F.when(F.array_contains("_nth", i), F.lit(PLACEHOLDER)).otherwise(F.coalesce(F.get("_v", i), F.lit("")))))
    hits = hits.withColumn(text, F.when(F.col("_nth").isNotNull(), F.array_join(parts, "")).otherwise(F.col(text)))
    return rows.where("not _hit").select(*kept).unionByName(hits.select(*kept))
