"""Audit of five text filters applied in every order: what each removes, alone, first, after others, and on the whole.

All 120 orders are settled by 32 numbers a part: how many documents each coalition (set of filters) removes together.
What a step removes is the difference of two coalitions; what is left, redundant or failing only there follows the same
way. A filter's Shapley value is the solution of a least-squares problem: weights for the filters, whose sums come as
near to the coalitions' removals as can be under the Shapley kernel, and add up exactly to what all five remove. The
normal equations with that condition are solved once in fractions for a removal of one by each coalition alone; the
solution is linear, so the value of every part is a sum of whole multiples of its 32 numbers.

Filters, as bits in this order: A under 50 words; B less than 65 % distinct words; C over 5 % of A-Z; D holds one of
``#$%&*|``; E equals the text of a smaller doc_id anywhere in the table.

Defined results: null and empty text are the same text without words, which fails A only (and E after a smaller id);
null and empty ``source`` are one part. A null id is neither smaller nor larger than others, so its rows never fail E
and cause no failure. Rows of one id are no copies of each other, and each counts. A document is good or toxic if any
row of ``labels`` with its id says so; null ids have no labels. An empty table gives no rows; further columns are not
read.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5


def text_failures(text: Column, words: Column) -> Column:
    """Bits of the filters that look at the text alone."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    failed = [n < LEAST_WORDS, distinct.cast("long") * 100 < n.cast("long") * LEAST_DISTINCT, capitals * 100 > F.length(text).cast("long") * MOST_CAPITALS, text.rlike(r"[#$%&*|]")]
    bits = F.lit(0)
    for i, f in enumerate(failed):
        bits = bits + F.when(f, 1 << i).otherwise(0)
    return bits


def failure_cells(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, mask (failed filters), good, toxic, n. Rows are folded by text digest, id and part before anything is
    joined, and the joins are on the id, so that neither a common text nor a repeated id meets in one task."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"), text_failures(F.col("text"), F.col("words")).alias("mask"))
    folded = stored(rows.groupBy("key", "doc_id", "part", "mask").agg(F.count("*").alias("n")), "folded-documents")
    firsts = folded.where(F.col("doc_id").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    marks = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))])
    marks = stored(marks.where("good or toxic"), "marked-ids")
    known = folded.join(stored(firsts, "first-ids").withColumn("first", F.lit(True)), ["key", "doc_id"], "left").join(marks, "doc_id", "left")
    repeated = F.col("doc_id").isNotNull() & F.col("first").isNull()
    cells = known.select("part", (F.col("mask") + F.when(repeated, 16).otherwise(0)).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "n")
    return cells.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """Solution of a small linear system with several right sides, exactly."""
    rows = [a + b for a, b in zip(matrix, right, strict=True)]
    size = len(rows)
    for i in range(size):
        at = next(k for k in range(i, size) if rows[k][i])
        rows[i], rows[at] = rows[at], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for k in range(size):
            if k != i and rows[k][i]:
                rows[k] = [x - rows[k][i] * y for x, y in zip(rows[k], rows[i], strict=True)]
    return [r[size:] for r in rows]


def shapley_multiples(filters: int = len(FILTERS)) -> list[list[int]]:
    """For each filter, what each coalition's removal counts for in its Shapley value times the number of orders."""
    everything = (1 << filters) - 1
    inside = lambda s: [s >> i & 1 for i in range(filters)]
    size = lambda s: sum(inside(s))
    weight = {s: Fraction(filters - 1, comb(filters, size(s)) * size(s) * (filters - size(s))) for s in range(1, everything)}
    normal = [[sum(w * inside(s)[i] * inside(s)[k] for s, w in weight.items()) for k in range(filters)] + [Fraction(1)] for i in range(filters)]
    normal.append([Fraction(1)] * filters + [Fraction(0)])
    right = [[weight[s] * inside(s)[i] if s in weight else Fraction(0) for s in range(1 << filters)] for i in range(filters)]
    right.append([Fraction(s == everything) for s in range(1 << filters)])
    found = [[x * factorial(filters) for x in row] for row in solve(normal, right)[:filters]]
    assert all(x.denominator == 1 for row in found for x in row)
    return [[int(x) for x in row] for row in found]


def coalition_removals(cells: DataFrame) -> DataFrame:
    """part, total, and for all, good and toxic documents the number that each of the 32 coalitions removes."""
    def removed(kept: Column) -> Column:
        return F.array(*[F.sum(F.when((F.col("mask").bitwiseAND(F.lit(s)) != 0) & kept, F.col("n")).otherwise(0)) for s in range(1 << len(FILTERS))])

    return cells.groupBy("part").agg(F.sum("n").alias("total"), removed(F.lit(True)).alias("all"), removed(F.col("good")).alias("good"), removed(F.col("toxic")).alias("toxic"))


def audit_steps() -> Column:
    """All steps of all orders: order, step, filter, the coalition of it alone, coalitions before and after it."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for k, i in enumerate(order):
            steps.append(F.struct(F.lit("".join(FILTERS[j] for j in order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(i).alias("filter"), F.lit(1 << i).alias("own"), F.lit(before).alias("before"), F.lit(before | 1 << i).alias("after")))
            before |= 1 << i
    return F.array(*steps)


def audit_filters(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    parts = coalition_removals(failure_cells(docs, labels, doc_id, text, part))
    everything = (1 << len(FILTERS)) - 1
    values, alone = [], []
    for i, multiples in enumerate(shapley_multiples()):
        values.append(sum((F.get("all", F.lit(s)) * m for s, m in enumerate(multiples) if m), F.lit(0).cast("long")))
        alone.append(F.get("all", F.lit(everything)) - F.get("all", F.lit(everything ^ 1 << i)))
    rows = parts.select("part", "total", "all", "good", "toxic", F.array(*values).alias("values"), F.array(*alone).alias("alone"), F.explode(audit_steps()).alias("s"))
    gain = lambda counts: F.get(counts, F.col("s.after")) - F.get(counts, F.col("s.before"))
    single = F.get("all", F.col("s.own"))
    return rows.select("part", "s.filter_order", "s.step", (F.col("total") - F.get("all", F.col("s.after"))).alias("kept"), gain("all").alias("removed"), (single - gain("all")).alias("redundant"),
                       F.get("alone", F.col("s.filter")).alias("unique_fails"), gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"), F.get("values", F.col("s.filter")).alias("shapley"))
