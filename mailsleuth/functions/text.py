"""Text rules: evasion-resistant matching text, keyword categories, lures, content patterns."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from . import rules as R


def blank(c) -> Column:
    """Missing text counts as empty text everywhere."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def matching_text(c: Column) -> Column:
    """Lower case, leet characters replaced, punctuation to blanks, spaced-out letters joined."""
    t = F.translate(F.lower(blank(c)), R.LEET_FROM, R.LEET_TO)
    t = F.regexp_replace(t, r"[^a-z0-9\s]", " ")
    t = F.regexp_replace(t, r"(?<=\b[a-z0-9])\s+(?=[a-z0-9]\b)", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


_JOIN_SINGLE = re.compile(r"(?<=\b[a-z0-9])\s+(?=[a-z0-9]\b)")


def matching_phrase(phrase: str) -> str:
    """The same normalisation for a rule phrase; rules are normalised once, when the plan is built."""
    t = phrase.lower().translate(str.maketrans(R.LEET_FROM, R.LEET_TO))
    t = _JOIN_SINGLE.sub("", re.sub(r"[^a-z0-9\s]", " ", t))
    return re.sub(r"\s+", " ", t).strip()


def hit_count(text: Column, phrases: list[str]) -> Column:
    total = F.lit(0)
    for p in phrases:
        total = total + F.contains(text, F.lit(p)).cast("int")
    return total


def phrase_ids(text: Column, phrases: list[str]) -> Column:
    """Sorted numbers of the phrases that stand anywhere in the text, by one pass of an automaton over it, whose cost does
    not depend on the number of phrases. Spark can only test phrase by phrase, so the texts go to Arrow workers; null
    and empty texts hold none. A worker without the automaton module tests phrase by phrase."""
    numbers: dict[str, list[int]] = {}
    for i, phrase in enumerate(phrases):
        numbers.setdefault(phrase, []).append(i)
    numbers.pop("", None)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def find(texts: pd.Series) -> pd.Series:
        try:
            import ahocorasick
            automaton = ahocorasick.Automaton()
            for phrase, own in numbers.items():
                automaton.add_word(phrase, own)
            if numbers:
                automaton.make_automaton()
            met = lambda x: (own for _, own in automaton.iter(x)) if numbers else ()
        except ImportError:
            met = lambda x: (own for phrase, own in numbers.items() if phrase in x)
        return texts.map(lambda x: sorted({i for own in met(x) for i in own}) if x else [])

    return find(text)


# all keywords in rule order, and the numbers of each category among them
KEYWORDS = [k for _, _, kws in R.KEYWORD_CATEGORIES for k in kws]
_ENDS = [sum(len(kws) for _, _, kws in R.KEYWORD_CATEGORIES[:i + 1]) for i in range(len(R.KEYWORD_CATEGORIES))]
KEYWORD_RANGES = [(end - len(kws), end) for end, (_, _, kws) in zip(_ENDS, R.KEYWORD_CATEGORIES)]


def keyword_ids(text: Column) -> Column:
    """Numbers of the keywords in an evasion-resistant text; the functions below take them."""
    return phrase_ids(text, [matching_phrase(k) for k in KEYWORDS])


def _within(a: int, b: int):
    return lambda i: (i >= a) & (i < b)


def category_matches(ids: Column) -> Column:
    """array<struct<category, weight, keywords>> over all categories with at least one hit."""
    shown = F.array(*[F.lit(k) for k in KEYWORDS])
    return F.filter(F.array(*[
        F.struct(F.lit(name).alias("category"), F.lit(weight).alias("weight"),
                 F.transform(F.filter(ids, _within(a, b)), lambda i: F.get(shown, i)).alias("keywords"))
        for (name, weight, _), (a, b) in zip(R.KEYWORD_CATEGORIES, KEYWORD_RANGES)]), lambda m: F.size(m["keywords"]) > 0)


def _held(ids: Column, a: int, b: int) -> Column:
    return F.exists(ids, _within(a, b))


def keyword_score(ids: Column) -> Column:
    """Sum of the weights of the categories hit, capped."""
    raw = F.lit(0)
    for (_, weight, _), (a, b) in zip(R.KEYWORD_CATEGORIES, KEYWORD_RANGES):
        if weight:
            raw = raw + F.when(_held(ids, a, b), weight).otherwise(0)
    return F.least(F.lit(R.KEYWORD_CAP), raw)


def categories_hit(ids: Column) -> Column:
    return F.array_compact(F.array(*[F.when(_held(ids, a, b), F.lit(name)) for (name, *_), (a, b) in zip(R.KEYWORD_CATEGORIES, KEYWORD_RANGES)]))


LURE_TERMS = [term for *_, terms in R.LURES for term in terms]


def lure_counts(ids: Column) -> dict[str, Column]:
    """Number of terms of each lure list, from the numbers of ``LURE_TERMS`` in a lower-case text."""
    out, begin = {}, 0
    for key, *_, terms in R.LURES:
        end = begin + len(terms)
        out[key] = F.size(F.filter(ids, _within(begin, end)))
        begin = end
    return out


def lure_score(points: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for key, _, weight, _, _ in R.LURES:
        total = total + points[key] * F.lit(weight)
    return F.least(F.lit(100), F.floor(total).cast("int"))


def lure_level(score: Column, text: Column) -> Column:
    level = F.when(F.trim(text) == "", "Minimal")
    for floor_, name in R.LURE_LEVELS:
        level = level.when(score >= floor_, name)
    return level.otherwise("Low")


def lure_tactics(points: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(points[key] > 0, F.lit(tactic)) for key, _, _, tactic, _ in R.LURES]))


_WORDS = r"\(\?:([a-z|]+)\)"


def _outer_words(pattern: str) -> list[list[str]]:
    """The plain words of the group that a pattern begins with and of the one it ends with, where it has such: a text that the
    pattern matches holds a word of each."""
    ends = (re.match(r"\\b" + _WORDS + r"(?![?*{])", pattern), re.search(_WORDS + r"\\b$", pattern))
    return [] if _top_level_choice(pattern) else [m.group(1).split("|") for m in ends if m and "" not in m.group(1).split("|")]


def _top_level_choice(pattern: str) -> bool:
    depth = 0
    for c in re.sub(r"\[[^\]]*\]", "", re.sub(r"\\.", "", pattern)):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            return True
    return False


def content_labels(text: Column) -> Column:
    """Labels of the patterns that the text holds. A pattern is searched only in texts with its outer words: these tests of
    literals cost a small part of a regular expression, and few texts pass them."""
    def labels(x: Column) -> Column:
        held = lambda pattern: [reduce(or_, [F.contains(x["low"], F.lit(w)) for w in words]) for words in _outer_words(pattern)]
        return F.array_compact(F.array(*[F.when(reduce(and_, [*held(pat), x["text"].rlike("(?i)" + pat)]), F.lit(label))
                                         for label, pat in R.CONTENT_PATTERNS]))

    # a variable: as a common expression the lower-case text would be made again for every word wherever code is not generated
    return F.flatten(F.transform(F.array(F.struct(text.alias("text"), F.lower(text).alias("low"))), labels))


_INVISIBLE = re.compile("[\u200b-\u200f\ufeff\u202a-\u202e]")
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def fold_text(x: str) -> str:
    x = unicodedata.normalize("NFKC", html.unescape(x))
    if not x.isascii():
        x = _INVISIBLE.sub("", x)
    # split() takes these four for blanks too
    return _BLANKS.sub(" ", x).strip(" ") if any(c in x for c in "\x1c\x1d\x1e\x1f") else " ".join(x.split())


@F.pandas_udf(T.StringType())
def _content_text(s: pd.Series) -> pd.Series:
    return s.map(fold_text)


def content_text(c: Column) -> Column:
    """Entities decoded, compatibility forms folded, invisible characters dropped, blanks collapsed.

    Spark has neither an entity table nor NFKC, so the texts go to the Arrow worker, which does all four: regular
    expressions over whole texts in the JVM cost several times the way there and back."""
    return _content_text(blank(c))


@F.pandas_udf(T.StringType())
def unescape_html(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


def extract_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def sorted_set(arr: Column) -> Column:
    return F.array_sort(F.array_distinct(arr))
