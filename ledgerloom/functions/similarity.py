"""Measures of how alike two texts are.

Set measures are Columns.  Ratcliff-Obershelp matching has no built-in; it is a
pandas UDF, to be put behind the cheap measures.
"""

from __future__ import annotations

import difflib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType

from .text import let, norm_upper


def char_trigrams(c: Column) -> Column:
    """The different runs of three characters, spaces aside; a shorter text is its own."""
    def grams(s: Column) -> Column:
        whole = F.when(s == "", F.array().cast("array<string>")).otherwise(F.array(s))
        return F.when(F.length(s) < 3, whole).otherwise(let(F.split(s, ""), runs))

    def runs(chars: Column) -> Column:  # places in an array are found at once, places in a text are not
        return F.array_distinct(F.transform(F.slice(chars, F.lit(1), F.size(chars) - 2), lambda x, i: F.concat(x, chars[i + 1], chars[i + 2])))

    return let(F.replace(norm_upper(c), F.lit(" "), F.lit("")), grams)


def _share(a: Column, b: Column, of: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / of).otherwise(F.lit(0.0))


def overlap_of_larger(a: Column, b: Column) -> Column:
    return _share(a, b, F.greatest(F.size(a), F.size(b)))


#: Codes as alike as this are one, mistyped.
NEAR_TYPO = 0.82

#: Codes up to this length are found by what they must have in common: at most 220 keys for 12 characters and one length of the other code.
KEYED_LENGTH = 12


@pandas_udf(ArrayType(StringType()))
def subsequences(codes: pd.Series, lengths: pd.Series) -> pd.Series:
    """All that is left of a code when it is cut down to a length, whichever characters go."""
    return pd.Series([list({"".join(x) for x in combinations(code, n)}) for code, n in zip(codes, lengths)])


def overlap_of_smaller(a: Column, b: Column) -> Column:
    return _share(a, b, F.least(F.size(a), F.size(b)))


def jaccard(a: Column, b: Column) -> Column:
    return _share(a, b, F.size(F.array_union(a, b)))


def jaccard_of_sets(a: Column, b: Column) -> Column:
    """``jaccard`` of arrays without repeats, whose union need not be built."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))).otherwise(F.lit(0.0))


def best_span(target: Column, text: Column) -> Column:
    """The largest share of the words of ``target`` that stand in place in some stretch of ``text`` of that length."""
    at = F.sequence(F.lit(0), F.greatest(F.size(text) - F.size(target), F.lit(0)))
    hits = lambda i: F.aggregate(F.zip_with(target, F.slice(text, i + 1, F.greatest(F.size(target), F.lit(1))), lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))), F.lit(0), lambda s, x: s + x)
    return F.when((F.size(target) > 0) & (F.size(text) > 0), F.array_max(F.transform(at, hits)) / F.size(target)).otherwise(F.lit(0.0))


def _ratio(a: str | None, b: str | None) -> float:
    if a and a == b and len(a) < 200:  # from there on characters met too often are passed over
        return 1.0
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters over all; equal pairs are matched once."""
    memo: dict[tuple, float] = {}
    out = []
    for pair in zip(a, b):
        if pair not in memo:
            if len(memo) > 20_000:
                memo.clear()
            memo[pair] = _ratio(*pair)
        out.append(memo[pair])
    return pd.Series(out, dtype="float64")


@pandas_udf(DoubleType())
def ratio_if_among_two(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """The sequence ratio of two texts, or null where their pair is surely not among the two best of its group.

    Columns: group, points the pair has without the ratio, weight of the ratio, extra points
    it may still bring, and the texts.  A pair is passed over if even the share of
    common characters, which no ratio exceeds, leaves it below two pairs of its group
    that were matched before.  Whatever the order, no pair of the two best is passed
    over; the most are if groups come together, best points first.
    """
    group, first, second = None, -math.inf, -math.inf
    for keys, points, weights, extras, left, right in parts:
        out = []
        for key, base, weight, extra, a, b in zip(keys, points, weights, extras, left, right):
            if key != group:
                group, first, second = key, -math.inf, -math.inf
            a, b = a or "", b or ""
            most = base + weight + extra
            if second > -math.inf and most >= second - 1e-9 and a and b:
                most = base + weight * min(1.0, 2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b))) + extra
            if most < second - 1e-9:
                out.append(None)
                continue
            ratio = _ratio(a, b)
            out.append(ratio)
            score = base + weight * ratio  # what it has at least
            first, second = max(first, score), max(second, min(first, score))
        yield pd.Series(out, dtype="float64")


# it depends on the rows before: it must neither be asked twice nor moved below a sort
ratio_if_among_two = ratio_if_among_two.asNondeterministic()


def text_similarity(a: Column, b: Column) -> Column:
    """1 if equal; by length if one begins with the other; else the sequence ratio."""
    x, y = norm_upper(a), norm_upper(b)
    shorter, longer = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    return (
        F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(x.startswith(y) | y.startswith(x), F.lit(0.82) + shorter / longer * F.lit(0.16)).otherwise(sequence_ratio(x, y))
    )


def contains_description(target: Column, text: Column) -> Column:
    """Is ``target`` within ``text``: as it stands, word by word for the most part, or by likeness."""
    t, s = norm_upper(target), norm_upper(text)
    return (t != "") & (F.contains(s, t) | (best_span(F.split(t, " "), F.split(s, " ")) >= 0.82) | (text_similarity(target, text) >= 0.92))


def code_relation(a: Column, b: Column) -> Column:
    """exact, truncation (one or two last characters missing), near_typo or divergent."""
    gap = F.abs(F.length(a) - F.length(b))
    cut = gap.between(1, 2) & (F.least(F.length(a), F.length(b)) >= 4) & (a.startswith(b) | b.startswith(a))
    # no ratio exceeds what the edits leave in common; texts beyond that, and those told already, are not matched
    near = (a != b) & ~cut & (F.levenshtein(a, b) <= (F.length(a) + F.length(b)) * (1 - NEAR_TYPO) + 1e-9)
    return F.when((a == "") | (b == ""), "divergent").when(a == b, "exact").when(cut, "truncation").when(sequence_ratio(F.when(near, a), b) >= NEAR_TYPO, "near_typo").otherwise("divergent")


@pandas_udf(StringType())
def longest_common_words(a: pd.Series, b: pd.Series) -> pd.Series:
    """The longest run of words that both texts have; empty if none."""
    out = []
    for x, y in zip(a, b):
        x, y = (x or "").split(), (y or "").split()
        m = difflib.SequenceMatcher(None, x, y, autojunk=False).find_longest_match()
        out.append(" ".join(x[m.a : m.a + m.size]))
    return pd.Series(out)


@pandas_udf(StringType())
def without_neighbours(text: pd.Series, neighbours: pd.Series) -> pd.Series:
    """The text without runs of three words and more that a neighbour has."""
    out = []
    for words, near in zip(text, neighbours):
        words = (words or "").split()
        for other in near if near is not None else ():
            other = (other or "").split()
            while True:
                m = difflib.SequenceMatcher(None, words, other, autojunk=False).find_longest_match()
                if m.size < 3:
                    break
                del words[m.a : m.a + m.size]
        out.append(" ".join(words))
    return pd.Series(out)
