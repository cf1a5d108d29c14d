"""Similarity measures: score expressions, the bounds that make them joinable, and their registry.

Each measure names the features two units must share (distinct tokens, or character grams counted with repeats) and a
lower bound on how many they share when their score reaches a threshold. The match join turns that bound into an
equi-join on rare features; the exact score decides.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinseek.functions.text import TOKEN_PATTERN, token_set

# Slack for floating-point rounding, used in bounds only, never in the final comparison.
EPS = 1e-9


def jaccard_of_sets(a: Column, b: Column) -> Column:
    """Shared / all distinct tokens of two token sets; two empty sets are equal."""
    both = F.size(a) + F.size(b)

    def share(shared: Column) -> Column:
        union = both - shared
        return F.when(union == 0, F.lit(1.0)).otherwise(shared.cast("double") / union.cast("double"))

    # The one-element array keeps the intersection from being computed at each of its three uses.
    return F.transform(F.array(F.size(F.array_intersect(a, b))), share)[0]


def jaccard_score(a: Column, b: Column) -> Column:
    # In a one-element array each token set is made once, however often the score names it.
    sets = F.array(F.struct(token_set(a).alias("a"), token_set(b).alias("b")))
    return F.transform(sets, lambda s: jaccard_of_sets(s["a"], s["b"]))[0]


def levenshtein_score(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, over code points."""
    longer = F.greatest(F.length(a), F.length(b))
    return (
        F.when(a == b, F.lit(1.0))
        .when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0))
        .otherwise(1.0 - F.levenshtein(a, b).cast("double") / longer.cast("double"))
    )


def levenshtein_score_above(a: Column, b: Column, threshold: Column) -> Column:
    """Same score, NULL as soon as it is sure to be below `threshold`; the work is bounded by the allowed edits."""
    longer = F.greatest(F.length(a), F.length(b))
    allowed = F.floor((1.0 - threshold) * longer + EPS).cast("int")
    # The one-element array keeps the distance from being computed at each of its uses.
    edits = F.array(F.call_function("levenshtein", a, b, allowed))
    score = F.transform(edits, lambda d: F.when(d >= 0, 1.0 - d.cast("double") / longer.cast("double")))[0]
    return F.when(a == b, F.lit(1.0)).otherwise(score)


@F.pandas_udf(T.DoubleType())
def sequence_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of `difflib.SequenceMatcher(None, a, b)`; the order of the arguments matters."""
    return pd.Series([1.0 if x == y else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def _sequence_score_above(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    # The matcher keeps what it learned about its second text; rows come ordered by that text.
    matcher, known = SequenceMatcher(), ""
    for a, b, threshold in batches:
        scores = []
        for x, y, t in zip(a, b, threshold):
            if x == y:
                scores.append(1.0)
                continue
            if y != known:
                matcher.set_seq2(y)
                known = y
            matcher.set_seq1(x)
            possible = matcher.real_quick_ratio() >= t - EPS and matcher.quick_ratio() >= t - EPS
            scores.append(matcher.ratio() if possible else None)
        yield pd.Series(scores, dtype="float64")


@dataclass(frozen=True)
class Tier:
    """One choice of feature: grams of `q` characters, for pairs whose longer text has `low` <= length < `high`."""

    q: int
    low: int
    high: int | None


@dataclass(frozen=True)
class Measure:
    """A similarity measure and its bounds.

    size_ok(small, large, t)        may sizes small <= large reach t?
    shared_min(small, large, t, q)  lower bound on the shared features of a pair that reaches t
    worst_small(size, low, t)       (small, large) of the pair with the weakest bound, seen from its smaller side
    worst_large(size, low, t)       the same, seen from its larger side
    tiers(t)                        features to use, by length of the longer text
    differ_max(small, large, t)     upper bound on the marks (distinct tokens, or characters with repeats) that only one of a
                                    pair has that reaches t
    possible(a, b, t)               a cheap test that fails only for pairs below t
    segments                        may short texts be met by unchanged segments (edit distance)?
    wide_below                      thresholds under this prune so little that the caller has to ask for it
    """

    name: str
    description: str
    symmetric: bool
    by_tokens: bool
    score: Callable[[Column, Column], Column]
    score_above: Callable[[Column, Column, Column], Column]
    size_ok: Callable[[Column, Column, Column], Column]
    shared_min: Callable[[Column, Column, Column, Column], Column]
    worst_small: Callable[[Column, Column, Column], tuple[Column, Column]]
    worst_large: Callable[[Column, Column, Column], tuple[Column, Column]]
    tiers: Callable[[float], list[Tier]]
    wide_below: float
    differ_max: Callable[[Column, Column, Column], Column]
    possible: Callable[[Column, Column, Column], Column] | None = None
    segments: bool = False


def _ratio_ok(small: Column, large: Column, t: Column) -> Column:
    return small >= t * large - EPS


def _jaccard_shared(small: Column, large: Column, t: Column, q: Column) -> Column:
    return t / (1.0 + t) * (small + large)


def _jaccard_differ(small: Column, large: Column, t: Column) -> Column:
    return (1.0 - t) / (1.0 + t) * (small + large)


def _edit_differ(small: Column, large: Column, t: Column) -> Column:
    # A replaced character counts twice, an inserted or deleted one once, and the lengths tell how many of these there are.
    return 2 * F.floor((1.0 - t) * large + EPS) - (large - small)


def _sequence_differ(small: Column, large: Column, t: Column) -> Column:
    return (1.0 - t) * (small + large)


def _edit_shared(small: Column, large: Column, t: Column, q: Column) -> Column:
    # Each edit touches at most q grams of the longer text.
    return large - q + 1 - q * (1.0 - t) * large


def _sequence_shared(small: Column, large: Column, t: Column, q: Column) -> Column:
    # Characters outside the common blocks: at most (1 - t) of all. One of them spoils q grams of its own text and
    # q - 1 grams of the other; averaged over both texts.
    total = small + large
    return total / 2.0 - q + 1 - (q - 0.5) * (1.0 - t) * total


def _sequence_ok(small: Column, large: Column, t: Column) -> Column:
    return 2.0 * small >= t * (small + large) - EPS


def _sequence_possible(a: Column, b: Column, t: Column) -> Column:
    # The characters outside the common blocks, at most (1 - t) of all, can be edited one by one. Only for short texts
    # is the edit distance cheaper than the ratio.
    total = F.length(a) + F.length(b)
    allowed = F.floor((1.0 - t) * total + EPS).cast("int")
    return (total > 4 * SHORT_TEXT) | (F.call_function("levenshtein", a, b, allowed) >= 0)


# Long grams are rare, so that few texts meet, but an edit spoils more of them, so that fewer have to be shared. In short
# texts the second effect is stronger: grams that leave a bound below this share of the length are kept for longer ones.
SHORT_TEXT = 64
SHORT_TEXT_SHARE = 0.7


def _gram_tiers(slope: Callable[[int], float], margin: float) -> list[Tier]:
    """Longest usable gram first: with grams of length q a pair shares at least slope(q) * length - (q - 1)."""
    usable = [q for q in range(1, 9) if q == 1 or slope(q) >= margin - 1e-6]
    lows = {q: math.floor((q - 1.0) / slope(q) + 1e-6) + 1 if q > 1 else 1 for q in usable}
    lows = {q: max(low, SHORT_TEXT) if q > 1 and slope(q) < SHORT_TEXT_SHARE - 1e-6 else low for q, low in lows.items()}
    tiers, high = [], None
    for q in reversed(usable):
        if high is None or lows[q] < high:
            tiers.append(Tier(q, lows[q], high))
            high = lows[q]
    return tiers


def _edit_tiers(t: float) -> list[Tier]:
    return _gram_tiers(lambda q: 1.0 - q * (1.0 - t), 0.5)


def _sequence_tiers(t: float) -> list[Tier]:
    # The weakest pair with a longer text of length x has x * 2 / (2 - t) characters in all.
    share = 2.0 / (2.0 - t)
    return _gram_tiers(lambda q: share * (0.5 - (q - 0.5) * (1.0 - t)), 0.2)


MEASURES = {
    m.name: m
    for m in (
        Measure(
            name="jaccard_tokens",
            description="Shared share of the distinct tokens (Jaccard coefficient)",
            symmetric=True,
            by_tokens=True,
            score=jaccard_score,
            score_above=lambda a, b, t: jaccard_of_sets(a, b),
            size_ok=_ratio_ok,
            shared_min=_jaccard_shared,
            worst_small=lambda n, low, t: (n, n),
            worst_large=lambda n, low, t: (t * n, n),
            tiers=lambda t: [Tier(0, 1, None)],
            wide_below=EPS,
            differ_max=_jaccard_differ,
        ),
        Measure(
            name="sequence_matcher",
            description="Ratio of difflib.SequenceMatcher",
            symmetric=False,
            by_tokens=False,
            score=sequence_score,
            score_above=_sequence_score_above,
            size_ok=_sequence_ok,
            shared_min=_sequence_shared,
            worst_small=lambda n, low, t: (
                F.greatest(n.cast("double"), low * t / (2.0 - t)),
                F.greatest(n, low),
            ),
            worst_large=lambda n, low, t: (n * t / (2.0 - t), n),
            tiers=_sequence_tiers,
            wide_below=0.5,
            differ_max=_sequence_differ,
            possible=_sequence_possible,
        ),
        Measure(
            name="levenshtein_norm",
            description="Normalised edit distance",
            symmetric=True,
            by_tokens=False,
            score=levenshtein_score,
            score_above=levenshtein_score_above,
            size_ok=_ratio_ok,
            shared_min=_edit_shared,
            worst_small=lambda n, low, t: (n, F.greatest(n, low)),
            worst_large=lambda n, low, t: (n, n),
            tiers=_edit_tiers,
            wide_below=0.5,
            differ_max=_edit_differ,
            segments=True,
        ),
    )
}


def get_measure(name: str) -> Measure:
    if name not in MEASURES:
        raise ValueError(f"no measure is called {name!r}; there are {', '.join(sorted(MEASURES))}")
    return MEASURES[name]


def available_measures() -> dict[str, str]:
    return {m.name: m.description for m in MEASURES.values()}


def register_measures(spark: SparkSession) -> None:
    """Makes the measures callable from SQL text, under their registry names.

    The two built-in ones become SQL functions that the optimizer inlines; only the sequence ratio runs in Python.
    """
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION token_set(body STRING) RETURNS ARRAY<STRING> RETURN
        array_distinct(regexp_extract_all(body, r'(?U){TOKEN_PATTERN}', 0))"""
    )
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION jaccard_tokens(a STRING, b STRING) RETURNS DOUBLE RETURN
        transform(array(named_struct('x', token_set(a), 'y', token_set(b))), s -> CASE WHEN size(s.x) + size(s.y) = 0 THEN 1e0
          ELSE size(array_intersect(s.x, s.y)) / size(array_union(s.x, s.y)) END)[0]"""
    )
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION levenshtein_norm(a STRING, b STRING) RETURNS DOUBLE RETURN
        CASE WHEN a = b THEN 1e0 WHEN length(a) = 0 OR length(b) = 0 THEN 0e0
        ELSE 1e0 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE) END"""
    )
    spark.udf.register("sequence_matcher", sequence_score)


def add_score(pairs: DataFrame, method: str, a: str, b: str, out: str = "score") -> DataFrame:
    """Adds the score of one measure for two text columns, clamped to [0, 1]."""
    score = get_measure(method).score(F.col(a), F.col(b))
    # CASE keeps a missing score missing; greatest / least would skip it.
    return pairs.withColumn(out, score).withColumn(
        out, F.when(F.col(out) > 1.0, 1.0).when(F.col(out) < 0.0, 0.0).otherwise(F.col(out))
    )
