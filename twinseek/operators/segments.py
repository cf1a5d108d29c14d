"""Candidate pairs for edit distance on short texts: an equi-join on pairs of segments.

The shorter text of a pair is cut into two segments more than edits are possible, so at least two of them stand unchanged
in the longer text. Both are one join key: a single common ending, say, then brings nothing together. How far the two can
have moved is bounded by the edits before, between and after them. Texts with few possible edits have long segments and
few shifts; `segmented` says which sizes are handled here, the others are left to grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinseek.functions.measures import Measure
from twinseek.operators.signatures import HALVES, may_differ, signature
from twinseek.plans.layout import KEY_ROWS

# Segments have at least so many characters, and a pair at most so many edits.
SEGMENT_CHARS = 4
MOST_EDITS = 3
EPS = 1e-9


def _edits(size: Column, t: Column) -> Column:
    """Edits that keep the score of a pair whose longer text has this size at t or above."""
    return F.floor((1.0 - t) * size + EPS).cast("int")


def _segments(size: Column, floor: float) -> Column:
    """Number of segments of a text of this size: the most edits a pair with a longer text can have, plus two."""
    return _edits(F.floor(size / F.lit(floor) + EPS), F.lit(floor)) + 2


def segmented(size: Column, floor: float) -> Column:
    """May pairs whose shorter text has this size be found by segments?"""
    n = _segments(size, floor)
    return (n <= MOST_EDITS + 2) & (size >= n * SEGMENT_CHARS)


def _placed(rows: DataFrame, name: str) -> DataFrame:
    """Adds start and width of segment `name` (its number) of a text of `l` characters cut into `n` pieces as equal as possible."""
    base, longer, i = F.floor(F.col("l") / F.col("n")).cast("int"), F.col("l") % F.col("n"), F.col(name)
    start = i * base + F.greatest(F.lit(0), i - (F.col("n") - longer))
    width = base + (i >= F.col("n") - longer).cast("int")
    return rows.withColumn(f"start_{name}", start.cast("int")).withColumn(f"width_{name}", width.cast("int"))


def _keyed(rows: DataFrame, shift_i: Column, shift_j: Column) -> DataFrame:
    pieces = [F.substring(F.col("payload"), F.col(f"start_{x}") + by + 1, F.col(f"width_{x}")) for x, by in (("i", shift_i), ("j", shift_j))]
    return rows.withColumn("key", F.xxhash64("l", "i", "j", *pieces))


def _paired(rows: DataFrame) -> DataFrame:
    """One row for each two segments i < j."""
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("j") - 1)))
    return _placed(_placed(rows, "i"), "j")


def segment_pairs(
    smaller: DataFrame, larger: DataFrame, measure: Measure, floor: float, ties: str, key_rows: int = KEY_ROWS
) -> DataFrame:
    """(small_cid, large_cid, threshold) of classes that may reach their threshold, the smaller ones of a `segmented` size.

    `ties` as in `overlap_pairs`. Keys of many classes are dealt to a square grid, so that no key gathers more than about
    `key_rows` of either side.
    """
    zero = F.lit(0)
    cut = smaller.filter(segmented(F.col("size"), floor) & (F.col("size") > 0))
    cut = cut.select("cid", "size", "t", "payload", *signature(measure, floor), F.col("size").alias("l"), _segments(F.col("size"), floor).alias("n"))
    cut = _keyed(_paired(cut), zero, zero).select(
        "key", F.col("l").alias("small_size"), F.col("cid").alias("small_cid"), F.col("t").alias("small_t"),
        *[F.col(x).alias(f"small_{x}") for x in HALVES],
    )
    strict = F.greatest(F.col("t"), F.lit(floor))
    shortest = F.greatest(F.lit(1), F.ceil(strict * F.col("size") - EPS).cast("int"))
    sizes = F.filter(F.sequence(shortest, F.greatest(shortest, F.col("size"))), lambda x: segmented(x, floor) & (x <= F.col("size")))
    probe = larger.select("cid", "size", "t", "payload", *signature(measure, floor), _edits(F.col("size"), strict).alias("k"), F.explode(sizes).alias("l"))
    probe = _paired(probe.withColumn("n", _segments(F.col("l"), floor)))
    for x in ("i", "j"):
        probe = probe.withColumn(f"by_{x}", F.explode(F.sequence(-F.col("k"), F.col("k"))))
    by_i, by_j, longer = F.col("by_i"), F.col("by_j"), F.col("size") - F.col("l")
    spent = F.abs(by_i) + F.abs(by_j - by_i) + F.abs(longer - by_j)
    inside = (F.col("start_i") + by_i >= 0) & (F.col("start_j") + by_j + F.col("width_j") <= F.col("size"))
    probe = _keyed(probe.filter((spent <= F.col("k")) & inside), by_i, by_j)
    probe = probe.select(
        "key", "l", F.col("size").alias("large_size"), F.col("cid").alias("large_cid"), F.col("t").alias("large_t"),
        *[F.col(x).alias(f"large_{x}") for x in HALVES],
    ).distinct()

    held = cut.groupBy("key").agg(F.count("*").alias("a")).join(probe.groupBy("key").agg(F.count("*").alias("b")), "key")
    hot = held.filter(F.greatest("a", "b") > key_rows)
    hot = hot.select("key", F.ceil(F.greatest("a", "b") / F.lit(float(key_rows))).cast("bigint").alias("grid"))
    width = F.coalesce("grid", F.lit(1).cast("bigint"))
    others = F.explode(F.sequence(F.lit(0).cast("bigint"), width - 1))

    def dealt(side: DataFrame, cid: str, own: str, other: str) -> DataFrame:
        return side.join(hot, "key", "left").withColumn(own, F.pmod(F.xxhash64(cid), width)).withColumn(other, others).drop("grid")

    met = dealt(cut, "small_cid", "row", "column").join(dealt(probe, "large_cid", "column", "row"), ["key", "row", "column"])
    equal = {"once": F.col("small_cid") < F.col("large_cid"), "all": F.lit(True), "none": F.lit(False)}[ties]
    small, large = F.col("small_size"), F.col("large_size")
    threshold = F.greatest("small_t", "large_t")
    met = met.filter((small == F.col("l")) & ((small < large) | ((small == large) & equal)) & (threshold > 0) & (small >= threshold * large - EPS))
    met = met.filter(may_differ(measure, small, large, threshold))
    return met.select("small_cid", "large_cid", threshold.alias("threshold")).distinct()
