"""Bit signatures: a bound on how much two feature sets differ, tested inside the candidate join.

A signature is 128 parity bits. Every mark of a set (a distinct token, or a character as often as it occurs) flips the bit of
its hash, so that two signatures differ in at most as many bits as there are marks that only one side has. Marks that share
a bit can only hide a difference. A pair that reaches its threshold is therefore never lost, and a pair that differs in more bits
than its measure allows is dropped before it is aggregated, shuffled or joined with its texts.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinseek.functions.measures import Measure

BITS = 128
# 64 bits each.
HALVES = ("bits_0", "bits_1")
# 64 bits each, of the common features of a token set.
COMMON = tuple(f"common_{i}" for i in range(8))
# Bits of a sketch for each feature of a set, rounded up to a power of two.
SKETCH_BITS = 3
EPS = 1e-6


def signature(measure: Measure, floor: float) -> list[Column]:
    """The two halves, from `payload` and `size` of a class; NULL where the bound for partners of equal size exceeds the bits."""
    marks = F.col("payload") if measure.by_tokens else F.split("payload", "")
    size = F.col("size")
    hashes = F.transform(marks, lambda x: F.xxhash64(x))

    def half(h: int) -> Column:
        def flip(bits: Column, x: Column) -> Column:
            mine = (F.shiftright(x, 6).bitwiseAND(F.lit(1)) == h).cast("bigint")
            return bits.bitwiseXOR(F.call_function("shiftleft", mine, x.bitwiseAND(F.lit(63)).cast("int")))

        return F.aggregate(hashes, F.lit(0).cast("bigint"), flip)

    useful = measure.differ_max(size, size, F.lit(floor)) < BITS
    return [F.when(useful, half(h)).alias(name) for h, name in enumerate(HALVES)]


def may_differ(measure: Measure, small: Column, large: Column, threshold: Column) -> Column:
    """May the sets behind `small_bits_*` and `large_bits_*` reach the threshold? True if a side has no signature."""
    differing = [F.bit_count(F.col(f"small_{x}").bitwiseXOR(F.col(f"large_{x}"))) for x in HALVES]
    return F.coalesce(differing[0] + differing[1] <= measure.differ_max(small, large, threshold) + EPS, F.lit(True))


def parity_words(hashes: np.ndarray, words: int) -> np.ndarray:
    """Parity bits of token hashes, `words` times 64. The low bits of a hash choose its bucket and are left out."""
    bits = words * 64
    odd = np.bincount((hashes >> 20) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch(hashes: np.ndarray) -> bytes:
    """Parity bits of all token hashes of a set; the larger the set, the more."""
    words = max(1, SKETCH_BITS * len(hashes) // 64)
    return parity_words(hashes, 1 << (words - 1).bit_length()).tobytes()


def _differing_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of sketches that have the same two lengths."""
    x, y = (np.frombuffer(b"".join(v), np.uint64).reshape(len(v), -1) for v in (a, b))
    n = min(x.shape[1], y.shape[1])
    x, y = (np.bitwise_xor.reduce(v.reshape(len(v), -1, n), axis=1) for v in (x, y))
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int32)


@F.pandas_udf(T.IntegerType())
def sketches_differ(a: pd.Series, b: pd.Series) -> pd.Series:
    """Differing bits of two sketches, at most as many as features that only one set has; the longer one is folded."""
    out, a, b = np.zeros(len(a), np.int32), a.to_numpy(), b.to_numpy()
    lengths = np.array([0 if x is None or y is None else len(x) << 32 | len(y) for x, y in zip(a, b)], np.int64)
    order = np.argsort(lengths)
    for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if len(rows) and lengths[rows[0]]:  # 0 without a sketch
            out[rows] = _differing_bits(a[rows], b[rows])
    return pd.Series(out)


def may_differ_from(measure: Measure, small: Column, large: Column, threshold: Column) -> Column:
    """May the pair reach the threshold if the features at `small_pos` and `large_pos` are the first that both sides have?

    The features before them are then on one side only. So are, of the common ones, at least as many as signatures differ
    in bits; `rare` features of a set are not common, and only these are counted before the common part. True for every pair
    that reaches the threshold at its first shared feature, where it is found; at later ones the answer does not matter.
    """
    before = F.least("small_pos", "small_rare") + F.least("large_pos", "large_rare")
    bits = reduce(add, [F.bit_count(F.col(f"small_{x}").bitwiseXOR(F.col(f"large_{x}"))) for x in COMMON])
    more = F.abs((small - F.col("small_rare")) - (large - F.col("large_rare")))
    after = F.abs((F.col("small_m") - F.col("small_pos")) - (F.col("large_m") - F.col("large_pos")))
    allowed = measure.differ_max(small, large, threshold) + EPS
    held = (before + F.greatest(bits, more) <= allowed) & (F.col("small_pos") + F.col("large_pos") + after <= allowed)
    return F.coalesce(held, F.lit(True))
