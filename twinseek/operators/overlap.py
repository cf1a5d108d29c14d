"""Candidate pairs for a similarity join: an equi-join on rare shared features.

Features of a set are ordered rare first (by a table of fixed size that tells how many sets hold them, then by hash), the
same order for all sets; every set orders and cuts its own features, so that only prefixes are shuffled. A pair that must share `need` features has its first shared feature among the first ``count - need + 1`` of both
sides, so only these prefixes are joined (prefix filter). Sizes, positions, bit signatures and the number of shared prefix
features then bound the possible overlap of a pair. All bounds are safe: no pair that reaches its threshold is lost. The caller
computes the exact score.

A feature is one BIGINT: rarity in the high bits, a hash in the low ones. Two features with the same number look like
one feature that occurs twice, which can only raise the overlap of a pair, never lose it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinseek.functions.measures import Measure, Tier
from twinseek.operators.segments import segmented
from twinseek.operators.signatures import COMMON, EPS, HALVES, may_differ, may_differ_from, parity_words, signature, sketch
from twinseek.plans.layout import KEY_ROWS

ROUNDING = 1e-6
HASH_BITS = 50
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # odd multipliers of the gram hash
# Rarity is kept as log2 of the holders in steps of 1/64: exact for rare features, within about 1 % for common ones.
RARITY_STEPS = 64
# Features are counted by bucket of their hash.
BUCKETS = 1 << 20
# The common features, which a signature stands for, are those above this share of all postings in the order.
COMMON_FROM = 0.3
# Postings that a Python worker takes at once, beyond whole keys, and pairs of them that it tests at once.
CHUNK_ROWS, CHUNK_PAIRS = 100_000, 300_000
# Grams of this length are rare enough to join all of them, which makes the shared count exact.
LONG_GRAM = 6


def gram_hashes(text: str, size: int) -> np.ndarray:
    """Hashes of the character grams of a text; the second, third, ... occurrence of a gram hashes differently.

    Array arithmetic over the code points of a text; as column functions it takes about ten times as long.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n = max(0, len(codes) - size + 1)
    grams = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        grams = (grams ^ codes[i : i + n]) * MIX
        grams ^= grams >> np.uint64(29)
    grams.sort()
    place = np.arange(n, dtype=np.uint64)
    first = np.ones(n, dtype=bool)
    first[1:] = grams[1:] != grams[:-1]
    nth = place - np.maximum.accumulate(np.where(first, place, 0).astype(np.uint64))
    mixed = (grams ^ (nth * STEP)) * MIX
    return (mixed ^ (mixed >> np.uint64(32))).view(np.int64)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _gram_buckets(texts: pd.Series, q: pd.Series) -> pd.Series:
    return pd.Series([(gram_hashes(t, n) & (BUCKETS - 1)).astype(np.int32) for t, n in zip(texts, q)])


_OF_TOKENS = T.StructType(
    [
        T.StructField("ordered", T.ArrayType(T.LongType())), T.StructField("rare", T.IntegerType()),
        *[T.StructField(x, T.LongType()) for x in COMMON], T.StructField("sketch", T.BinaryType()),
    ]
)


def _by_tier(tiers: list[Tier], value: str) -> Column:
    out = None
    for tier in tiers:
        v = F.lit(getattr(tier, value)).cast("int")
        out = F.when(F.col("q") == tier.q, v) if out is None else out.when(F.col("q") == tier.q, v)
    return out


def _tiers_of(size: Column, tiers: list[Tier], measure: Measure, floor: float) -> Column:
    """Gram lengths under which a text of this size can still meet a partner."""
    picks = []
    for tier in tiers:
        low = F.lit(tier.low)
        fits = (size >= low) | measure.size_ok(size.cast("double"), low, F.lit(floor))
        if tier.high is not None:
            fits = fits & (size < tier.high)
        picks.append(F.when(fits, F.lit(tier.q)))
    return F.array_compact(F.array(*picks))


def _listed(classes: DataFrame, measure: Measure, tiers: list[Tier], floor: float) -> DataFrame:
    """`classes` with `q`, one row for each gram length a class needs, and `m`, how many features it has."""
    if measure.by_tokens:
        return classes.withColumn("q", F.lit(tiers[0].q)).withColumn("m", F.size("payload"))
    tier = F.explode(_tiers_of(F.col("size"), tiers, measure, floor))
    return classes.withColumn("q", tier).withColumn("m", F.greatest(F.lit(0), F.col("size") - F.col("q") + 1))


def bucket_counts(classes: DataFrame, measure: Measure, floor: float) -> DataFrame:
    """(b, n): holders of the features of each bucket, at most BUCKETS rows whatever the input.

    Counts are added up by bucket before they are shuffled.
    """
    listed = _listed(classes, measure, measure.tiers(floor), floor)
    if measure.by_tokens:
        bucket = F.transform("payload", lambda x: F.xxhash64(x).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
    else:
        bucket = _gram_buckets("payload", "q")
    return listed.select(F.explode(bucket).alias("b")).groupBy("b").agg(F.count("*").alias("n"))


def rarity_table(counts: DataFrame) -> np.ndarray:
    """How common features are, by bucket of their hash: 0 for none, else 1 + log2 of the holders in steps of 1/64.

    Features that share a bucket look more common than they are; the order stays one and the same for all sets, which is
    all the join relies on.
    """
    counted = counts.toArrow()
    table = np.zeros(BUCKETS, np.int16)  # every task gets the table; 63 doublings of the holders are 4,033 steps
    table[counted["b"].to_numpy()] = np.floor(np.log2(counted["n"].to_numpy()) * RARITY_STEPS).astype(np.int16) + 1
    return table


def common_rarity(rarity: np.ndarray) -> int:
    """The least rarity of a common feature; it follows from the order alone, so that all sets of an index agree on it."""
    held = np.bincount(rarity, np.where(rarity > 0, 2.0 ** ((rarity - 1) / RARITY_STEPS), 0.0))
    upto = np.cumsum(held)
    return int(np.searchsorted(upto, COMMON_FROM * upto[-1], side="right")) + 1


def prefixes(classes: DataFrame, measure: Measure, floor: float, rarity: np.ndarray) -> DataFrame:
    """One row per class and tier with its rare-first feature prefix. Features are ordered and cut inside the row."""
    tiers = measure.tiers(floor)
    rows = _listed(classes, measure, tiers, floor).withColumn("t_eff", F.greatest("t", F.lit(floor)))
    low, q, size, t = _by_tier(tiers, "low"), F.col("q"), F.col("size"), F.col("t_eff")

    def prefix_length(pair: tuple[Column, Column]) -> Column:
        need = F.ceil(measure.shared_min(pair[0], pair[1], t, q) - ROUNDING)
        # A prefix longer by x makes the pair share x more features inside it: worth it for common features.
        longer = F.lit(0) if measure.by_tokens else F.greatest(F.lit(0), F.when(q >= LONG_GRAM, need - 1).otherwise(F.floor(need / 2)))
        return F.greatest(F.lit(0), F.least(F.col("m"), F.col("m") - need + 1 + longer)).cast("int")

    sized = rows.withColumn("p_small", prefix_length(measure.worst_small(size, low, t))).withColumn(
        "p_large", F.when(size >= low, prefix_length(measure.worst_large(size, low, t))).otherwise(F.lit(0))
    )
    if measure.segments:  # pairs with such a smaller text are found by `segment_pairs`
        sized = sized.withColumn("p_small", F.when(segmented(size, floor), 0).otherwise(F.col("p_small")))
    sized = sized.withColumn("keep", F.greatest("p_small", "p_large")).filter("keep > 0")
    shared, bits = classes.sparkSession.sparkContext.broadcast(rarity), HASH_BITS

    def rarest(hashes: np.ndarray, n: int) -> np.ndarray:
        packed = shared.value[hashes & (BUCKETS - 1)].astype(np.int64) << bits | hashes & ((1 << bits) - 1)
        return np.sort(packed)[:n]

    common = common_rarity(rarity)

    @F.pandas_udf(_OF_TOKENS)
    def of_tokens(hashes: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = []
        for h, k in zip(hashes, n):
            h = np.asarray(h, np.int64)
            many = h[shared.value[h & (BUCKETS - 1)] >= common]
            rows.append((rarest(h, k), len(h) - len(many), *parity_words(many, len(COMMON)), sketch(h)))
        return pd.DataFrame(rows, columns=_OF_TOKENS.fieldNames())

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def of_grams(texts: pd.Series, size: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([rarest(gram_hashes(t, s), k) for t, s, k in zip(texts, size, n)])

    keys = ["cid", "q", "size", "t", "m", "p_small", "p_large"]
    if not measure.by_tokens:
        none = [F.lit(None).cast("int").alias("rare"), *[F.lit(None).cast("bigint").alias(x) for x in COMMON], F.lit(None).cast("binary").alias("sketch")]
        return sized.select(*keys, *signature(measure, floor), *none, of_grams("payload", "q", "keep").alias("ordered"))
    hashed = F.transform("payload", lambda x: F.xxhash64(x))
    listed = sized.select(*keys, *signature(measure, floor), of_tokens(hashed, "keep").alias("_f"))
    return listed.select(*keys, *HALVES, "_f.rare", *[f"_f.{x}" for x in COMMON], "_f.sketch", "_f.ordered")


def _postings(
    prefix: DataFrame, role: str, least_holders: int, key_rows: int, holders_now: DataFrame | None = None, part: tuple[int, int] | None = None
) -> DataFrame:
    """Prefix features of one role that enough sets hold; with `part` (i, n) those of the i-th of n parts of all features.

    Features of many holders are dealt to a square grid of keys: each side is cut into as many parts as the grid is wide,
    and each part meets every part of the other side once. `holders_now` (b, n) tells of buckets that have become common
    since the order was frozen.
    """
    least = {0: 0, 1: 1, 2: RARITY_STEPS + 1}[least_holders]
    listed = prefix.select("*", F.posexplode(F.slice("ordered", F.lit(1), F.col(f"p_{role}"))).alias("pos", "feature"))
    listed = listed.filter(F.col("feature") >= (least << HASH_BITS))
    if part is not None:
        listed = listed.filter(F.pmod("feature", F.lit(part[1])) == part[0])
    holders = F.pow(F.lit(2.0), F.shiftright("feature", HASH_BITS) / RARITY_STEPS)
    if holders_now is not None:  # at most BUCKETS rows of two numbers
        listed = listed.withColumn("b", F.col("feature").bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).join(F.broadcast(holders_now), "b", "left")
        holders = F.greatest(holders, F.col("n").cast("double"))
    width = F.ceil(holders / F.lit(float(key_rows))).cast("bigint")
    own = F.pmod(F.xxhash64("cid"), width)
    listed = listed.withColumn("_own", own).withColumn("width", width).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), width - 1)))
    at = ("_own", "_other") if role == "small" else ("_other", "_own")
    # The feature before this one, -1 if there is none that could be met.
    earlier = F.get("ordered", F.col("pos") - 1)
    listed = listed.withColumn("earlier", F.when(earlier >= (least << HASH_BITS), earlier).otherwise(F.lit(-1)))
    return listed.select(
        "q", "feature", F.col(at[0]).alias("row"), F.col(at[1]).alias("column"),
        *[F.col(c).alias(f"{role}_{c}") for c in ("cid", "size", "t", "m", "pos", *HALVES, "rare", *COMMON, "earlier", "width", "p_small")],
    )


_MET = "small_cid long, large_cid long, threshold double"


def _whole_keys(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Rows that come ordered by `keys`, at least CHUNK_ROWS at once but for the last, and the number of each row's key; no key is cut."""
    held, n = [], 0

    def columns(table: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray]:
        found = {name: table[name].to_numpy() for name in table.column_names}
        new = np.zeros(table.num_rows, dtype=np.int64)
        for k in keys:
            new[1:] |= found[k][1:] != found[k][:-1]
        return found, np.cumsum(new)

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < CHUNK_ROWS:
            continue
        table = pa.Table.from_batches(held)
        found, number = columns(table)
        cut = int(np.searchsorted(number, number[-1]))
        held, n = table.slice(cut).to_batches(), n - cut
        if cut:
            yield {name: x[:cut] for name, x in found.items()}, number[:cut]
    if n:
        yield columns(pa.Table.from_batches(held))


def _token_meets(differ_max: Callable, size_ok: Callable, shared_min: Callable, ties: str) -> Callable:
    """Pairs of postings of token sets, in Arrow batches ordered by key, that pass the tests of `overlap_pairs`.

    Only partners of a possible size are listed. A pair whose features before these are one and the same has met there.
    """

    def tested(c: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        small, large, t = c["size"][a], c["size"][b], np.maximum(c["t"][a], c["t"][b])
        ok = (t > 0) & size_ok(small, large, t) & ((c["earlier"][a] != c["earlier"][b]) | (c["earlier"][a] < 0))
        if ties != "all":
            ok &= (small < large) | (c["cid"][a] < c["cid"][b]) if ties == "once" else small < large
        a, b, small, large, t = (x[ok] for x in (a, b, small, large, t))
        pa_, pb, allowed = c["pos"][a], c["pos"][b], differ_max(small, large, t) + EPS
        rest_a, rest_b = c["m"][a] - pa_, c["m"][b] - pb
        rare_a, rare_b = c["rare"][a], c["rare"][b]
        one_side = np.minimum(pa_, rare_a) + np.minimum(pb, rare_b)
        ok = np.minimum(pa_, pb) + np.minimum(rest_a, rest_b) >= np.ceil(shared_min(small, large, t, 0) - ROUNDING)
        ok &= pa_ + pb + np.abs(rest_a - rest_b) <= allowed
        ok &= one_side + np.abs((small - rare_a) - (large - rare_b)) <= allowed
        a, b, t, allowed, one_side = (x[ok] for x in (a, b, t, allowed, one_side))
        for words, besides in ((COMMON, one_side), (HALVES, 0)):
            bits = np.zeros(len(a), np.int64)
            for x in words:
                bits += np.bitwise_count((c[x][a] ^ c[x][b]).view(np.uint64))  # of a signed number it would count the absolute value
            ok = bits + besides <= allowed
            if words is HALVES:
                ok |= ~(c["signed"][a] & c["signed"][b])
            a, b, t, allowed = (x[ok] for x in (a, b, t, allowed))
        return pa.RecordBatch.from_arrays([pa.array(c["cid"][a]), pa.array(c["cid"][b]), pa.array(t)], ["small_cid", "large_cid", "threshold"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, key in _whole_keys(batches, ["feature", "row", "column"]):
            c["size"], c["m"], c["pos"], c["rare"] = (c[x].astype(np.int64) for x in ("size", "m", "pos", "rare"))
            place = key << 32 | c["size"]
            larger, smaller = np.flatnonzero(c["is_large"]), np.flatnonzero(c["is_small"])
            larger = larger[np.argsort(place[larger])]
            with np.errstate(divide="ignore"):
                most = np.minimum((c["size"][smaller] + 1) / c["t"][smaller] + 1, 2.0**31).astype(np.int64)
            low = np.searchsorted(place[larger], place[smaller])
            high = np.searchsorted(place[larger], key[smaller] << 32 | most, side="right")
            upto = np.cumsum(high - low)
            at = 0
            while at < len(smaller):
                done = upto[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(upto, done + CHUNK_PAIRS, side="right")))
                n = high[at:end] - low[at:end]
                if n.sum():
                    first = np.repeat(low[at:end] - (np.cumsum(n) - n), n)
                    yield tested(c, np.repeat(smaller[at:end], n), larger[first + np.arange(len(first))])
                at = end

    return met


def _token_candidates(smaller: DataFrame, larger: DataFrame, measure: Measure, ties: str, holders: int, key_rows: int, more: tuple) -> DataFrame:
    """`overlap_pairs` of token sets. A posting of a table that meets itself is sent once for both roles, unless its key is split."""
    columns = ("cid", "size", "t", "m", "pos", "rare", "earlier", *COMMON)

    def listed(role: str, postings: DataFrame, also: Column) -> DataFrame:
        here = F.lit(True)
        return postings.select(
            "feature", "row", "column", *[F.col(f"{role}_{x}").alias(x) for x in columns], *[F.coalesce(f"{role}_{x}", F.lit(0).cast("bigint")).alias(x) for x in HALVES],
            F.col(f"{role}_{HALVES[0]}").isNotNull().alias("signed"), (here if role == "small" else also).alias("is_small"), (also if role == "small" else here).alias("is_large"),
        )

    small, large = (_postings(x, role, holders, key_rows, *more) for role, x in (("small", smaller), ("large", larger)))
    both, none = F.lit(False), F.lit(False)
    if smaller is larger:  # the prefix of the larger role is the longer one
        both, small = (F.col("large_width") == 1) & (F.col("large_pos") < F.col("large_p_small")), small.filter("small_width > 1")
    dealt = listed("small", small, none).unionByName(listed("large", large, both)).repartition("feature", "row", "column")
    met = _token_meets(measure.differ_max, measure.size_ok, measure.shared_min, ties)
    found = dealt.sortWithinPartitions("feature", "row", "column").mapInArrow(met, _MET)
    return found.groupBy("small_cid", "large_cid").agg(F.max("threshold").alias("threshold"))


def overlap_pairs(
    smaller: DataFrame, larger: DataFrame, measure: Measure, floor: float, ties: str, key_rows: int = KEY_ROWS, few: str | None = None,
    holders_now: DataFrame | None = None, part: tuple[int, int] | None = None,
) -> DataFrame:
    """(small_cid, large_cid, threshold): pairs of sets, one of each table of prefixes, that may reach their threshold.

    The first is not larger than the second. `ties` says which pairs of equal size count: "once" (both tables are the
    same one, and a pair is taken in one order), "all" or "none". `few` names the side ("small" or "large") that was counted to
    be small enough to be broadcast, so that the other one is not shuffled. `floor` is the smallest positive threshold in use. Pairs
    whose threshold is 0 are not covered. `holders_now` is given if sets were added after the order of features was frozen:
    features that are unknown to the order then count too. `part` (i, n), for token sets: the pairs that meet on the i-th of n
    parts of all features; all parts together give all pairs, some of them several times.
    """
    tiers = measure.tiers(floor)
    bounds = [(tier.q, tier.high) for tier in tiers if tier.high is not None]
    small, large = F.col("small_size"), F.col("large_size")
    threshold = F.greatest("small_t", "large_t")
    need = F.ceil(measure.shared_min(small, large, threshold, F.col("q")) - ROUNDING)
    rest = F.least(F.col("small_m") - F.col("small_pos"), F.col("large_m") - F.col("large_pos"))
    reachable = F.least("small_pos", "large_pos") + rest >= need
    equal = {"once": F.col("small_cid") < F.col("large_cid"), "all": F.lit(True), "none": F.lit(False)}[ties]
    holders = 0 if holders_now is not None else 2 if ties == "once" else 1
    more = () if holders_now is None and part is None else (holders_now, part)
    if measure.by_tokens and not few:
        return _token_candidates(smaller, larger, measure, ties, holders, key_rows, more)
    sides = {role: _postings(sets, role, holders, key_rows, *more) for role, sets in (("small", smaller), ("large", larger))}
    if few:
        sides[few] = F.broadcast(sides[few])
    met = sides["small"].join(sides["large"], ["feature", "q", "row", "column"])
    met = met.filter(
        ((small < large) | ((small == large) & equal)) & (threshold > 0) & measure.size_ok(small, large, threshold) & reachable
        & may_differ(measure, small, large, threshold)
    )
    for q, high in bounds:
        met = met.filter((F.col("q") != q) | (large < high))
    if measure.by_tokens:
        first = met.filter(may_differ_from(measure, small, large, threshold))
        return first.groupBy("small_cid", "large_cid").agg(F.max(threshold).alias("threshold"))
    bounded = met.withColumn("need", need).withColumn("threshold", threshold).groupBy("small_cid", "large_cid").agg(
        F.count("*").alias("shared"),
        F.max("small_pos").alias("small_pos"),
        F.max("large_pos").alias("large_pos"),
        F.max("small_m").alias("small_m"),
        F.max("large_m").alias("large_m"),
        F.max("need").alias("need"),
        F.max("threshold").alias("threshold"),
    )
    rest = F.least(F.col("small_m") - F.col("small_pos"), F.col("large_m") - F.col("large_pos")) - 1
    return bounded.filter(F.col("shared") + rest >= F.col("need")).select("small_cid", "large_cid", "threshold")
