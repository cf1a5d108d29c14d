"""Labelled pairs: two units of one module are clones, two units of different modules are not.

The pairs of both kinds are numbered, and a pair is found from its number: which module (or module block) the number
falls into, then which two positions. Listing all pairs is the range [0, count); a sample is a set of drawn numbers. So
neither the cross-module pairs nor the pairs of a large module are ever built to choose from, and the work on a module
that holds a third of all units is cut into as many parts as any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinseek.plans.layout import (
    BIG, dense_index, draw, hash_hex, int_div, locate, lookup_join, running_totals, take_smallest,
)
from twinseek.schema import PAIR_SCHEMA
from twinseek.session import materialize


@dataclass
class PairIndex:
    """Units with their numbers, one row per module, and the two pair counts."""

    units: DataFrame
    modules: DataFrame
    n_modules: int
    n_same: int
    n_cross: int


def index_units(units: DataFrame, seed: int | str = 0) -> PairIndex:
    """`units(module, unit_key, name, body)`; `unit_key` is unique inside its module and gives the unit order there."""
    hashed = units.select("module", "unit_key", "name", "body").withColumn("_order", hash_hex(seed, F.col("unit_key")))
    sizes = hashed.groupBy("module").agg(F.count("*").alias("n"))
    starts = running_totals(sizes, "module", {"start": "n"})
    counts = starts.withColumn("same", int_div(F.col("n") * (F.col("n") - 1), F.lit(2))).withColumn(
        "cross", (F.col("n").cast(BIG) * F.col("start")).cast(BIG)
    )
    modules = materialize(running_totals(counts, "module", {"same_from": "same", "cross_from": "cross"}), "modules")
    totals = modules.agg(
        F.count("*").alias("m"), F.sum("n").alias("n"),
        F.sum(F.col("same").cast(BIG)).alias("same"), F.sum("cross").alias("cross"),
    ).first()
    placed = dense_index(hashed, ["module"], "_order", "pos", tie="unit_key")
    numbered = lookup_join(placed, modules.select("module", "n", "start"), ["module"], "n", int(totals["n"] or 0))
    numbered = numbered.withColumn("number", (F.col("start") + F.col("pos")).cast(BIG))
    stored = materialize(numbered.select("module", "unit_key", "name", "body", "pos", "number"), "numbered")
    return PairIndex(stored, modules, int(totals["m"]), int(totals["same"] or 0), int(totals["cross"] or 0))


def _cells(index: PairIndex) -> int:
    return max(1024, min(index.n_modules, 4_000_000))


def _pair_rows(numbers: DataFrame, index: PairIndex, clone: bool, order: str) -> DataFrame:
    """Units of the numbered pairs; of the two, the one with the smaller `order` column comes first."""
    columns = ["module", "unit_key", "name", "body"]

    def side(s: str) -> DataFrame:
        return index.units.select(F.col("number").alias(f"_{s}"), *[F.col(c).alias(f"{s}_{c}") for c in columns])

    both = numbers.join(side("a"), "_a").join(side("b"), "_b")
    a_first = F.col(f"a_{order}") <= F.col(f"b_{order}")
    first = lambda c: F.when(a_first, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    second = lambda c: F.when(a_first, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}"))
    return both.select(
        first("body").alias("func1"),
        second("body").alias("func2"),
        first("name").alias("func1_name"),
        second("name").alias("func2_name"),
        F.lit(clone).alias("clone"),
        first("module").alias("source_module1"),
        second("module").alias("source_module2"),
        first("unit_key").alias("unit_key1"),
        second("unit_key").alias("unit_key2"),
    )


def same_group_pairs(index: PairIndex, k: int | None = None, seed: int = 42) -> DataFrame:
    """Pairs inside a module, each once, in unit order: all of them, or `k` drawn ones."""
    spark = index.modules.sparkSession
    k = index.n_same if k is None else min(k, index.n_same)
    points = draw(spark, index.n_same, k, f"{seed}:same", "point")
    spans = index.modules.withColumn("same_to", (F.col("same_from") + F.col("same")).cast(BIG))
    spans = spans.select("module", "start", "same_from", "same_to")
    at = locate(points, "point", spans, "same_from", "same_to", _cells(index), index.n_same)
    # Offset o in the triangle of pairs (i < j): o = j (j - 1) / 2 + i. The root is corrected for rounding.
    o = (F.col("point") - F.col("same_from")).cast("bigint")
    guess = F.floor((1.0 + F.sqrt(1.0 + 8.0 * F.col("o"))) / 2.0)
    before = lambda j: int_div(j * (j - 1), F.lit(2))
    j = F.when(before(F.col("g")) > F.col("o"), F.col("g") - 1).when(
        before(F.col("g") + 1) <= F.col("o"), F.col("g") + 1
    ).otherwise(F.col("g"))
    at = at.withColumn("o", o).withColumn("g", guess).withColumn("j", j).withColumn("i", F.col("o") - before(F.col("j")))
    numbers = at.select(
        (F.col("start") + F.col("i")).cast(BIG).alias("_a"), (F.col("start") + F.col("j")).cast(BIG).alias("_b")
    )
    return _pair_rows(numbers, index, True, "unit_key")


def cross_group_pairs(index: PairIndex, k: int | None = None, seed: int = 42) -> DataFrame:
    """Pairs of different modules, each once, in module order: all of them, or `k` drawn ones."""
    spark = index.modules.sparkSession
    k = index.n_cross if k is None else min(k, index.n_cross)
    points = draw(spark, index.n_cross, k, f"{seed}:cross", "point")
    spans = index.modules.withColumn("cross_to", (F.col("cross_from") + F.col("cross")).cast(BIG))
    spans = spans.select("module", "start", "cross_from", "cross_to")
    at = locate(points, "point", spans, "cross_from", "cross_to", _cells(index), index.n_cross)
    # A unit meets the `start` units of all earlier modules.
    o = (F.col("point") - F.col("cross_from")).cast(BIG)
    numbers = at.select(
        (F.col("start") + int_div(o, F.col("start"))).cast(BIG).alias("_a"), (o % F.col("start")).cast(BIG).alias("_b")
    )
    return _pair_rows(numbers, index, False, "module")


def balanced_sizes(same: int, cross: int, clone_ratio: float) -> tuple[int, int]:
    """How many clone and non-clone pairs to take for a share of `clone_ratio` clones."""
    if same == 0 or cross == 0:
        return same, cross
    if clone_ratio >= 1.0:
        return same, 0
    if clone_ratio <= 0.0:
        return 0, cross
    # Odds are multiplied and divided left to right, so that rounding follows the stated formula.
    enough = cross * clone_ratio / (1 - clone_ratio)
    return (same, int(same * (1 - clone_ratio) / clone_ratio)) if same <= enough else (int(enough), cross)


def balanced_sample(index: PairIndex, clone_ratio: float = 0.5, seed: int = 42) -> DataFrame:
    """Labelled pairs with the requested share of clones; exact sizes, no pair twice, same seed same rows."""
    n_same, n_cross = balanced_sizes(index.n_same, index.n_cross, clone_ratio)
    return same_group_pairs(index, n_same, seed).unionByName(cross_group_pairs(index, n_cross, seed))


def to_pair_table(pairs: DataFrame) -> DataFrame:
    return pairs.select(*PAIR_SCHEMA.fieldNames())


def balance_stats(pairs: DataFrame, index: PairIndex) -> DataFrame:
    """Available and selected pairs per label and the share of the selected."""
    chosen = pairs.agg(F.count_if("clone").alias("t"), F.count_if(~F.col("clone")).alias("f"))
    share = lambda n: F.coalesce(F.try_divide(F.col(n).cast("double"), F.col("t") + F.col("f")), F.lit(0.0))
    row = lambda label, available, n: F.struct(
        F.lit(label).alias("clone"), F.lit(available).cast("bigint").alias("available"), F.col(n).alias("selected"),
        share(n).alias("share"),
    )
    return chosen.select(F.inline(F.array(row(True, index.n_same, "t"), row(False, index.n_cross, "f"))))


def pair_stats(pairs: DataFrame) -> DataFrame:
    """One row: counts, share of clones, text lengths."""
    a, b = F.length("func1"), F.length("func2")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return pairs.agg(
        F.count("*").alias("total_pairs"),
        F.count_if("clone").alias("true_clones"),
        F.count_if(~F.col("clone")).alias("false_clones"),
        F.coalesce(F.avg(F.col("clone").cast("int")), F.lit(0.0)).alias("clone_ratio"),
        F.coalesce(F.avg(a), F.lit(0.0)).alias("avg_func1_length"),
        F.coalesce(F.avg(b), F.lit(0.0)).alias("avg_func2_length"),
        zero(F.min(F.least(a, b))).alias("min_func_length"),
        zero(F.max(F.greatest(a, b))).alias("max_func_length"),
    )


def sample_modules(units: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """`n` modules that hold units, picked by a hash of the seed."""
    modules = units.select("module").distinct().withColumn("_order", hash_hex(seed, F.col("module")))
    return take_smallest(modules, "_order", n, "module").drop("_order")


def sample_one_per_module(units: DataFrame, seed: int = 42) -> DataFrame:
    """One unit per module. A unit is picked by hash, then looked up by its name: the first of equal names is taken."""
    named = units.withColumn("_order", hash_hex(seed, F.col("module"), F.col("unit_key")))
    per_name = named.groupBy("module", "name").agg(F.min("_order").alias("_order"), F.min("unit_key").alias("unit_key"))
    return per_name.groupBy("module").agg(
        F.min_by(F.struct("name", "unit_key"), F.struct("_order", "name")).alias("_pick")
    ).select("module", "_pick.name", "_pick.unit_key")
