"""Labelled variants of units: seeded, rule-based rewrites instead of generated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinseek.plans.layout import hash_hex

# The rewrite of variant number v is the one at position v % 4; variant 0 is the unit itself.
REWRITES = ("case", "rename", "drop", "lines")


def _chance(seed: int, unit: Column, variant: Column, place: Column) -> Column:
    """A repeatable number of 0...99 for one place of one variant."""
    return F.conv(F.substring(hash_hex(seed, unit, variant, place), 1, 8), 16, 10).cast("bigint") % 100


def make_variants(
    units: DataFrame, key: str = "unit_id", body: str = "body", n: int = 3, strength: float = 0.2, seed: int = 42
) -> DataFrame:
    """(module, variant_no, body): each unit and `n` rewrites of it; module is the unit.

    A rewrite changes about a share `strength` of the words (upper case, renamed, dropped), or reorders the lines.
    """
    percent = int(strength * 100)
    unit, no = F.col("module"), F.col("variant_no")
    words = F.split(F.col("_text"), " ", -1)

    def chosen(i: Column) -> Column:
        return _chance(seed, unit, no, i) < percent

    case = F.transform(words, lambda w, i: F.when(chosen(i), F.upper(w)).otherwise(w))
    rename = F.transform(words, lambda w, i: F.when(chosen(i), F.concat(w, F.lit("_"), no)).otherwise(w))
    drop = F.filter(words, lambda w, i: ~chosen(i))
    lines = F.split(F.col("_text"), "\n", -1)
    ordered = F.sort_array(F.transform(lines, lambda x, i: F.struct(hash_hex(seed, unit, no, i).alias("h"), x.alias("x"))))
    rewrites = {
        "case": F.array_join(case, " "),
        "rename": F.array_join(rename, " "),
        "drop": F.array_join(drop, " "),
        "lines": F.array_join(F.transform(ordered, lambda o: o["x"]), "\n"),
    }
    rewritten = F.when(no == 0, F.col("_text"))
    for i, name in enumerate(REWRITES):
        rewritten = rewritten.when(no % len(REWRITES) == i, rewrites[name])
    return (
        units.select(F.col(key).alias("module"), F.col(body).alias("_text"))
        .withColumn("variant_no", F.explode(F.sequence(F.lit(0), F.lit(n))))
        .select("module", "variant_no", rewritten.alias("body"))
    )
