"""Mixing sources to target weights by hierarchical budgets.

Documents are leaves of a tree, domain -> language -> source by default. A token budget is split from the root down by
weights. No node is given more than it can supply (its tokens times `max_epochs`): what one child cannot use goes to its
siblings by weight, and only what a whole family cannot use goes to the relatives of its parent. With the sum of its
leaves as the supply of a node, one water-filling step per level does exactly this.

A leaf whose budget is `e` times its tokens and a rest is taken `e` times in full and then as a prefix of one more epoch;
each epoch orders the leaf by its own seeded hash. Running sums are taken per (leaf, slice of the hash), so no leaf is
sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinseek.session import materialize

# Hexadecimal digits of the hash that cut a leaf into slices.
SLICE_DIGITS = 3
_BIG = "decimal(38,0)"
# Level of the tree: name, value of a document, weight of the value among its siblings (whole number, 0 or more).
Level = tuple[str, Column, Column]


def word_tokens(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column, domains: int = 4) -> Column:
    """Domain of a source, for corpora that name none: a bucket of the md5 of its name."""
    return F.concat(F.lit("domain"), (F.conv(F.substring(F.md5(source), 1, 6), 16, 10).cast("long") % domains).cast("string"))


def default_levels() -> list[Level]:
    """domain -> language -> source; English counts double among languages, everything else is equal."""
    source, lang = (F.coalesce(F.col(c), F.lit("")) for c in ("source", "lang"))
    return [
        ("domain", domain_of(source), F.lit(1)),
        ("lang", lang, F.when(lang == "en", 2).otherwise(1)),
        ("source", source, F.lit(1)),
    ]


def _fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Splits `budget` (of the parent, on every row) among siblings by `w`, none above its `supply`; whole tokens, rounded down."""
    per_weight = F.col("supply").cast("double") / F.when(F.col("w") > 0, F.col("w").cast("double"))
    family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    ordered = family.orderBy(F.asc_nulls_last("ratio"), name)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    supply, weight = F.col("supply").cast(_BIG), F.col("w").cast(_BIG)
    placed = (
        nodes.withColumn("ratio", per_weight)
        .withColumn("before", (F.sum(supply).over(upto) - supply).cast(_BIG))
        .withColumn("w_left", (F.sum(weight).over(family) - F.sum(weight).over(upto) + weight).cast(_BIG))
        .withColumn("left", (F.col("budget").cast(_BIG) - F.col("before")).cast(_BIG))
        .withColumn("short", (weight > 0) & ((supply * F.col("w_left")) <= (F.col("left") * weight)))
        .withColumn("rank", F.row_number().over(ordered))
        .withColumn("first", F.min(F.when(~F.col("short"), F.col("rank"))).over(family))
        .withColumn("rest", F.max(F.when(F.col("rank") == F.col("first"), F.col("left"))).over(family))
        .withColumn("w_rest", F.max(F.when(F.col("rank") == F.col("first"), F.col("w_left"))).over(family))
    )
    part = F.call_function("div", (F.col("rest") * weight).cast(_BIG), F.col("w_rest"))
    share = F.when(F.col("w_rest") > 0, F.least(part.cast("long"), F.col("supply"))).otherwise(F.lit(0).cast("long"))
    given = F.when(F.col("first").isNull() | (F.col("rank") < F.col("first")), F.col("supply")).otherwise(share)
    return placed.select(*parents, name, F.greatest(given, F.lit(0)).cast("long").alias("budget"))


def leaf_budgets(leaves: DataFrame, names: Sequence[str], budget: int, max_epochs: int) -> DataFrame:
    """The leaves (path, tokens, `_w0`, `_w1` ...) with `budget`, split from the root down."""
    above = None
    for i, name in enumerate(names):
        path, parents = list(names[: i + 1]), list(names[:i])
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * max_epochs).alias("supply"), F.max(f"_w{i}").cast("long").alias("w"))
        nodes = nodes.withColumn("budget", F.lit(budget).cast("long")) if above is None else nodes.join(above, parents)
        above = _fill(nodes, parents, name)
    return leaves.select(*names, "tokens").join(above, list(names))


def mix(
    docs: DataFrame,
    levels: Sequence[Level] | None = None,
    share: tuple[int, int] = (4, 5),
    tokens: int | None = None,
    max_epochs: int = 4,
    seed: int = 17,
    doc_id: str = "doc_id",
    text: str = "text",
    n_tokens: Column | None = None,
    carry: bool = False,
) -> DataFrame:
    """Selected documents, one row per document and epoch: doc_id, the path, n_tokens, epoch (1, 2, ...).

    The budget is `tokens`, or `share` (a fraction) of all tokens of `docs`. `n_tokens` defaults to words between white
    space. With `carry`, the rows of `docs` are returned instead, all columns, each as often as it was selected.

    Names are compared after null became ''. A document enters a prefix if the tokens up to it, itself included, fit. A leaf
    without tokens, or of weight 0, supplies nothing. Rows that tie on the hash are ordered by id, then tokens, then text.
    """
    levels = levels or default_levels()
    names = [f"_l{i}" for i in range(len(levels))]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    counted = docs.select(
        F.col(f"`{doc_id}`").alias("id"),
        *[F.coalesce(v.cast("string"), F.lit("")).alias(n) for n, (_, v, _) in zip(names, levels, strict=True)],
        *[w.cast("long").alias(f"_w{i}") for i, (_, _, w) in enumerate(levels)],
        (word_tokens(F.col(f"`{text}`")) if n_tokens is None else n_tokens).alias("n_tokens"),
        F.xxhash64(F.col(f"`{text}`")).alias("tie"),
        *([row] if carry else []),
    )
    if not carry:
        counted = materialize(counted, "mix-counted")
    leaves = counted.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"), *[F.max(f"_w{i}").alias(f"_w{i}") for i in range(len(names))])
    leaves = materialize(leaves, "mix-leaves")
    if tokens is None:
        tokens = (leaves.agg(F.sum("tokens").alias("n")).first().n or 0) * share[0] // share[1]
    leaves = leaf_budgets(leaves, names, tokens, max_epochs)
    full = F.when(F.col("tokens") > 0, F.call_function("div", F.col("budget"), F.col("tokens"))).otherwise(0)
    leaves = materialize(
        leaves.withColumn("full", full.cast("long")).withColumn("part", F.col("budget") - F.col("full") * F.col("tokens")), "mix-budgets"
    )
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("full") + 1).cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    drawn = counted.join(leaves.select(*names, "full", "part"), names).withColumn("h", order)
    drawn = drawn.filter("full > 0 OR part > 0").withColumn("slice", F.substring("h", 1, SLICE_DIGITS))
    slices = drawn.groupBy(*names, "slice").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.partitionBy(*names).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*names, "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*names, "slice").orderBy("h", "id", "n_tokens", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.col("before") + F.sum("n_tokens").over(inside)
    picked = drawn.join(slices, [*names, "slice"]).withColumn("running", running)
    copies = F.col("full") + F.when(F.col("running") <= F.col("part"), 1).otherwise(0)
    picked = picked.withColumn("copies", copies).filter("copies > 0")
    picked = picked.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    if carry:
        return picked.select("row.*")
    return picked.select(
        F.col("id").alias("doc_id"), *[F.col(n).alias(name) for n, (name, _, _) in zip(names, levels, strict=True)], "n_tokens", "epoch"
    )
