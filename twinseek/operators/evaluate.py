"""How well does a measure separate the labels, and at which threshold?

`scored` tables are long: (..., label INT, method STRING, score DOUBLE). Rows are first counted per distinct score; running
totals over the scores are taken in two levels (score cells, then inside a cell), so no method is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinseek.functions.measures import MEASURES, get_measure
from twinseek.functions.text import normalize_lines, normalize_literals

SCORE_CELLS = 4096
NORMALIZERS = {"literals": normalize_literals, "lines": normalize_lines, "raw": lambda c: F.col(c)}
# Threshold grid of a sweep and the threshold of a one-point comparison.
SWEEP_GRID = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
COMPARE_AT = 0.7


def score_pairs(
    pairs: DataFrame, methods: tuple[str, ...] = tuple(MEASURES), normalizer: str = "literals", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Long table of scores in [0, 1] for labelled pairs (func1, func2, clone)."""
    if normalizer not in NORMALIZERS:
        raise ValueError(f"Unknown normalizer '{normalizer}'. Available: {', '.join(NORMALIZERS)}")
    clean = NORMALIZERS[normalizer]
    texts = pairs.select(
        *keep, F.col("clone").cast("int").alias("label"), clean("func1").alias("_a"), clean("func2").alias("_b")
    )
    scores = [
        F.struct(F.lit(name).alias("method"), get_measure(name).score(F.col("_a"), F.col("_b")).alias("score"))
        for name in methods
    ]
    long = texts.select(*keep, "label", F.inline(F.array(*scores)))
    clamped = F.when(F.col("score") > 1.0, 1.0).when(F.col("score") < 0.0, 0.0).otherwise(F.col("score"))
    return long.withColumn("score", F.nanvl(clamped, F.lit(None)))


def clone_ratio(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg(F.col("clone").cast("int")).alias("clone_ratio"))


def score_counts(scored: DataFrame) -> DataFrame:
    """(method, score, p positives, c rows) per distinct score; missing scores are left out."""
    valid = scored.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    return valid.groupBy("method", "score").agg(F.sum(F.col("label").cast("bigint")).alias("p"), F.count("*").alias("c"))


def _curve(scored: DataFrame) -> DataFrame:
    """Per distinct score: tp / pp at or above it, its position from below, and the totals of its method."""
    counts = score_counts(scored).withColumn("_cell", F.floor(F.col("score") * SCORE_CELLS))
    cells = counts.groupBy("method", "_cell").agg(
        F.sum("p").alias("_p"), F.sum("c").alias("_c"), F.count("*").alias("_d")
    )
    above = Window.partitionBy("method").orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("method").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("method")
    zero = F.lit(0)
    offsets = cells.select(
        "method", "_cell",
        F.coalesce(F.sum("_p").over(above), zero).alias("_tp"),
        F.coalesce(F.sum("_c").over(above), zero).alias("_pp"),
        F.coalesce(F.sum("_d").over(below), zero).alias("_pos"),
        F.sum("_p").over(whole).alias("positives"),
        F.sum("_c").over(whole).alias("total"),
        F.sum("_d").over(whole).alias("points"),
    )
    down = Window.partitionBy("method", "_cell").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("method", "_cell").orderBy("score")
    local = counts.select(
        "*", F.sum("p").over(down).alias("_ltp"), F.sum("c").over(down).alias("_lpp"), F.row_number().over(up).alias("_lpos")
    )
    return local.join(offsets, ["method", "_cell"]).select(
        "method", "score", "p", "c",
        (F.col("_tp") + F.col("_ltp")).alias("tp"),
        (F.col("_pp") + F.col("_lpp")).alias("pp"),
        (F.col("_pos") + F.col("_lpos") - 1).alias("pos"),
        "positives", "total", "points",
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _precision() -> Column:
    return _ratio(F.col("tp"), F.col("pp"))


def _recall() -> Column:
    return _ratio(F.col("tp"), F.col("positives"))


def pr_curve(scored: DataFrame) -> DataFrame:
    """Precision and recall at each distinct score, from the lowest, and the final point (1, 0)."""
    curve = _curve(scored)
    points = curve.select("method", "pos", F.col("score").alias("threshold"), _precision().alias("precision"), _recall().alias("recall"))
    final = curve.groupBy("method").agg(F.max("points").alias("pos")).select(
        "method", "pos", F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(final)


def _areas(curve: DataFrame) -> DataFrame:
    """ROC-AUC from the rank sum (ties share their mean rank), PR-AUC by trapezoids."""
    c, p = F.col("c").cast("double"), F.col("p").cast("double")
    rank = F.col("total") - (F.col("pp") - F.col("c")) - (c - 1.0) / 2.0
    pos, neg = F.col("positives").cast("double"), (F.col("total") - F.col("positives")).cast("double")
    next_recall = _ratio(F.col("tp") - F.col("p"), F.col("positives"))
    next_precision = F.coalesce(_ratio(F.col("tp") - F.col("p"), F.col("pp") - F.col("c")), F.lit(1.0))
    trapezoid = (_recall() - next_recall) * (_precision() + next_precision) / 2.0
    sums = curve.groupBy("method").agg(
        F.max(pos).alias("_p"), F.max(neg).alias("_n"), F.sum(p * rank).alias("_ranks"), F.sum(trapezoid).alias("pr_auc"),
        F.max("total").alias("n_samples"),
    )
    auc = F.try_divide(F.col("_ranks") - F.col("_p") * (F.col("_p") + 1.0) / 2.0, F.col("_p") * F.col("_n"))
    return sums.select("method", auc.alias("roc_auc"), "pr_auc", "n_samples")


def roc_auc(scored: DataFrame) -> DataFrame:
    """NULL when a class is missing."""
    return _areas(_curve(scored)).select("method", "roc_auc")


def pr_auc(scored: DataFrame) -> DataFrame:
    return _areas(_curve(scored)).select("method", "pr_auc")


def _best(curve: DataFrame, compat: bool) -> DataFrame:
    """Best F1 per method over all points but the lowest, and the metrics at the threshold reported for it.

    `compat`: the threshold reported is the next lower distinct score, as the usual evaluation script does; otherwise it
    is the score that gives the F1.
    """
    f1 = F.coalesce(F.try_divide(2.0 * (_precision() * _recall()), _precision() + _recall()), F.lit(0.0))
    # With a single distinct score only the final point (1, 0) is left, whose F1 is 0.
    best = curve.groupBy("method").agg(
        F.max(F.when(F.col("pos") >= 1, F.struct(f1.alias("f1"), (-F.col("pos")).alias("at")))).alias("_b")
    ).select(
        "method", F.coalesce("_b.f1", F.lit(0.0)).alias("best_f1"),
        (F.coalesce(-F.col("_b.at"), F.lit(1)) - F.lit(1 if compat else 0)).alias("pos"),
    )
    at = best.join(curve, ["method", "pos"], "left")
    true_negative = F.col("total") - F.col("positives") - (F.col("pp") - F.col("tp"))
    return at.select(
        "method",
        F.col("score").alias("best_threshold"),
        "best_f1",
        _ratio(F.col("tp") + true_negative, F.col("total")).alias("accuracy_at_best_f1"),
        _precision().alias("precision_at_best_f1"),
        F.when(F.col("score").isNotNull(), F.coalesce(_recall(), F.lit(0.0))).alias("recall_at_best_f1"),
    )


def best_f1(scored: DataFrame, compat: bool = True) -> DataFrame:
    return _best(_curve(scored), compat).select("method", "best_threshold", "best_f1")


def strategy_metrics(scored: DataFrame, compat: bool = True) -> DataFrame:
    """All metrics, one row per method."""
    curve = _curve(scored)
    return _areas(curve).join(_best(curve, compat), "method").select(
        "method", "roc_auc", "pr_auc", "best_threshold", "best_f1", "accuracy_at_best_f1", "precision_at_best_f1",
        "recall_at_best_f1", "n_samples",
    )


def threshold_sweep(scored: DataFrame, grid: tuple[float, ...] = SWEEP_GRID) -> DataFrame:
    """Confusion counts and metrics per method and threshold of the grid, in one pass over the distinct scores."""
    at = lambda t, c: F.coalesce(F.sum(F.when(F.col("score") >= t, F.col(c))), F.lit(0))
    rows = [F.struct(F.lit(float(t)).alias("threshold"), at(t, "p").alias("tp"), at(t, "c").alias("pp")) for t in grid]
    wide = score_counts(scored).groupBy("method").agg(
        F.sum("p").alias("positives"), F.sum("c").alias("total"), F.array(*rows).alias("_rows")
    )
    long = wide.select("method", "positives", "total", F.inline("_rows"))
    fp, fn = F.col("pp") - F.col("tp"), F.col("positives") - F.col("tp")
    tn = F.col("total") - F.col("positives") - fp
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return long.select(
        "method", "threshold", "tp", fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
        _ratio(F.col("tp") + tn, F.col("total")).alias("accuracy"),
        zero(_precision()).alias("precision"),
        zero(_recall()).alias("recall"),
        zero(_ratio(2 * F.col("tp"), F.col("pp") + F.col("positives"))).alias("f1"),
    )


def metrics_at(scored: DataFrame, threshold: float) -> DataFrame:
    """Accuracy, precision and recall of every method at one threshold."""
    return threshold_sweep(scored, (threshold,)).select("method", "threshold", "accuracy", "precision", "recall")


def compare_methods(scored: DataFrame, threshold: float = COMPARE_AT) -> DataFrame:
    return threshold_sweep(scored, (threshold,))


def ranked_strategies(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.desc("best_f1"), F.desc("pr_auc"), F.desc("roc_auc"), "method")


def best_strategy(metrics: DataFrame) -> DataFrame:
    """The best method and the threshold to use with it."""
    return ranked_strategies(metrics).limit(1).withColumn("recommended_threshold", F.col("best_threshold"))
