from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinseek.catalog.extraction import VARIANTS_SQL, benchmark_variants, literals_sql
from twinseek.catalog.pairing import DRAWN_CROSS_SQL, SAMPLED_CROSS, draw_sql, index_sql
from twinseek.catalog.registry import TOKENS, query, table
from twinseek.operators import evaluate as ev
from twinseek.operators.pairs import balanced_sample, index_units
from twinseek.session import materialize, scratch_path
from twinseek.sources.sinks import write_metrics

# --- metrics over a scored table made from order lines: three "methods", label = returned -----------------------------

_METHODS = {"discount": "l_discount * 5", "quantity": "l_quantity / 50", "tax": "l_tax * 12.5"}


def line_scores(spark: SparkSession, sf: str) -> DataFrame:
    scores = [F.struct(F.lit(m).alias("method"), F.expr(f"CAST({e} AS DOUBLE)").alias("score")) for m, e in _METHODS.items()]
    return table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"), F.inline(F.array(*scores))
    )


_SCORED_SQL = "scored AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS method, ({e.replace('12.5', '12.5::DOUBLE').replace('50', '50::DOUBLE')})::DOUBLE AS score, (l_returnflag = 'R')::INT AS label FROM lineitem"
    for m, e in _METHODS.items()
) + ")"

METRICS_SQL = """counts AS (SELECT method, score, sum(label)::BIGINT AS p, count(*)::BIGINT AS c FROM scored GROUP BY ALL),
  curve AS (SELECT *, sum(p) OVER down AS tp, sum(c) OVER down AS pp, row_number() OVER up - 1 AS pos, sum(c) OVER up AS upto,
      sum(p) OVER whole AS pos_n, sum(c) OVER whole AS n, count(*) OVER whole AS points FROM counts
    WINDOW down AS (PARTITION BY method ORDER BY score DESC), up AS (PARTITION BY method ORDER BY score), whole AS (PARTITION BY method)),
  points AS (SELECT method, pos, score, tp::DOUBLE / pp AS pr, tp::DOUBLE / pos_n AS rc FROM curve
    UNION ALL SELECT method, max(points), NULL, 1, 0 FROM curve GROUP BY method),
  f1s AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * (pr * rc) / (pr + rc) ELSE 0 END AS f1,
    lag(score) OVER (PARTITION BY method ORDER BY pos) AS lower, lead(pr) OVER (PARTITION BY method ORDER BY pos) AS pr2,
    lead(rc) OVER (PARTITION BY method ORDER BY pos) AS rc2 FROM points),
  areas AS (SELECT method, sum((rc - rc2) * (pr + pr2) / 2) AS pr_auc FROM f1s GROUP BY 1),
  rocs AS (SELECT method, CASE WHEN max(pos_n) > 0 AND max(pos_n) < max(n) THEN (sum(p * (upto - (c - 1)::DOUBLE / 2)) - max(pos_n) * (max(pos_n) + 1)::DOUBLE / 2)
    / (max(pos_n)::DOUBLE * (max(n) - max(pos_n))) END AS roc_auc, max(n)::BIGINT AS n_samples FROM curve GROUP BY 1),
  best AS (SELECT method, f1 AS best_f1, lower AS best_threshold, score AS aligned_threshold FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY f1 DESC, pos) AS r
    FROM f1s WHERE pos >= 1) WHERE r = 1),
  atbest AS (SELECT method, avg((label = (score >= best_threshold)::INT)::INT) AS accuracy_at_best_f1,
    coalesce(sum(label) FILTER (score >= best_threshold)::DOUBLE / count(*) FILTER (score >= best_threshold), 0) AS precision_at_best_f1,
    coalesce(sum(label) FILTER (score >= best_threshold)::DOUBLE / sum(label), 0) AS recall_at_best_f1 FROM scored JOIN best USING (method) GROUP BY method),
  metrics AS (SELECT method, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, best_threshold, round(best_f1, 6) AS best_f1,
    round(accuracy_at_best_f1, 6) AS accuracy_at_best_f1, round(precision_at_best_f1, 6) AS precision_at_best_f1,
    round(recall_at_best_f1, 6) AS recall_at_best_f1, n_samples FROM rocs JOIN areas USING (method) JOIN best USING (method) JOIN atbest USING (method))"""
_LINES = f"WITH {_SCORED_SQL}, {METRICS_SQL}"
_ROUNDED = ("roc_auc", "pr_auc", "best_f1", "accuracy_at_best_f1", "precision_at_best_f1", "recall_at_best_f1", "precision", "recall", "accuracy", "f1")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in _ROUNDED else F.col(c) for c in df.columns])


@query("roc_auc", f"{_LINES} SELECT method, roc_auc FROM metrics")
def q_roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ev.roc_auc(line_scores(spark, sf)))


@query("pr_auc", f"{_LINES} SELECT method, pr_auc FROM metrics")
def q_pr_auc(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ev.pr_auc(line_scores(spark, sf)))


@query("pr_curve", f'{_LINES} SELECT method, pos, score AS threshold, round(pr, 6) AS "precision", round(rc, 6) AS recall FROM points')
def q_pr_curve(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ev.pr_curve(line_scores(spark, sf)))


@query("best_f1", f"{_LINES} SELECT method, best_threshold, best_f1 FROM metrics")
def q_best_f1(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ev.best_f1(line_scores(spark, sf)))


@query("best_f1_aligned", f"{_LINES} SELECT method, aligned_threshold AS best_threshold, round(best_f1, 6) AS best_f1 FROM best")
def q_best_f1_aligned(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ev.best_f1(line_scores(spark, sf), compat=False))


@query("strategy_metrics", f"{_LINES} SELECT * FROM metrics")
def q_strategy_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ev.strategy_metrics(line_scores(spark, sf)))


@query("best_strategy", f"{_LINES} SELECT method, best_f1, best_threshold AS recommended_threshold FROM metrics ORDER BY best_f1 DESC, pr_auc DESC, roc_auc DESC LIMIT 1")
def q_best_strategy(spark: SparkSession, sf: str) -> DataFrame:
    best = ev.best_strategy(ev.strategy_metrics(line_scores(spark, sf)))
    return _rounded(best.select("method", "best_f1", "recommended_threshold"))


def _confusion_sql(grid: str) -> str:
    return f"""WITH {_SCORED_SQL}, grid AS (SELECT unnest([{grid}])::DOUBLE AS threshold),
    k AS (SELECT method, threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp,
      count(*) FILTER (score < threshold AND label = 1) AS fn, count(*) FILTER (score < threshold AND label = 0) AS tn FROM scored, grid GROUP BY ALL)
    SELECT method, threshold, tp, fp, fn, tn, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy,
      round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 6) AS "precision",
      round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 6) AS recall,
      round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp::DOUBLE / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM k"""


@query("threshold_sweep", _confusion_sql(", ".join(map(str, ev.SWEEP_GRID))))
def q_threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ev.threshold_sweep(line_scores(spark, sf)))


@query("compare_methods", _confusion_sql("0.7"))
def q_compare_methods(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ev.compare_methods(line_scores(spark, sf)))


@query("metrics_at", f'SELECT method, threshold, accuracy, "precision", recall FROM ({_confusion_sql("0.35")})')
def q_metrics_at(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ev.metrics_at(line_scores(spark, sf), 0.35))


@query("write_metrics", f"{_LINES} SELECT method, roc_auc, best_f1, n_samples FROM metrics")
def q_write_metrics(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "metrics")
    write_metrics(ev.strategy_metrics(line_scores(spark, sf)), path)
    back = spark.read.csv(path, header=True, schema=_METRIC_SCHEMA)
    return _rounded(back.select("method", "roc_auc", "best_f1", "n_samples"))


_METRIC_SCHEMA = """method STRING, roc_auc DOUBLE, pr_auc DOUBLE, best_threshold DOUBLE, best_f1 DOUBLE, accuracy_at_best_f1 DOUBLE,
  precision_at_best_f1 DOUBLE, recall_at_best_f1 DOUBLE, n_samples BIGINT"""


# --- the whole evaluation: variants, balanced pairs, scores, metrics ---------------------------------------------------


def variant_pairs(spark: SparkSession, sf: str) -> DataFrame:
    variants = benchmark_variants(spark, sf)
    units = variants.select(
        "module", F.col("variant_no").cast("bigint").alias("unit_key"), F.lit(None).cast("string").alias("name"), "body"
    )
    return materialize(balanced_sample(index_units(units, 42), 0.5, 42), "variant-pairs")


# The letters beyond ASCII in the texts. DuckDB counts edits in bytes, so its twin swaps each for one control
# character first; a one-to-one swap leaves the edit distance as it is.
_LETTERS = "äöüßÄÖÜéèêÉÈÊçÇñÑíÍóÓáÁúÚàÀùÙâÂîÎ"


def _one_byte(text: str) -> str:
    codes = [c for c in range(1, 128) if c < 9 or 13 < c < 32 or c == 127] + [ord(c) for c in "~^`|&$"]
    return f"translate({text}, '{_LETTERS}', {' || '.join(f'chr({c})' for c in codes[: len(_LETTERS)])})"


_KEYS = ("source_module1", "unit_key1", "source_module2", "unit_key2")
_VARIANT_PAIRS_SQL = f"""{VARIANTS_SQL}, vu AS (SELECT module, variant_no::BIGINT AS unit_key, body FROM variants),
  {index_sql('vu', 'pair_counts')}, {draw_sql(SAMPLED_CROSS, 'f', 'pair_counts')}, {DRAWN_CROSS_SQL},
  vp AS (SELECT x.module AS source_module1, x.unit_key AS unit_key1, y.module AS source_module2, y.unit_key AS unit_key2, 1 AS label, x.body AS a, y.body AS b
      FROM vu x JOIN vu y ON x.module = y.module AND x.unit_key < y.unit_key
    UNION ALL SELECT x.module, x.unit_key, y.module, y.unit_key, 0, x.body, y.body FROM drawn_pairs),
  vn AS (SELECT * REPLACE ({literals_sql('a')} AS a, {literals_sql('b')} AS b) FROM vp),
  vt AS (SELECT *, list_distinct(regexp_extract_all(a, '{TOKENS}')) AS ta, list_distinct(regexp_extract_all(b, '{TOKENS}')) AS tb FROM vn),
  scored AS (SELECT source_module1, unit_key1, source_module2, unit_key2, label, 'jaccard_tokens' AS method,
      CASE WHEN len(ta) + len(tb) = 0 THEN 1 ELSE len(list_intersect(ta, tb))::DOUBLE / (len(ta) + len(tb) - len(list_intersect(ta, tb)))::DOUBLE END AS score FROM vt
    UNION ALL SELECT source_module1, unit_key1, source_module2, unit_key2, label, 'levenshtein_norm',
      CASE WHEN a = b THEN 1 WHEN a = '' OR b = '' THEN 0 ELSE 1 - levenshtein({_one_byte('a')}, {_one_byte('b')})::DOUBLE / greatest(length(a), length(b))::DOUBLE END FROM vt)"""
_TWO = ("jaccard_tokens", "levenshtein_norm")


@query("score_pairs", f"WITH {_VARIANT_PAIRS_SQL} SELECT source_module1, unit_key1, source_module2, unit_key2, label, method, round(score, 9) AS score FROM scored")
def q_score_pairs(spark: SparkSession, sf: str) -> DataFrame:
    scored = ev.score_pairs(variant_pairs(spark, sf), _TWO, keep=_KEYS)
    return scored.withColumn("score", F.round("score", 9))


@query("score_pairs_sequence")
def q_score_pairs_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """The sequence ratio has no SQL counterpart."""
    return ev.score_pairs(variant_pairs(spark, sf), ("sequence_matcher",), keep=_KEYS)


@query("clone_ratio", f"WITH {_VARIANT_PAIRS_SQL} SELECT avg(label) AS clone_ratio FROM vp")
def q_clone_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return ev.clone_ratio(variant_pairs(spark, sf))


@query("evaluate_measures", f"WITH {_VARIANT_PAIRS_SQL}, {METRICS_SQL} SELECT * REPLACE (round(best_threshold, 9) AS best_threshold) FROM metrics")
def q_evaluate_measures(spark: SparkSession, sf: str) -> DataFrame:
    scored = materialize(ev.score_pairs(variant_pairs(spark, sf), _TWO), "scored")
    return _rounded(ev.strategy_metrics(scored)).withColumn("best_threshold", F.round("best_threshold", 9))
