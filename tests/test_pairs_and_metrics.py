"""Pair numbering and sampling, metrics, reports and the layout helpers."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from twinseek.operators import evaluate as ev
from twinseek.operators import report
from twinseek.operators.match import MATCH_COLUMNS
from twinseek.operators.pairs import (
    balance_stats, balanced_sample, balanced_sizes, cross_group_pairs, index_units, pair_stats, same_group_pairs,
    sample_modules, sample_one_per_module,
)
from twinseek.plans.layout import dense_index, draw, global_row_number, hash_hex, lookup_join, take_smallest

SIZES = {"a": 30, "b": 1, "c": 4, "d": 7, "e": 2, "f": 1}


@pytest.fixture(scope="module")
def index(spark):
    """One module holds most of the units."""
    rows = [(m, i, f"{m}{i % 3}", f"body {m} {i}") for m, n in SIZES.items() for i in range(n)]
    return index_units(spark.createDataFrame(rows, "module STRING, unit_key BIGINT, name STRING, body STRING"))


def keys(df):
    return [((r["source_module1"], r["unit_key1"]), (r["source_module2"], r["unit_key2"])) for r in df.collect()]


UNITS = [(m, i) for m, n in SIZES.items() for i in range(n)]
SAME = {(x, y) for x, y in combinations(UNITS, 2) if x[0] == y[0]}
CROSS = {(x, y) for x, y in combinations(UNITS, 2) if x[0] != y[0]}


def test_all_pairs(index):
    assert (index.n_same, index.n_cross) == (len(SAME), len(CROSS))
    same, cross = keys(same_group_pairs(index)), keys(cross_group_pairs(index))
    assert len(same) == len(SAME) and set(same) == SAME
    assert len(cross) == len(CROSS) and set(cross) == CROSS


@pytest.mark.parametrize("ratio", [0.0, 0.2, 0.5, 0.75, 1.0])
def test_balanced_sample(index, ratio):
    rows = balanced_sample(index, ratio, seed=7).collect()
    same = {((r["source_module1"], r["unit_key1"]), (r["source_module2"], r["unit_key2"])) for r in rows if r["clone"]}
    cross = {((r["source_module1"], r["unit_key1"]), (r["source_module2"], r["unit_key2"])) for r in rows if not r["clone"]}
    assert (len(same), len(cross)) == balanced_sizes(len(SAME), len(CROSS), ratio)
    assert len(rows) == len(same) + len(cross)
    assert same <= SAME and cross <= CROSS
    again = balanced_sample(index, ratio, seed=7).collect()
    assert sorted(rows) == sorted(again)


def test_balanced_sizes():
    assert balanced_sizes(0, 9, 0.5) == (0, 9)
    assert balanced_sizes(9, 0, 0.5) == (9, 0)
    assert balanced_sizes(9, 5, 1.0) == (9, 0)
    assert balanced_sizes(9, 5, 0.0) == (0, 5)
    assert balanced_sizes(3, 100, 0.25) == (3, 9)
    assert balanced_sizes(100, 9, 0.25) == (3, 9)


def test_stats(spark, index):
    got = {r["clone"]: (r["available"], r["selected"]) for r in balance_stats(balanced_sample(index, 0.5), index).collect()}
    n = min(len(SAME), len(CROSS))
    assert got == {True: (len(SAME), n), False: (len(CROSS), n)}
    pairs = spark.createDataFrame([("ab", "abc", True), ("a", "abcd", False)], "func1 STRING, func2 STRING, clone BOOLEAN")
    assert tuple(pair_stats(pairs).first()) == (2, 1, 1, 0.5, 1.5, 3.5, 1, 4)
    assert tuple(pair_stats(pairs.limit(0)).first()) == (0, 0, 0, 0.0, 0.0, 0.0, 0, 0)


def test_single_module_and_single_units(spark):
    schema = "module STRING, unit_key BIGINT, name STRING, body STRING"
    one = index_units(spark.createDataFrame([("a", i, "n", "b") for i in range(4)], schema))
    assert (one.n_same, one.n_cross) == (6, 0)
    assert balanced_sample(one, 0.5).count() == 6
    many = index_units(spark.createDataFrame([(f"m{i}", 0, "n", "b") for i in range(4)], schema))
    assert (many.n_same, many.n_cross) == (0, 6)
    assert balanced_sample(many, 0.5).count() == 6


def test_module_samples(spark):
    rows = [(f"m{i % 9}", i, f"n{i % 2}") for i in range(60)]
    units = spark.createDataFrame(rows, "module STRING, unit_key BIGINT, name STRING")
    picked = [r["module"] for r in sample_modules(units, 4, 1).collect()]
    assert len(set(picked)) == 4 and picked == [r["module"] for r in sample_modules(units, 4, 1).collect()]
    chosen = sample_one_per_module(units, 1).collect()
    assert len(chosen) == 9
    for r in chosen:
        assert r["unit_key"] == min(k for m, k, n in rows if m == r["module"] and n == r["name"])


def test_draw(spark):
    for size, k in ((100, 100), (100, 7), (10**20, 50), (7, 1)):
        got = [int(r["x"]) for r in draw(spark, size, k, 3, "x").collect()]
        assert len(set(got)) == k and min(got) >= 0 and max(got) < size
    assert {int(r["x"]) for r in draw(spark, 9, 9, 3, "x").collect()} == set(range(9))


def test_layout_helpers(spark):
    df = spark.range(500).select("id", (F.col("id") % 3 == 0).cast("int").alias("g"), hash_hex(1, F.col("id")).alias("h"))
    placed = dense_index(df, ["g"], "h", "pos", tie="id", digits=1).collect()
    for g in (0, 1):
        rows = sorted((r for r in placed if r["g"] == g), key=lambda r: r["h"])
        assert [r["pos"] for r in rows] == list(range(len(rows)))
    want = sorted(r["h"] for r in placed)
    import twinseek.plans.layout as layout

    before, layout.KEY_ROWS = layout.KEY_ROWS, 10
    try:
        for k in (11, 100, 499, 500, 600):
            assert sorted(r["h"] for r in take_smallest(df, "h", k, "id", digits=1).collect()) == want[:k]
    finally:
        layout.KEY_ROWS = before
    numbered = global_row_number(df, [F.col("g").desc(), F.col("id").asc()], "no").collect()
    assert [r["no"] for r in sorted(numbered, key=lambda r: (-r["g"], r["id"]))] == list(range(1, 501))
    left = spark.range(300).select((F.when(F.col("id") < 200, 0).otherwise(F.col("id"))).alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    assert lookup_join(left, right, ["k"], "n", 300, rows=3).groupBy("k").agg(F.max("n").alias("n"), F.count("*").alias("c")).filter("n <> c").count() == 0


def scored(spark, rows):
    return spark.createDataFrame([("m", float(s) if s is not None else None, y) for s, y in rows], "method STRING, score DOUBLE, label INT")


def test_metrics_worked_by_hand(spark):
    # Scores 0.2 (1 neg), 0.5 (1 pos 1 neg), 0.8 (1 pos), 0.9 (1 neg); one missing score.
    df = scored(spark, [(0.2, 0), (0.5, 1), (0.5, 0), (0.8, 1), (0.9, 0), (None, 1)])
    curve = sorted((r["pos"], r["threshold"], r["precision"], r["recall"]) for r in ev.pr_curve(df).collect())
    assert curve == [(0, 0.2, 0.4, 1.0), (1, 0.5, 0.5, 1.0), (2, 0.8, 0.5, 0.5), (3, 0.9, 0.0, 0.0), (4, None, 1.0, 0.0)]
    m = ev.strategy_metrics(df).first()
    # Pairs (pos, neg): 0.5 beats 0.2, ties 0.5, loses to 0.9; 0.8 beats two, loses one.
    assert round(m["roc_auc"], 12) == round(3.5 / 6, 12)
    assert round(m["pr_auc"], 12) == round(0.5 * 0.5 + 0.5 * 0.25, 12)
    assert (m["best_threshold"], round(m["best_f1"], 12)) == (0.2, round(2 / 3, 12))
    assert (m["accuracy_at_best_f1"], m["precision_at_best_f1"], m["recall_at_best_f1"], m["n_samples"]) == (0.4, 0.4, 1.0, 5)
    aligned = ev.strategy_metrics(df, compat=False).first()
    assert (aligned["best_threshold"], aligned["accuracy_at_best_f1"]) == (0.5, 0.6)


def test_metric_edge_cases(spark):
    one_score = ev.strategy_metrics(scored(spark, [(0.5, 1), (0.5, 0)])).first()
    assert (one_score["best_f1"], one_score["best_threshold"], one_score["roc_auc"]) == (0.0, 0.5, 0.5)
    no_negative = ev.strategy_metrics(scored(spark, [(0.5, 1), (0.7, 1)])).first()
    assert no_negative["roc_auc"] is None and no_negative["pr_auc"] == 1.0
    no_positive = ev.strategy_metrics(scored(spark, [(0.5, 0), (0.7, 0)])).first()
    assert no_positive["roc_auc"] is None and no_positive["best_f1"] == 0.0


def test_metrics_against_direct_computation(spark):
    rng = random.Random(4)
    rows = [(round(rng.random(), 2), int(rng.random() < 0.3)) for _ in range(400)]
    m = ev.strategy_metrics(scored(spark, rows)).first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(m["roc_auc"] - auc) < 1e-9
    cuts = sorted({s for s, _ in rows})

    def f1(t):
        tp, pp = sum(p >= t for p in pos), sum(s >= t for s, _ in rows)
        return 2 * tp / (pp + len(pos))

    best = max(range(1, len(cuts)), key=lambda i: (round(f1(cuts[i]), 12), -i))
    assert abs(m["best_f1"] - f1(cuts[best])) < 1e-9 and m["best_threshold"] == cuts[best - 1]
    sweep = {r["threshold"]: r for r in ev.threshold_sweep(scored(spark, rows)).collect()}
    assert len(sweep) == 9
    for t, r in sweep.items():
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (
            sum(p >= t for p in pos), sum(n >= t for n in neg), sum(p < t for p in pos), sum(n < t for n in neg),
        )


def test_score_pairs(spark):
    rows = [("x = 1 # a", "x = 2", True), ("", "", True), ("foo(a)", "'b'", False)]
    pairs = spark.createDataFrame(rows, "func1 STRING, func2 STRING, clone BOOLEAN")
    got = ev.score_pairs(pairs).collect()
    assert len(got) == 9
    assert all(r["score"] == 1.0 for r in got if r["label"] == 1)
    raw = {r["method"]: r["score"] for r in ev.score_pairs(pairs.limit(1), normalizer="raw").collect()}
    assert raw["levenshtein_norm"] == 1 - 5 / 9


def matches(spark, scores):
    rows = [(i, f"a/{i}.py", f"n{i}", 1, 5, 100 + i, "b/x.py", "old", 2, 8, float(s), 0.1, None) for i, s in enumerate(scores)]
    schema = "new_id BIGINT, new_path STRING, new_name STRING, new_line_start INT, new_line_end INT, old_id BIGINT, old_path STRING, " \
        "old_name STRING, old_line_start INT, old_line_end INT, similarity DOUBLE, threshold DOUBLE, confidence STRING"  # fmt: skip
    df = spark.createDataFrame(rows, schema)
    assert df.columns == MATCH_COLUMNS
    return df


def test_reports(spark):
    df = matches(spark, [0.3, 0.8, 0.59, 0.95, 0.6, 0.4, 1.0])
    s = report.match_summary(df).first()
    assert (s["total_matches"], s["high_confidence_matches"]) == (7, 3)
    assert s["confidence_distribution"] == {"High": 3, "Medium": 1, "Low": 2, "Very Low": 1}
    assert abs(s["avg_similarity_score"] - 4.64 / 7) < 1e-12
    numbered = sorted((r["match_no"], r["similarity"], r["section"][:4]) for r in report.report_rows(df).collect())
    assert [x[1] for x in numbered] == [1.0, 0.95, 0.8, 0.6, 0.59, 0.4, 0.3]
    assert [x[2] for x in numbered] == ["High"] * 3 + ["Othe"] * 4
    assert tuple(report.gate(df).first()) == (True, 7, True)
    assert tuple(report.gate(df, "High", False).first()) == (True, 3, False)
    top = report.digest(df, 5).collect()
    assert len(top) == 5 and {r["more"] for r in top} == {2}
    assert report.top_matches(df, 1).first()["line"] == "n6 6.py:1-5 ~ old x.py:2-8 (100.0%)"
    none = df.limit(0)
    assert tuple(report.gate(none).first()) == (False, 0, False)
    assert report.match_summary(none).first()["avg_similarity_score"] == 0.0
    assert {r["confidence"]: r["matches"] for r in report.confidence_distribution(none).collect()} == dict.fromkeys(report.LEVELS, 0)
    with pytest.raises(ValueError):
        report.gate(df, "Best")
