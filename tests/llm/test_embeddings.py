"""Near-duplicate vectors against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from twinseek.llm import embedding_dedup as ed


def rows_and_truth(rng, dim=24):
    base = rng.normal(size=(40, dim))
    rows = []
    for i in range(40):
        for _ in range(int(rng.integers(1, 5))):
            rows.append((base[i] + rng.normal(size=dim) * rng.choice([0.01, 0.1, 0.25]) * np.abs(base[i]).mean()).astype(np.float32).tolist())
    crowd = rng.normal(size=dim)
    rows += [(crowd + rng.normal(size=dim) * 0.1).astype(np.float32).tolist() for _ in range(150)]
    rows += [rows[0]] * 20 + [[0.0] * dim, None, [], [float("nan")] * dim, [None, *[1.0] * (dim - 1)], [float("inf")] * dim, [1.0, 2.0], [2.0, 4.0]]
    rng.shuffle(rows)
    return rows


def slow(rows, cosine):
    def unit(r):
        if not r or None in r or not np.isfinite(r).all() or not np.any(r):
            return None
        v = np.array(r, np.float64)
        return v / np.linalg.norm(v)

    units = [unit(r) for r in rows]
    n = len(rows)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]):
                near[i, j] = float(units[i] @ units[j]) >= cosine
    low = list(range(n))
    for i in range(n):
        if low[i] == i:
            stack, seen = [i], {i}
            while stack:
                for y in np.flatnonzero(near[stack.pop()]).tolist():
                    if y not in seen:
                        seen.add(y)
                        stack.append(y)
            for y in seen:
                low[y] = min(low[y], i)
    return near.sum(axis=1), low


@pytest.mark.parametrize("block", [7, 1000])
def test_all_pairs(spark, block):
    rows = rows_and_truth(np.random.default_rng(4))
    frame = spark.createDataFrame([(i, r, i % 3, "x") for i, r in enumerate(rows)], "vec_id long, embedding array<float>, node int, keys string")
    got = {r.vec_id: r for r in ed.embedding_groups(frame.repartition(4), block=block).collect()}
    degree, low = slow(rows, ed.COSINE)
    assert len(got) == len(rows)
    found = sum(got[i].n_links for i in range(len(rows)))
    assert 0.99 * degree.sum() <= found <= degree.sum()
    assert all(got[i].n_links <= degree[i] for i in range(len(rows)))
    assert np.mean([got[i].component_id == low[i] for i in range(len(rows))]) > 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_no_rows_and_null_ids(spark):
    schema = "vec_id long, embedding array<double>"
    assert ed.embedding_groups(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0])], schema)
    assert sorted(map(tuple, ed.embedding_groups(rows).collect()), key=str) == [(5, 1, 5, True)] * 2 + [(None, 0, None, False)] * 2


def test_plan():
    how = ed.plan(100_000)
    near = ed.collision((2 - 2 * ed.COSINE) ** 0.5)
    assert 1 - (1 - near**how.hashes) ** how.tables >= ed.RECALL
    assert ed.plan(10**9).hashes > how.hashes
