"""Exact and SimHash duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from twinseek.llm import exact_dedup, simhash_dedup
from twinseek.llm.common import components

SCHEMA = "doc_id long, text string, run string, fp string, `a.b` int"


def edge_rows():
    long = "word " * 30_000
    return [
        (1, None, "x", "y", 1),
        (2, "", "x", "y", 2),
        (None, "", "x", "y", 3),
        (3, "Same text", None, "y", 4),
        (3, "Same text", None, "y", 4),
        (4, "Same text", "x", None, None),
        (5, "same text", "x", "y", 6),
        (6, long, "x", "y", 7),
        (7, long, "x", "y", 8),
        (8, "a\x00b c 😀 é", "x", "y", 9),
        (None, "lonely", "x", "y", 9),
        (9, " \t\r\n\x0b\x0c ", "x", "y", 9),
    ]


def many_rows():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "Omega", "é", "the", "of"]
    rows = edge_rows() + [(100 + i, "hot copy of one text", "h", "h", 0) for i in range(400)]
    for i in range(150):
        text = [rng.choice(words) for _ in range(rng.randint(1, 40))]
        rows.append((1000 + 2 * i, " ".join(text), "a", "b", i))
        text[rng.randrange(len(text))] = "zz"
        rows.append((1001 + 2 * i, " ".join(text), "a", "b", i))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(many_rows(), SCHEMA).repartition(7)


def by_text(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r)
    return groups


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups(spark, docs, keep):
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    got = exact_dedup.exact_groups(docs, keep=keep).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    groups = by_text(many_rows())
    pick = min if keep == "min" else max
    want = defaultdict(list)
    for text, rows in groups.items():
        ids = [r[0] for r in rows if r[0] is not None]
        for r in rows:
            want[r[0]].append((pick(ids) if ids else None, len(rows), hashlib.sha256(text.encode()).hexdigest()))
    found = defaultdict(list)
    for r in got:
        found[r.doc_id].append((r.keep_id, r.group_size, r.text_sha256))
    order = lambda rows: sorted(rows, key=str)
    assert {k: order(v) for k, v in found.items()} == {k: order(v) for k, v in want.items()}
    kept = defaultdict(int)
    for r in got:
        if r.kept:
            assert r.doc_id == r.keep_id
            kept[r.text_sha256] += 1
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_keep_one(docs):
    for keep in ("min", "max"):
        out = exact_dedup.keep_one(docs, keep=keep)
        assert out.columns == docs.columns
        rows = out.collect()
        pick = min if keep == "min" else max
        groups = by_text(many_rows())
        assert len(rows) == len(groups)
        for r in rows:
            ids = [x[0] for x in groups[r.text or ""] if x[0] is not None]
            assert r.doc_id == (pick(ids) if ids else None)
            assert tuple(r) in groups[r.text or ""]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.keep_one(empty).columns == empty.columns and exact_dedup.keep_one(empty).count() == 0
    assert simhash_dedup.simhash_groups(empty).count() == 0
    assert simhash_dedup.keep_one(empty).count() == 0


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for i in range(64):
            bits[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * bits[i] > len(shingles)) if shingles else 0


def classes(values):
    values = list(values)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if bin(a ^ b).count("1") <= 3:
                root[find(a)] = find(b)
    return {v: find(v) for v in values}


def test_simhash_groups(spark, docs):
    got = simhash_dedup.simhash_groups(docs).collect()
    rows = many_rows()
    prints = {r[1]: slow_fingerprint(r[1]) for r in rows}
    label = classes(set(prints.values()))
    lowest = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            lowest[label[prints[r[1]]]].append(r[0])
    want = sorted(
        (str(r[0]), f"{prints[r[1]]:016x}", str(min(lowest[label[prints[r[1]]]], default=None))) for r in rows
    )
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    sample = spark.range(1).select(F.xxhash64(F.lit("of the é")).alias("h")).first().h
    assert sample % 2**64 == xxhash.xxh64_intdigest("of the é".encode(), 42)


def test_simhash_keep_one(docs):
    out = simhash_dedup.keep_one(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    rows = many_rows()
    prints = {r[1]: slow_fingerprint(r[1]) for r in rows}
    label = classes(set(prints.values()))
    assert len(kept) == len(set(label.values()))
    for r in kept:
        ids = [x[0] for x in rows if label[prints[x[1]]] == label[prints[r.text]] and x[0] is not None]
        assert r.doc_id == min(ids, default=None)


@pytest.mark.parametrize("bucket_rows", [3, 4096])
def test_links_of_dense_groups(spark, bucket_rows):
    """Crowds of fingerprints a few bits apart, so that buckets overflow and are cut again."""
    rng = np.random.default_rng(1)
    values = set()
    for _ in range(6):
        base = int(rng.integers(0, 2**64, dtype=np.uint64))
        for _ in range(40):
            x = base
            for bit in rng.choice(64, int(rng.integers(0, 6)), replace=False):
                x ^= 1 << int(bit)
            values.add(x)
    values |= {int(v) for v in rng.integers(0, 2**64, 200, dtype=np.uint64)} | {0, 1, 2**64 - 1, 2**63}
    frame = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    got = {r.fp % 2**64: r.root % 2**64 for r in simhash_dedup.group_fingerprints(frame, bucket_rows).collect()}
    want = classes(values)
    pairs = {(got[v], want[v]) for v in values}
    assert len(got) == len(values) and len(pairs) == len(set(got.values())) == len(set(want.values()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 100), (7, 7), (300, 100), (-5, 400)] + [(1000, 1000 + i) for i in range(1, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    want = {i: 1 for i in range(2, 61)} | {200: 100, 300: 100, 400: -5} | {1000 + i: 1000 for i in range(1, 300)}
    assert got == want
