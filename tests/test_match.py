"""The similarity join against a plain nested loop."""

from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from twinseek.functions.measures import available_measures, get_measure
from twinseek.operators import overlap
from twinseek.operators.match import build_index, match_classes, match_index, match_units, token_pairs
from twinseek.operators.overlap import overlap_pairs
from twinseek.operators.segments import segment_pairs
from twinseek.operators.signatures import HALVES, signature
from twinseek.operators.thresholds import ThresholdConfig
from twinseek.session import materialize, released

TOKEN = re.compile(r"[A-Za-z_]\w*|\d+|==|!=|<=|>=|[\(\)\[\]\{\}\.,:;\+\-\*/%<>]")
COLUMNS = "unit_id BIGINT, name STRING, file_path STRING, line_start INT, line_end INT, signature STRING, body STRING"


def jaccard(a: str, b: str) -> float:
    x, y = set(TOKEN.findall(a)), set(TOKEN.findall(b))
    return len(x & y) / max(1, len(x | y)) if x or y else 1.0


def edit(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    row = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, cb in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (ca != cb))
    return 1.0 - row[-1] / max(len(a), len(b))


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


SCORES = {"jaccard_tokens": jaccard, "levenshtein_norm": edit, "sequence_matcher": ratio}


def threshold(config: ThresholdConfig, path: str) -> float:
    """Of the path's own prefixes, the longest one that is a folder; of equal folders the first counts."""
    values = {}
    for folder in reversed(config.folder_thresholds):
        values[folder.strip("/")] = config.folder_thresholds[folder]
    clean = path.strip("/")
    known = [n for n in range(1, len(clean) + 1) if clean[:n] in values]
    return values[clean[: max(known)]] if known else config.global_threshold


def nested_loop(rows, measure, config, new=None):
    out = set()
    for a in rows if new is None else new:
        for b in rows:
            if a[2] == b[2] and a[1] == b[1]:
                continue
            score = SCORES[measure](a[6], b[6])
            if score >= max(threshold(config, a[2]), threshold(config, b[2])):
                out.add((a[0], b[0], round(score, 12)))
    return out


def texts(seed: int, n: int, words: int = 12) -> list[str]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(14)] + ["==", "7", "(", ")"]
    out: list[str] = ["", "", "!!", "a", "b", "é", "😀 a"]
    while len(out) < n:
        kind = rng.random()
        if kind < 0.3 and len(out) > 8:
            base = list(rng.choice(out))
            for _ in range(rng.randint(0, 3)):
                at = rng.randint(0, len(base))
                base[at : at + rng.randint(0, 1)] = [rng.choice("abc d")]
            out.append("".join(base))
        elif kind < 0.4:
            out.append(rng.choice(out))
        else:
            out.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, words))))
    return out


def rows_of(bodies: list[str]) -> list[tuple]:
    rng = random.Random(5)
    folders = ["src1/en", "src1/x", "src10", "src2", "lib"]
    return [(i, f"n{i % 40}", f"{rng.choice(folders)}/f{i % 50}.py", 1, 3, None, b) for i, b in enumerate(bodies)]


def pairs(df) -> list[tuple]:
    return [(r["new_id"], r["old_id"], round(r["similarity"], 12)) for r in df.collect()]


MIXED = ThresholdConfig(0.7, {"src1": 0.5, "src1/en": 0.9, "src2/": 1.0, "/": 0.1})


@pytest.mark.parametrize("measure", list(SCORES))
@pytest.mark.parametrize("t", [0.0, 0.3, 0.5, 0.7, 0.9, 1.0])
def test_every_threshold_equals_nested_loop(spark, measure, t):
    rows = rows_of(texts(1, 90))
    config = ThresholdConfig(t)
    got = pairs(match_units(spark.createDataFrame(rows, COLUMNS), measure=measure, thresholds=config, allow_wide=True))
    assert len(got) == len(set(got))
    assert set(got) == nested_loop(rows, measure, config)


@pytest.mark.parametrize("measure", list(SCORES))
def test_folder_thresholds_equal_nested_loop(spark, measure):
    rows = rows_of(texts(2, 130))
    for config in (MIXED, ThresholdConfig(0.6, {"src1": 0.0, "lib": 0.8})):
        got = pairs(match_units(spark.createDataFrame(rows, COLUMNS), measure=measure, thresholds=config, allow_wide=True))
        assert len(got) == len(set(got))
        assert set(got) == nested_loop(rows, measure, config)


@pytest.mark.parametrize("measure", list(SCORES))
def test_long_texts(spark, measure):
    rng = random.Random(3)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "x1", "\n"]) for _ in range(90)) for _ in range(6)]
    bodies = []
    for b in base:
        for cut in (0, 3, 11, 40):
            bodies.append(b[:100] + b[100 + cut :] + "z" * (cut // 3))
    rows = rows_of(bodies)
    for t in (0.8, 0.9):
        config = ThresholdConfig(t)
        got = pairs(match_units(spark.createDataFrame(rows, COLUMNS), measure=measure, thresholds=config))
        assert set(got) == nested_loop(rows, measure, config)


@pytest.mark.parametrize("measure", list(SCORES))
def test_changed_side_and_second_table(spark, measure):
    rows = rows_of(texts(4, 100))
    units = spark.createDataFrame(rows, COLUMNS)
    config = ThresholdConfig(0.7)
    changed = {r[2] for r in rows[:20]}
    listed = spark.createDataFrame([(p,) for p in changed], "file_path STRING")
    got = pairs(match_units(units, changed_paths=listed, measure=measure, thresholds=config))
    assert len(got) == len(set(got))
    assert set(got) == nested_loop(rows, measure, config, [r for r in rows if r[2] in changed])
    other = [(i, "other", f"new/{i}.py", 1, 2, None, r[6]) for i, r in enumerate(rows[::3])]
    got = pairs(match_units(units, new_units=spark.createDataFrame(other, COLUMNS), measure=measure, thresholds=config))
    assert len(got) == len(set(got))
    assert set(got) == nested_loop(rows, measure, config, other)


def test_hot_features_are_salted(spark, monkeypatch):
    """The same result when every feature held by more than two sets is spread over several keys."""
    rows = rows_of(texts(6, 120))
    config = ThresholdConfig(0.5)
    units = spark.createDataFrame(rows, COLUMNS)
    plain = overlap.overlap_pairs
    monkeypatch.setattr("twinseek.operators.match.overlap_pairs", lambda *a: plain(*a, key_rows=2))
    monkeypatch.setattr("twinseek.plans.layout.lookup_join.__defaults__", (7,))
    monkeypatch.setattr("twinseek.operators.match.BLOCK_ROWS", 3)
    got = pairs(match_units(units, thresholds=config))
    assert len(got) == len(set(got))
    assert set(got) == nested_loop(rows, "jaccard_tokens", config)


def test_colliding_hashes_lose_nothing(spark, monkeypatch):
    """With a 4-bit feature hash almost all features collide; results stay the same."""
    rows = rows_of(texts(7, 80))
    monkeypatch.setattr(overlap, "HASH_BITS", 4)
    units = spark.createDataFrame(rows, COLUMNS)
    for measure in SCORES:
        got = pairs(match_units(units, measure=measure, thresholds=ThresholdConfig(0.7)))
        assert set(got) == nested_loop(rows, measure, ThresholdConfig(0.7))


def test_wide_thresholds_warn(spark):
    units = spark.createDataFrame(rows_of(["a b", "a c"]), COLUMNS)
    for measure, t in (("levenshtein_norm", 0.3), ("jaccard_tokens", 0.0)):
        with pytest.warns(UserWarning, match="almost all pairs"):
            assert match_units(units, measure=measure, thresholds=ThresholdConfig(t)).count() == 2


def test_threshold_table(spark):
    """The same thresholds as a table and as a map; units without a body match nothing."""
    rows = rows_of(texts(3, 60))
    units = spark.createDataFrame([*rows, (900, "n", "n.py", 1, 2, None, None), (901, "m", "m.py", 1, 2, None, None)], COLUMNS)
    folders = {rows[0][2][:5]: 0.9, rows[1][2][:3]: 0.5, "/": 0.1}
    table = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(folders.items())], "folder STRING, threshold DOUBLE, pos INT")
    got = pairs(match_units(units, thresholds=table, global_threshold=0.6))
    assert set(got) == nested_loop(rows, "jaccard_tokens", ThresholdConfig(0.6, folders))


def test_registry():
    assert list(available_measures()) == ["jaccard_tokens", "sequence_matcher", "levenshtein_norm"]
    with pytest.raises(ValueError, match="cosine"):
        get_measure("cosine")


@pytest.mark.parametrize("measure", list(SCORES))
def test_one_index_for_several_tables(spark, measure):
    """A frozen index gives the same matches as a fresh join, also for features the corpus never had."""
    rows = rows_of(texts(8, 80))
    index = build_index(spark.createDataFrame(rows, COLUMNS), measure, MIXED, allow_wide=True)
    for seed in (9, 10):
        new = [(i, "other", f"src1/new/{i}.py", 1, 2, None, b + (" zq9" if i % 5 == 0 else "")) for i, b in enumerate(texts(seed, 30) + [r[6] for r in rows[:10]])]
        got = pairs(match_index(index, spark.createDataFrame(new, COLUMNS)))
        assert len(got) == len(set(got))
        assert set(got) == nested_loop(rows, measure, MIXED, new)


def test_hubs_are_split(spark, monkeypatch):
    """One text in a third of the units and one feature in all: no key of a join gathers more than KEY_ROWS rows."""
    rows = rows_of([f"common {w}" for w in texts(12, 60)] + ["common boilerplate text"] * 30)
    largest = []
    plain = overlap._postings

    def counted(prefix, role, holders, key_rows):
        out = plain(prefix, role, holders, 8)
        largest.append(out.groupBy("feature", "q", "row", "column").count().agg({"count": "max"}).first()[0])
        return out

    monkeypatch.setattr(overlap, "_postings", counted)
    monkeypatch.setattr("twinseek.operators.match.hub_join.__defaults__", (None, 5))
    got = pairs(match_units(spark.createDataFrame(rows, COLUMNS), thresholds=ThresholdConfig(0.4)))
    assert set(got) == nested_loop(rows, "jaccard_tokens", ThresholdConfig(0.4))
    assert max(x for x in largest if x) <= 24  # the grid aims at 8 rows a key; hashing spreads them unevenly


@pytest.mark.parametrize("measure", list(SCORES))
def test_signatures_differ_in_no_more_bits_than_allowed(spark, measure):
    """Over all pairs: differing bits are at most the marks of one side only, and no pair at t or above exceeds the bound."""
    bodies, m, t = sorted(set(texts(11, 120))), get_measure(measure), 0.6
    units = spark.createDataFrame(rows_of(bodies), COLUMNS)
    classes = build_index(units, measure, ThresholdConfig(t)).classes
    ids = classes.join(units.selectExpr("unit_id * 2 AS cid", "body"), "cid").select("body", "size", *signature(m, t)).collect()
    for a in ids:
        for b in ids:
            small, large = sorted((a["size"], b["size"]))
            if None in (a.bits_0, b.bits_0) or SCORES[measure](a.body, b.body) < t or small == 0:
                continue
            bits = sum(((a[h] ^ b[h]) & (1 << 64) - 1).bit_count() for h in HALVES)
            allowed = {
                "jaccard_tokens": (1 - t) / (1 + t) * (small + large),
                "levenshtein_norm": 2 * int((1 - t) * large + 1e-9) - (large - small),
                "sequence_matcher": (1 - t) * (small + large),
            }[measure]
            assert bits <= allowed + 1e-6


@pytest.mark.parametrize("measure", ["levenshtein_norm", "sequence_matcher"])
def test_few_candidates_for_texts_that_look_alike(spark, measure):
    """2,000 names from a small vocabulary: at most five candidates for each pair that reaches the threshold."""
    part = spark.read.parquet("/root/testdata/sf0.01/part.parquet")
    body = "concat_ws(' ', p_name, p_brand, substring_index(p_type, ' ', 1)) AS body"
    units = part.selectExpr(
        "p_partkey AS unit_id", "p_name AS name", "concat('f', p_partkey) AS file_path", "1 AS line_start", "1 AS line_end", "'' AS signature", body
    )
    m = get_measure(measure)
    index = build_index(units, measure, ThresholdConfig(0.92))
    found = overlap_pairs(index.prefix, index.prefix, m, index.floor, "once")
    if m.segments:
        found = found.unionByName(segment_pairs(index.classes, index.classes, m, index.floor, "once")).distinct()
    bodies = {r.cid: r.payload for r in index.classes.select("cid", "payload").collect()}
    candidates = [(bodies[r.small_cid], bodies[r.large_cid]) for r in found.collect()]
    hits = sum(max(SCORES[measure](a, b), SCORES[measure](b, a)) >= 0.92 for a, b in candidates)
    assert 0 < len(candidates) <= 5 * hits


def test_whole_documents_by_edit_distance_equal_nested_loop(spark):
    """Documents of the given table, the longest ones aside only because the plain loop is quadratic in their length."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) BETWEEN 1 AND 250")
    rows = [(r.doc_id, f"n{r.doc_id}", f"{r.source}/{r.doc_id}", 1, 1, None, r.text) for r in docs.collect()]
    config = ThresholdConfig(0.9)
    got = pairs(match_units(spark.createDataFrame(rows, COLUMNS), measure="levenshtein_norm", thresholds=config))
    assert set(got) == nested_loop(rows, "levenshtein_norm", config) and len(got) == len(set(got))


def test_few_candidates_for_token_sets_with_common_words(spark):
    """Sets that share a few common words leave inside the join; no pair that reaches the threshold does."""
    rng = random.Random(21)
    words = [f"w{int(rng.paretovariate(0.4))}" for _ in range(40_000)]
    bodies = [" ".join(rng.sample(words, 150)) for _ in range(300)]
    bodies += [b.replace(" ", " extra ", 1).rsplit(" ", 20)[0] for b in bodies[::10]]
    rows, t = rows_of(bodies), 0.5
    index = build_index(spark.createDataFrame(rows, COLUMNS), thresholds=ThresholdConfig(t))
    sets = {r.cid: set(r.payload) for r in index.classes.select("cid", "payload").collect()}
    found = {tuple(sorted((r.small_cid, r.large_cid))) for r in overlap_pairs(index.prefix, index.prefix, index.measure, index.floor, "once").collect()}
    ids = sorted(sets)
    hits = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}
    assert hits and hits <= found and len(found) <= 5 * len(hits)


def test_token_join_in_passes(spark, monkeypatch):
    """Many small passes over postings, candidates and scored pairs give every match once, and no shuffle file outlives its pass."""
    for name, most in (("PASS_POSTINGS", 1500), ("PASS_PAIRS", 400), ("PASS_TOKENS", 2500)):
        monkeypatch.setattr(f"twinseek.operators.match.{name}", most)
    rows = rows_of(texts(14, 120) + ["one hot text"] * 4)
    units = spark.createDataFrame(rows, COLUMNS)
    got = pairs(match_units(units, thresholds=MIXED, allow_wide=True))
    assert len(got) == len(set(got)) and set(got) == nested_loop(rows, "jaccard_tokens", MIXED)
    new = [(i, "other", f"src1/new/{i}.py", 1, 2, None, b) for i, b in enumerate(texts(15, 40) + [r[6] for r in rows[:10]])]
    monkeypatch.setattr("twinseek.operators.match.BROADCAST_ROWS", 10)  # else the few new postings are broadcast
    got = pairs(match_units(units, new_units=spark.createDataFrame(new, COLUMNS), thresholds=MIXED, allow_wide=True))
    assert len(got) == len(set(got)) and set(got) == nested_loop(rows, "jaccard_tokens", MIXED, new)


def test_passes_keep_near_pairs_only(spark, tmp_path, monkeypatch):
    """Candidates go with the pass that met them, a near pair is kept once, and parts that meet too many are halved without loss."""
    made = []
    for module in ("operators.match", "session"):
        monkeypatch.setattr(f"twinseek.{module}.scratch_path", lambda s, label: made.append((label, tmp_path / f"{label}-{len(made)}")) or str(made[-1][1]))
    parts, plain = [], overlap.overlap_pairs
    monkeypatch.setattr("twinseek.operators.match.overlap_pairs", lambda *a, **k: parts.append(k.get("part", (0, 1))) or plain(*a, **k))
    for name, most in (("PASS_POSTINGS", 200), ("PASS_PAIRS", 20)):
        monkeypatch.setattr(f"twinseek.operators.match.{name}", most)
    rows = rows_of(texts(14, 120))
    index = build_index(spark.createDataFrame(rows, COLUMNS), thresholds=MIXED, allow_wide=True)
    near = token_pairs(index.prefix, index.prefix, index.measure, index.floor, "once")
    met = {(r.small_cid, r.large_cid) for r in plain(index.prefix, index.prefix, index.measure, index.floor, "once").collect()}
    kept = [(r.small_cid, r.large_cid) for r in near.collect()]
    assert len(kept) == len(set(kept)) and set(kept) <= met
    assert len({n for _, n in parts}) > 1 and sum(1 / n for _, n in parts) == 1
    written = [path for label, path in made if label.startswith("candidates")]
    assert len(written) == len(parts) and not any(path.exists() for path in written)
    assert set(pairs(match_units(spark.createDataFrame(rows, COLUMNS), thresholds=MIXED, allow_wide=True))) == nested_loop(rows, "jaccard_tokens", MIXED)


def test_passes_follow_the_input():
    """Passes take in proportion to the classes, so that neither disk nor rereading grows faster than its share."""
    from twinseek.operators.match import PASS_CLASSES, _passes

    assert [_passes(n, 100, 10) for n in (0, 100, 101, 1000)] == [1, 1, 2, 10]
    assert _passes(4000, 100, 4 * PASS_CLASSES) == 10


def test_written_tables_are_small_and_batches_bounded(spark):
    """Tables are packed tighter than by default, and a Python worker gets few long rows at once."""
    import os

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    length = F.pandas_udf(lambda x: x * 0 + len(x), "long")
    longest = materialize(spark.range(3000).coalesce(1).select(length("id").alias("n")), "batches").agg(F.max("n")).first()[0]
    assert longest <= 500 and spark.conf.get(name) == before
    files = materialize(spark.range(10), "packed").inputFiles()
    assert files and all(os.path.basename(f).endswith(".zstd.parquet") for f in files)


def test_shuffle_files_go_with_their_pass(spark):
    seen = []
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with released(spark):
        seen.append(spark.conf.get(name))
    assert seen == ["true"] and spark.conf.get(name) == before
    shuffles = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    held = shuffles.shuffleStatuses().size()
    assert materialize(spark.range(1000).groupBy("id").count(), "t").count() == 1000
    assert shuffles.shuffleStatuses().size() <= held


@pytest.mark.parametrize("measure", ["levenshtein_norm", "sequence_matcher"])
def test_copies_are_members_not_pairs(spark, measure):
    """Ten times the copies give the same pairs and ten times the members; together they give all matches of units."""
    bodies = texts(16, 40)
    for copies in (1, 10):
        rows = rows_of(bodies * copies)
        found, members = match_classes(spark.createDataFrame(rows, COLUMNS), measure=measure, thresholds=ThresholdConfig(0.7))
        got, of = [(r.new_id, r.old_id) for r in found.collect()], {r.unit_id: r.class_id for r in members.collect()}
        held = {r[0]: r[6] for r in rows}
        assert len(got) == len(set(got)) and of == {i: min(j for j in held if held[j] == b) for i, b in held.items()}
        ids = sorted(set(of.values()))
        assert set(got) == {(a, b) for a in ids for b in ids if a != b and SCORES[measure](held[a], held[b]) >= 0.7}


def test_short_texts_match_copy_by_copy(spark, tmp_path):
    """`match_levenshtein` returns a pair for each two parts, also for two that have the same text."""
    import duckdb

    from twinseek.catalog import ORACLES, QUERIES

    rows = [(1, "dark blue steel bolt"), (2, "dark blue steel bolt"), (3, "dark blue steel bolts"), (4, "pale green wooden nut"), (5, None)]
    parts = spark.createDataFrame([(i, n, "Brand#1", "LARGE") for i, n in rows], "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING")
    parts.write.parquet(str(tmp_path / "part.parquet"))
    got = QUERIES["match_levenshtein"](spark, str(tmp_path))
    assert sorted((r.new_id, r.old_id) for r in got.collect()) == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    want = con.execute(ORACLES["match_levenshtein"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 6


def _postings_batch(sets):
    """Postings of (cid, t, features in order, first common word), all in both roles, ordered by feature."""
    import pyarrow as pa

    from twinseek.operators.signatures import COMMON

    rows = []
    for cid, t, features, word in sets:
        for pos, feature in enumerate(features):
            row = {"feature": feature, "row": 0, "column": 0, "cid": cid, "size": len(features), "t": t, "m": len(features), "pos": pos, "rare": len(features)}
            row |= {"earlier": features[pos - 1] if pos else -1, **dict.fromkeys((*COMMON, *HALVES), 0), COMMON[0]: word, "signed": True, "is_small": True, "is_large": True}
            rows.append(row)
    return pa.RecordBatch.from_pylist(sorted(rows, key=lambda r: r["feature"]))


def test_a_pair_of_token_sets_is_listed_where_it_first_meets():
    m = get_measure("jaccard_tokens")
    meets = overlap._token_meets(m.differ_max, m.size_ok, m.shared_min, "once")
    sets = [
        (1, 0.7, list(range(0, 30)), 0), (2, 0.7, list(range(0, 30)), 0),  # one and the same: met once, not at each feature
        (4, 0.7, list(range(100, 130)), 0), (5, 0.7, [99, *range(100, 130)], 0), (6, 0.7, list(range(100, 130)), -1),  # 64 differing bits
    ]
    batch = _postings_batch(sets)
    whole = [tuple(r.values()) for b in meets(iter([batch])) for r in b.to_pylist()]
    assert sorted(whole) == [(1, 2, 0.7), (4, 5, 0.7)]
    single = [tuple(r.values()) for b in meets(batch.slice(i, 1) for i in range(batch.num_rows)) for r in b.to_pylist()]
    assert sorted(single) == sorted(whole)


def test_keys_of_postings_are_not_cut(monkeypatch):
    monkeypatch.setattr(overlap, "CHUNK_ROWS", 5)
    batch = _postings_batch([(i, 0.5, list(range(0, 20)), 0) for i in range(4)])
    seen = [(set(c["feature"]), len(set(key))) for c, key in overlap._whole_keys((batch.slice(i, 3) for i in range(0, batch.num_rows, 3)), ["feature", "row", "column"])]
    assert len(seen) > 5 and sum(len(f) for f, _ in seen) == len(set().union(*[f for f, _ in seen])) == 20
    assert all(len(f) == n for f, n in seen)


def test_sketches_of_many_lengths_at_once():
    import numpy as np
    import pandas as pd

    from twinseek.operators.signatures import sketches_differ

    rng = random.Random(3)
    draw = lambda: None if rng.random() < 0.1 else rng.randbytes(rng.choice((8, 16, 64, 256)))
    a, b = ([draw() for _ in range(300)] for _ in range(2))

    def one(x, y):
        n = min(len(x), len(y)) // 8
        x, y = (np.bitwise_xor.reduce(np.frombuffer(v, np.uint64).reshape(-1, n)) for v in (x, y))
        return sum(int(v).bit_count() for v in x ^ y)

    want = [0 if x is None or y is None else one(x, y) for x, y in zip(a, b)]
    assert list(sketches_differ.func(pd.Series(a), pd.Series(b))) == want
