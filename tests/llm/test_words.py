"""Importance resampling, decontamination and spelling variants against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinseek.llm import decontamination, importance_resampling, spelling_variants
from twinseek.llm.importance_resampling import Features

SCHEMA = "doc_id long, text string, TEXT2 string, word string, n long, `a.b` int, segment long, rank int"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def row(doc_id, text):
    return (doc_id, text, "x", "w", 1, 2, 3, 4)


def edge_rows():
    return [
        row(1, None),
        row(2, ""),
        row(None, "alone with no id but with words of its own"),
        row(3, "Same Text again"),
        row(3, "Same Text again"),
        row(4, "ÉÀ İ ß 日本 word-break under_score 3x 😀 tab\tnew\nline"),
        row(5, "long " * 40_000 + "tail of the long one"),
        row(6, " \t\n!?"),
    ]


def sample_texts(n, seed, vocabulary=60):
    rng = random.Random(seed)
    terms = [f"w{i}" for i in range(vocabulary)] + ["Über", "naïve", "日本"]
    return [" ".join(rng.choice(terms) for _ in range(rng.randint(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    return edge_rows() + [row(100 + i, t) for i, t in enumerate(sample_texts(150, 3))] + [row(900 + i, "one hot text " * 9) for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id string, text string, doc_id int, Items string")


# Importance resampling


def test_crc_of_any_substring():
    rng = random.Random(1)
    text = bytes(rng.randrange(256) for _ in range(5000))
    ends = np.array(sorted({0, len(text), *[rng.randrange(5000) for _ in range(200)]}))
    prefix, ones = importance_resampling.running_crc(text, ends), np.uint32(0xFFFFFFFF)
    a, b = np.triu_indices(len(ends))
    found = prefix[b] ^ importance_resampling.shift(prefix[a] ^ ones, ends[b] - ends[a]) ^ ones
    assert found.tolist() == [zlib.crc32(text[ends[i] : ends[j]]) for i, j in zip(a, b)]


def brute_resampling(rows, targets, n, buckets, share, min_words, seed):
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    found = [features(r[1]) for r in rows]
    s, t = Counter(b for f in found for b in f), Counter(b for x in targets for b in features(x))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in s}
    out = []
    for r, f in zip(rows, found):
        h = int(hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(r[1]))))
    drawn = sorted((x for x in out if x[4] >= min_words), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    ranks = Counter((x[0], i + 1) for i, x in enumerate(drawn[: len(drawn) * share[0] // share[1]]))
    return Counter(x[:4] for x in out), ranks


@pytest.mark.parametrize(("n", "buckets", "share", "min_words"), [(1, 10_000, (10, 100), 20), (3, 64, (1, 2), 0), (2, 1, (1, 1), 5)])
def test_resampling(spark, rows, docs, n, buckets, share, min_words):
    targets = ["w1 w2 w3 naïve", None, "", "long tail w1", "w1 w2 w3 naïve"]
    target = items_of(spark, [(str(i), t, i, None) for i, t in enumerate(targets)])
    got = importance_resampling.resample(docs, target, Features(n, buckets), share, min_words, seed=7).collect()
    expected, ranks = brute_resampling(rows, targets, n, buckets, share, min_words, 7)
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == expected
    assert Counter((r["doc_id"], r["rank"]) for r in got if r["rank"]) == ranks


def test_resampling_of_nothing(spark, docs):
    none = spark.createDataFrame([], SCHEMA)
    target = items_of(spark, [])
    assert importance_resampling.resample(none, target).count() == 0
    assert importance_resampling.resample(docs, target).count() == docs.count()


def test_drawn_documents_keep_their_columns(spark, docs):
    target = items_of(spark, [("1", "w1 w2", 1, None)])
    kept = importance_resampling.drawn_documents(docs, target, share=(1, 2))
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


# Decontamination


def brute_hits(text, items, window):
    w, hit, ids = words(text), set(), set()
    for item_id, item in items:
        v = words(item)
        size = min(window, len(v))
        phrases = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else ()
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in phrases:
                hit.update(range(i, i + size))
                ids.add(item_id or "")
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def items():
    texts = sample_texts(40, 9, 8)
    return [
        ("i1", None), ("i2", ""), ("i3", "Again"), (None, "one HOT text one"), ("i10", "of-the long, ONE"), ("i4", "hot text one hot text one hot text one hot text one"),
        ("i3", "w1"), ("i5", "日本"), ("i6", "long " * 30), ("i7", "never seen phrase"), *[(f"t{i}", t) for i, t in enumerate(texts)],
    ]


@pytest.mark.parametrize("window", [1, 3, 10])
def test_contamination(spark, rows, docs, items, window):
    table = items_of(spark, [(i, t, 0, "x") for i, t in items])
    got = decontamination.contamination(docs, table, window).drop("spans").collect()
    expected = Counter((r[0], *brute_hits(r[1], items, window)) for r in rows)
    assert Counter(tuple(r) for r in got) == expected
    assert any(r["contaminated"] for r in got) and not all(r["contaminated"] for r in got)


def test_contamination_over_many_blocks(spark, rows, docs, items, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 200)
    table = items_of(spark, [(i, t, 0, "x") for i, t in items])
    got = decontamination.contamination(docs, table, 3).drop("spans").collect()
    assert Counter(tuple(r) for r in got) == Counter((r[0], *brute_hits(r[1], items, 3)) for r in rows)


def test_contamination_of_nothing(spark, docs):
    none = spark.createDataFrame([], SCHEMA)
    assert decontamination.contamination(none, items_of(spark, [("1", "a b", 1, "x")])).count() == 0
    free = decontamination.contamination(docs, items_of(spark, []))
    assert free.count() == docs.count() and free.filter("contaminated OR n_hit > 0 OR n_items > 0").count() == 0


def test_packed_places_return():
    values = np.array([0, 1, 127, 128, 16383, 16384, (1 << 35) - 1, 5])
    data, sizes = decontamination.pack(values)
    assert decontamination.unpack(data).tolist() == values.tolist() and int(sizes.sum()) == len(data)


def test_proximity(spark):
    docs = spark.createDataFrame([row(1, "red x blue y y red blue"), row(2, "red a b c d e blue"), row(3, "red red"), row(4, None)], SCHEMA)
    index = decontamination.build_index(docs)
    hits = decontamination.proximity_hits(index, items_of(spark, [("p", "blue RED", 0, "")]), 3)
    found = decontamination.summary(index, hits)
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"] or []] for r in found.collect()}
    assert spans == {1: [(0, 3), (5, 7)], 2: [], 3: [], 4: []}


# Spelling variants


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_counts(rows, min_chars, slips):
    n = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = lower(run)
            if slips:
                h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
                if h % slips == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_chars:
                n[run] += 1
    return n


def brute_variants(rows, min_chars, min_count, ratio, slips):
    n = {w: c for w, c in brute_counts(rows, min_chars, slips).items() if c >= min_count}
    links = defaultdict(list)
    for a in n:
        for b in n:
            if near(a, b):
                links[a].append(b)
    form = {}
    for w, c in n.items():
        best = min(links[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= ratio * c else None
    out = set()
    for w, c in n.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, c, len(links[w]), n[form[w]] if form[w] else None))
    return out


def spelled_rows():
    rng = random.Random(11)
    letters = "abcdeéÿ×"
    stems = ["aaaaaa", "aaaaaaa", "ababab", "bababa", "abcabcabc", "receive", "sentence", "naïvely", "çedille"] + [
        "".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(40)
    ]
    out = edge_rows()
    for i in range(500):
        picked = []
        for _ in range(rng.randint(0, 30)):
            w = stems[min(int(rng.expovariate(0.08)), len(stems) - 1)]
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]])
            picked.append(rng.choice([w, w, w.upper(), w.title()]))
        out.append(row(1000 + i, rng.choice([" ", ", ", "1", "_"]).join(picked)))
    return out


@pytest.mark.parametrize(
    ("min_chars", "min_count", "ratio", "slips", "key_pairs"), [(6, 5, 5, 7, 4_000_000), (4, 1, 2, None, 20), (5, 2, 2, 199, 1)]
)
def test_variants(spark, monkeypatch, min_chars, min_count, ratio, slips, key_pairs):
    monkeypatch.setattr(spelling_variants, "KEY_PAIRS", key_pairs)
    rows = spelled_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = spelling_variants.variants(docs, min_chars, min_count, ratio, slips)
    expected = brute_variants(rows, min_chars, min_count, ratio, slips)
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == expected
    assert any(r[1] for r in expected) and any(r[1] and r[2] != r[1] for r in expected) == (ratio == 2)


def test_two_pivots_are_disjoint_and_cheapest():
    rng = random.Random(4)
    for _ in range(500):
        places = sorted(rng.sample(range(12), rng.randint(3, 8)))
        costs = [rng.randrange(1, 9) for _ in places]
        a, b = spelling_variants.choose_pivots(places, costs)
        assert places[b] - places[a] >= 2
        assert costs[a] + costs[b] == min(
            costs[i] + costs[j] for i in range(len(places)) for j in range(i) if places[i] - places[j] >= 2
        )


def test_variants_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert spelling_variants.variants(none).count() == 0
    blank = spark.createDataFrame([row(1, None), row(2, ""), row(3, "short ones")], SCHEMA)
    assert spelling_variants.variants(blank).count() == 0
    with pytest.raises(ValueError, match="at least"):
        spelling_variants.variants(blank, min_chars=3)


def test_pick_takes_the_exact_name(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id int, Text string, text2 string").select("id", "Text", F.col("text2").alias("text"))
    assert spelling_variants.pick(df, text="text").first()["text"] == "b"
