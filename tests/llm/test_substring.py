"""Substring dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from twinseek.llm import substring_dedup as sd


def slow(texts: list[str | None], window: int) -> list[tuple[int, int, str]]:
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), kept))
    return out


def corpus() -> list[tuple[int | None, str | None]]:
    rng = random.Random(11)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(300)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [prose(n) for n in (34, 35, 36, 80, 200)]
    rows: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, " \t\n "), (None, "alone"), (4, "und " * 500), (5, "a b " * 40)]
    for i in range(60):
        text = prose(rng.randint(0, 150))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(text))
            text[at:at] = rng.choice(shared)
        rows.append((10 + i, rng.choice([" ", "\n", "  \t"]).join(text)))
    for i in range(40):  # near copies
        text = rows[20][1].split()
        text[rng.randrange(len(text)) :][:1] = ["edited"]
        rows.append((200 + i, " ".join(text)))
    rows += [(300 + i, rows[30][1]) for i in range(12)] + [(7, rows[31][1]), (7, rows[31][1]), (None, rows[32][1]), (None, rows[32][1])]
    rows.append((400, " ".join(prose(20_000))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("family_words", [sd.FAMILY_WORDS, 50])
def test_repeats(spark, family_words):
    rows = corpus()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, did string, n_words int").repartition(5)
    want = slow([t for _, t in rows], sd.WINDOW)
    got = sorted(map(repr, map(tuple, sd.repeat_digests(frame, family_words=family_words).collect())))
    assert got == sorted(repr((r[0], n, gone, hashlib.sha256(kept.encode()).hexdigest())) for r, (n, gone, kept) in zip(rows, want, strict=True))
    if family_words == 50:
        texts = sd.remove_repeats(frame, family_words=family_words).collect()
        assert sorted(map(repr, map(tuple, texts))) == sorted(repr((r[0], kept, n, gone)) for r, (n, gone, kept) in zip(rows, want, strict=True))


def test_no_rows(spark):
    assert sd.repeat_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_automaton():
    rng = random.Random(2)
    for _ in range(200):
        sequences = [[rng.randrange(3) for _ in range(rng.randint(1, 30))] for _ in range(rng.randint(1, 5))]
        counts = [rng.randint(1, 2) for _ in sequences]
        window = rng.randint(1, 6)
        texts = [" ".join(map(str, s)) for s, n in zip(sequences, counts, strict=True) for _ in range(n)]
        want = slow(texts, window)
        at = 0
        for mask, n in zip(sd.covered(sequences, counts, window), counts, strict=True):
            assert int(mask.sum()) == want[at][1]
            at += n
