"""Spelling variants by pivotal grams: words one edit apart, and the more frequent form each one stands for.

1. Words are counted: in tasks first, then in a shuffle. `slips` plants misspellings, for trials: every word of a document
   whose hash divides by it loses one letter.
2. The bigrams of all words are ranked, rare ones first (a table bounded by the square of the alphabet).
3. The three rarest bigrams of a word, with all that tie with the third, are its prefix. Dynamic programming over their
   places picks the two disjoint ones with the shortest lists, the pivots. One edit spoils at most one of two disjoint
   bigrams. So of two words that are one edit apart, the one whose prefix ends at the rarer bigram has a pivot that stands
   in the prefix of the other, moved by at most one place (Deng, Li and Feng, SIGMOD 2014).
4. Pivots meet prefixes by an equi-join on bigram, length and place. The edit lies behind the pivot, then all letters before
   it are equal, or in front of it, then all letters behind it are; a hash of the equal side is part of the key. A key
   whose pairs would be too many for a task is split.
5. Pairs whose letter and bigram sets differ by more than one edit can change are dropped in the join; what is left is
   verified by edit distance, once a pair.

Null and empty texts have no words; a null id counts as ''. Repeated documents count again. Empty tables give no rows.
Only the id and the text column are read, so that other columns may have any name.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinseek.llm.common import arrow_map
from twinseek.llm.words import as_bytes, pick
from twinseek.plans.layout import spread
from twinseek.session import materialize

# Letters of a word once A-Z are lower-cased.
LETTERS = "a-zÀ-ÿ"
# Words one edit apart share bigrams only from this length on.
LEAST_CHARS = 4
# Different words a task counts before it hands them on.
HELD_WORDS = 300_000
# Pairs of one key that one task may look at.
KEY_PAIRS = 4_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def word_counts(docs: DataFrame, min_chars: int = 6, slips: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): occurrences of every run of letters of at least `min_chars` code points."""
    source = pick(spread(docs), doc_id=doc_id, text=text).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    # Shorter runs can't give a word; a slip makes them shorter still.
    pattern = re.compile(f"[{LETTERS}]{{{min_chars},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                seen = Counter(pattern.findall((data or b"").translate(_LOWER).decode()))
                start = zlib.crc32(f"{name}:".encode())
                for word, n in seen.items():
                    if slips:
                        h = zlib.crc32(word.encode(), start)
                        if h % slips == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < min_chars:
                                continue
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()

    return arrow_map(source, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, first place of each word, length of each word)."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return points, np.cumsum(sizes) - sizes, sizes


def _bigrams(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bigram, its word, its place in the word) of all words of two letters or more."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.flatnonzero(owner[:-1] == owner[1:])
    return (points[inside] << 21) | points[inside + 1], owner[inside], inside - starts[owner[inside]]


def bigram_ranks(words: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bigrams in ascending order with rank (0 is the rarest) and number of places; at most the square of the alphabet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, n = np.unique(_bigrams(*_letters(batch.column(0).to_pylist()))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n)], names=["gram", "n"])

    rows = arrow_map(words.select("word"), run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    grams, n = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
    rank = np.empty(len(grams), np.int64)
    rank[np.lexsort((grams, n))] = np.arange(len(grams))
    order = np.argsort(grams)
    return grams[order], rank[order], n[order]


def choose_pivots(places: list[int], costs: list[int]) -> tuple[int, int]:
    """Of bigrams sorted by place, the two disjoint ones (two places apart or more) of the least total cost.

    `one` is the best single bigram that ends before the present one; it makes the best pair that ends here.
    """
    one, ready, best = -1, 0, None
    for i, place in enumerate(places):
        while places[ready] + 2 <= place:
            one = ready if one < 0 or costs[ready] < costs[one] else one
            ready += 1
        if one >= 0 and (best is None or costs[one] + costs[i] < best[0]):
            best = (costs[one] + costs[i], one, i)
    return best[1], best[2]


def _hash(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        out = (out ^ part.astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1) - 1, base)]), dtype=np.uint64)


INDEX = "key long, pivot boolean, id long, last int, letters long, bigrams long"


def pivotal_index(words: DataFrame) -> DataFrame:
    """Rows (key, pivot, id, last, letters, bigrams) of `words` (id, word).

    `last` is the rank of the last bigram of the prefix; `letters` and `bigrams` are the sets as 64 bits each. A prefix
    bigram has two keys, one for each side that may be unchanged; a pivot has six, for the three lengths the other word may
    have.
    """
    shared = words.sparkSession.sparkContext.broadcast(bigram_ranks(words))  # at most the square of the alphabet
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))

    def rows(ids: np.ndarray, words: list[str]) -> pa.RecordBatch:
        known, ranks, costs = shared.value
        points, starts, sizes = _letters(words)
        gram, owner, place = _bigrams(points, starts, sizes)
        at = np.searchsorted(known, gram)
        rank, cost = ranks[at], costs[at]
        order = np.lexsort((place, rank, owner))
        first = np.cumsum(sizes - 1) - (sizes - 1)
        last = rank[order[first + 2]]
        inside = np.flatnonzero(rank <= last[owner])  # in order of word and place
        edges = np.searchsorted(owner[inside], np.arange(len(words) + 1))
        chosen = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            chosen.extend(a + i for i in choose_pivots(place[inside[a:b]].tolist(), cost[inside[a:b]].tolist()))
        # Hashes of the letters up to a bigram's end and from its start on: sums of letter x base^place.
        within = np.arange(len(points)) - np.repeat(starts, sizes)
        power, unpower = _powers(_BASE, int(sizes.max())), _powers(inverse, int(sizes.max()))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points.astype(np.uint64) * power[within], dtype=np.uint64)])
        from_start = starts[owner] + place
        head = sums[from_start + 2] - sums[starts[owner]]
        tail = (sums[starts[owner] + sizes[owner]] - sums[from_start]) * unpower[place]
        bit = lambda x: np.uint64(1) << ((_hash(x).view(np.uint64)) >> np.uint64(58))
        letters = np.bitwise_or.reduceat(bit(points), starts).view(np.int64)
        bigrams = np.bitwise_or.reduceat(bit(gram), first).view(np.int64)
        out = []

        def add(which: np.ndarray, pivot: bool, change: int) -> None:
            size, side = sizes[owner[which]] + change, np.zeros(len(which), np.int64)
            for key in (_hash(gram[which], place[which], size, side, head[which]), _hash(gram[which], place[which] + change, size, side + 1, tail[which])):
                w = owner[which]
                out.append((key, np.full(len(which), pivot), ids[w], last[w].astype(np.int32), letters[w], bigrams[w]))

        add(inside, False, 0)
        for change in (-1, 0, 1):
            add(inside[np.array(chosen, np.int64)], True, change)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["key", "pivot", "id", "last", "letters", "bigrams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield rows(batch.column(0).to_numpy(), batch.column(1).to_pylist())

    return arrow_map(words.select("id", "word"), run, INDEX)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), a < b: ids of all words (id, word; each of `LEAST_CHARS` letters or more) that are exactly one edit apart."""
    index = materialize(pivotal_index(words), "pivotal-index")
    sides = index.groupBy("key").agg(F.count(F.when(F.col("pivot"), 1)).alias("p"), F.count(F.when(~F.col("pivot"), 1)).alias("x"))
    # A key with pairs for several tasks: its prefixes are dealt, its pivots copied.
    split = sides.filter(F.col("p") * F.col("x") > KEY_PAIRS).select("key", F.ceil(F.col("p") * F.col("x") / KEY_PAIRS).cast("long").alias("parts"))
    split = materialize(split, "split-keys")
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    marked = index.join(split, "key", "left")
    held = marked.filter("NOT pivot").withColumn("part", F.pmod(F.xxhash64("id"), parts))
    asked = marked.filter("pivot").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    p, x = asked.alias("p"), held.alias("x")
    differ = lambda c, most: F.bit_count(F.col(f"p.{c}").bitwiseXOR(F.col(f"x.{c}"))) <= most
    # One edit takes and brings at most one letter and two bigrams.
    met = (
        (F.col("p.key") == F.col("x.key")) & (F.col("p.part") == F.col("x.part")) & (F.col("p.id") != F.col("x.id"))
        & (F.col("p.last") <= F.col("x.last")) & differ("letters", 2) & differ("bigrams", 4)
    )
    found = p.join(x, met).select(F.least("p.id", "x.id").alias("a"), F.greatest("p.id", "x.id").alias("b")).distinct()
    text = lambda c: words.select(F.col("id").alias(c), F.col("word").alias(f"word_{c}"))
    known = found.join(text("a"), "a").join(text("b"), "b")
    return known.filter(F.call_function("levenshtein", "word_a", "word_b", F.lit(1)) == 1).select("a", "b")


def variants(
    docs: DataFrame, min_chars: int = 6, min_count: int = 5, ratio: int = 5, slips: int | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of at least `min_chars` letters and `min_count` occurrences.

    The form of a word is its most frequent near word (ties: the first in code-point order), if that is at least `ratio`
    times as frequent; its root is the end of the chain of forms.
    """
    if min_chars < LEAST_CHARS or ratio < 2:
        raise ValueError(f"min_chars is at least {LEAST_CHARS} and ratio at least 2: {min_chars}, {ratio}")
    counted = word_counts(docs, min_chars, slips, doc_id, text).filter(F.col("n") >= min_count)
    words = materialize(counted.withColumn("id", F.monotonically_increasing_id()), "words")
    pairs = materialize(near_pairs(words), "near-words")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("id").alias("b"), F.struct((-F.col("n")).alias("less"), "word", F.col("id").alias("to")).alias("near"))
    # A word of k letters has at most 2k + 1 times the alphabet near words, so no key of these joins is large.
    best = both.join(other, "b").groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    known = words.join(best, "id", "left")
    good = -F.col("near.less") >= ratio * F.col("n")
    known = known.select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(good, F.col("near.word")).alias("form"), F.when(good, -F.col("near.less")).alias("form_n"), F.when(good, F.col("near.to")).alias("to"),
    )
    known = materialize(known, "forms")
    # Counts grow by `ratio` with every step, which bounds the chains; each round doubles the steps done.
    steps = known.filter("to IS NOT NULL").select("id", "to")
    longest = math.log(max(known.agg(F.max("n")).first()[0] or 1, 2), ratio)
    for _ in range(math.ceil(math.log2(longest + 1))):
        onward = steps.select(F.col("id").alias("to"), F.col("to").alias("next"))
        steps = materialize(steps.join(onward, "to", "left").select("id", F.coalesce("next", "to").alias("to")), "roots")
    end = steps.join(words.select(F.col("id").alias("to"), F.col("word").alias("root")), "to").select("id", "root")
    return known.join(end, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
