"""Substring dedup: removes every word covered by a window of words that also starts somewhere else.

1. *Where to look.* Every window of `window` words holds an anchor, the k-gram of least hash in it; equal windows have
   equal anchors. About 8 % of all positions are anchors. Anchors are counted with map-side combining; one seen twice or
   more names its *family* (the document of least hash that has it), and the windows it is the anchor of form a segment of
   that family. Overlapping segments of one document and family are joined, so a place is in a family once, and all places of
   a window meet in the family of its anchor.
2. *What repeats.* A family, its equal segments merged with their number, is a reference shard. Its suffix automaton is
   built inside a task and its segments are streamed through it: the matching statistic at a word is the longest suffix
   that occurs at least twice in the shard. Statistics of `window` or more give the maximal spans to remove.
   A shard of more than `FAMILY_WORDS` words (a passage found in a third of all documents, say) would not fit a task; its
   windows are counted in a shuffle by 128-bit hash, with the same result.
3. The spans are joined back to the documents.

Automata are not broadcast to all tasks: that costs documents times shards. Each shard meets only the segments that can
match it, by a shuffle on the family.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinseek.llm.common import arrow_map, run_bounds, whole_runs
from twinseek.plans.layout import lookup_join
from twinseek.session import materialize

WINDOW = 35
# Words of an anchor.
ANCHOR = 12
# Words of a family whose automaton one task builds.
FAMILY_WORDS = 60_000
_STREAM = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best(values[i : i + width]) for every i, by doubling."""
    have = 1
    while have * 2 <= width:
        values = best(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return best(values[:-rest], values[rest:]) if rest else values


def _grams(joined: bytes, size: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the words, hash of the `size` words that begin at each): a polynomial of the bytes, whatever stands before."""
    stream = np.frombuffer(joined, np.uint8)
    space = np.flatnonzero(stream == 32)
    starts = np.concatenate(([0], space + 1))
    ends = np.concatenate((space, [len(stream)]))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((stream.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(stream)), dtype=np.uint64)))
    n = len(starts) - size + 1
    return starts, _mix((sums[ends[size - 1 :]] - sums[starts[:n]]) * _powers(_P_INV, len(stream))[starts[:n]])


def owners_of(joined: bytes, window: int = WINDOW, size: int = ANCHOR) -> np.ndarray:
    """For every window of a text, the place of its anchor: the leftmost gram of least hash in it."""
    _, grams = _grams(joined, size)
    span = window - size + 1
    out = np.empty(len(grams) - span + 1, np.int64)
    for at in range(0, len(out), 1 << 16):
        part = np.lib.stride_tricks.sliding_window_view(grams[at : at + (1 << 16) + span - 1], span)
        out[at : at + len(part)] = part.argmin(axis=1) + np.arange(at, at + len(part))
    return out


def anchors_of(docs: list[bytes], window: int = WINDOW, size: int = ANCHOR) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, word numbers) of the anchors of texts whose words are joined by one space; all have `window` words or more."""
    starts, grams = _grams(b" ".join(docs), size)
    span = window - size + 1
    lowest = _sliding(grams, span, np.minimum)
    first = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(d) + 1 for d in docs])[:-1])))
    last = np.concatenate((first[1:], [len(starts)]))  # word numbers of each document
    valid = np.zeros(len(lowest) + 1, np.int8)
    valid[first] += 1
    np.subtract.at(valid, last - window + 1, 1)
    lowest = np.where(np.cumsum(valid[:-1], dtype=np.int8) > 0, lowest, np.uint64(0))
    pad = np.zeros(span - 1, np.uint64)
    highest = _sliding(np.concatenate((pad, lowest, pad)), span, np.maximum)
    at = np.flatnonzero(highest[: len(grams)] == grams)
    cut = np.searchsorted(at, last[:-1])
    hashes = np.split(grams[at].view(np.int64), cut)
    return list(zip(hashes, [p - f for p, f in zip(np.split(at, cut), first, strict=True)], strict=True))


def covered(sequences: list[list], counts: list[int], window: int = WINDOW) -> list[np.ndarray]:
    """For each sequence, which words a window covers that occurs at least twice; a sequence counts as often as `counts` says.

    Suffix automaton of all sequences, with separators that occur once. The prefix of the stream that ends at a word is a
    state; walking up its suffix links to a state seen twice gives the matching statistic.
    """
    following: list[dict] = [{}]
    link, length, seen = [-1], [0], [0]
    ends: list[int] = []
    last = 0
    for number, (sequence, count) in enumerate(zip(sequences, counts, strict=True)):
        for c, weight in [*((c, count) for c in sequence), (-1 - number, 0)]:
            state = len(following)
            following.append({})
            length.append(length[last] + 1)
            link.append(0)
            seen.append(weight)
            p = last
            while p >= 0 and c not in following[p]:
                following[p][c] = state
                p = link[p]
            if p >= 0:
                q = following[p][c]
                if length[p] + 1 == length[q]:
                    link[state] = q
                else:
                    twin = len(following)
                    following.append(following[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    seen.append(0)
                    while p >= 0 and following[p].get(c) == q:
                        following[p][c] = twin
                        p = link[p]
                    link[q] = link[state] = twin
            last = state
            ends.append(state)
    order = np.argsort(np.array(length), kind="stable").tolist()
    for v in reversed(order[1:]):
        seen[link[v]] += seen[v]
    longest = [0] * len(length)
    for v in order[1:]:
        longest[v] = length[v] if seen[v] >= 2 else longest[link[v]]
    out, at = [], 0
    for sequence in sequences:
        n = len(sequence)
        statistic = np.minimum(np.array([longest[v] for v in ends[at : at + n]], np.int64), np.arange(1, n + 1))
        out.append(_cover(np.flatnonzero(statistic >= window) - window + 1, n, window))
        at += n + 1
    return out


def _cover(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Words covered by the windows that start at `starts`."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, np.minimum(np.asarray(starts) + window, n), 1)
    return np.cumsum(edge)[:-1] > 0


def _spans(mask: np.ndarray) -> list[int]:
    """Alternating starts and ends of the true stretches."""
    return np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))).tolist()


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, did, tk, text): did and tk tell documents apart and are never null; rows equal in both are copies."""
    ident, whole = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    return docs.select(
        ident.alias("doc_id"),
        F.coalesce(ident.cast("long"), F.lit(-(2**63))).alias("did"),
        F.xxhash64(ident.isNull(), whole).alias("tk"),
        whole.alias("text"),
    )


def _scan(keyed: DataFrame, window: int) -> DataFrame:
    """(doc_id, did, tk, n_words, sha, hashes, places): word count, digest of the words joined by one space, anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            counts, shas = np.zeros(n, np.int64), []
            hashes: list[np.ndarray] = [np.zeros(0, np.int64)] * n
            places: list[np.ndarray] = [np.zeros(0, np.int64)] * n
            group: list[tuple[int, bytes]] = []

            def flush(group=group, hashes=hashes, places=places) -> None:
                for (i, _), (h, p) in zip(group, anchors_of([d for _, d in group], window) if group else (), strict=True):
                    hashes[i], places[i] = h, p
                group.clear()

            size = 0
            for i, text in enumerate(batch.column(3).to_pylist()):
                words = words_of(text)
                joined = b" ".join(words)
                counts[i] = len(words)
                shas.append(hashlib.sha256(joined).hexdigest())
                if len(words) >= window:
                    group.append((i, joined))
                    size += len(joined)
                if size > _STREAM:
                    flush()
                    size = 0
            flush()
            lists = [
                pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in xs]))), pa.int32()), pa.array(np.concatenate(xs), kind))
                for xs, kind in ((hashes, pa.int64()), (places, pa.int32()))
                if n
            ]
            if n:
                cols = [*batch.columns[:3], pa.array(counts), pa.array(shas, pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "did", "tk", "n_words", "sha", "hashes", "places"])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, did long, tk long, n_words long, sha string, hashes array<long>, places array<int>"
    return arrow_map(keyed, run, schema)


def _segments(candidates: DataFrame, window: int) -> DataFrame:
    """(did, tk, family, start, n, seg, words): the windows of a family's anchors, joined where they overlap; `seg` identifies the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["did", "tk", "family", "start", "n", "seg", "words"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for did, tk, text, routes in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = words_of(text)
                owners = owners_of(b" ".join(words), window)
                by_family: dict[int, list[int]] = {}
                for r in routes:
                    by_family.setdefault(r["family"], []).append(r["place"])
                for family, places in by_family.items():
                    begin = np.flatnonzero(np.isin(owners, places))
                    if not len(begin):
                        continue
                    new = np.flatnonzero(np.concatenate(([True], begin[1:] >= begin[:-1] + window)))
                    for a, b in zip(begin[new].tolist(), (begin[np.concatenate((new[1:], [len(begin)])) - 1] + window).tolist(), strict=True):
                        joined = b" ".join(words[a:b])
                        for col, x in zip(rows, (did, tk, family, a, b - a, xxhash.xxh3_128_digest(joined), joined), strict=True):
                            col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=names)

    schema = "did long, tk long, family long, start int, n int, seg binary, words binary"
    return arrow_map(candidates.select("did", "tk", "text", "routes"), run, schema)


def _by_automaton(distinct: DataFrame, window: int) -> DataFrame:
    """(family, seg, spans) of small families."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, 0):
            family = table.column(0).to_numpy()
            seg, words, copies = (table.column(i).to_pylist() for i in (1, 2, 3))
            out: list[list] = [[], [], []]
            at = run_bounds(family).tolist()
            for a, b in zip(at[:-1], at[1:], strict=True):
                sequences = [w.split() for w in words[a:b]]
                if b - a == 1 and copies[a] > 1:
                    masks = [np.ones(len(sequences[0]), bool)]
                else:
                    masks = covered(sequences, copies[a:b], window)
                for i, mask in zip(range(a, b), masks, strict=True):
                    if mask.any():
                        for col, x in zip(out, (int(family[i]), seg[i], _spans(mask)), strict=True):
                            col.append(x)
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["family", "seg", "spans"])

    sorted_ = distinct.select("family", "seg", "words", "copies").repartition("family").sortWithinPartitions("family")
    return arrow_map(sorted_, run, "family long, seg binary, spans array<int>")


def _by_windows(distinct: DataFrame, window: int) -> DataFrame:
    """(family, seg, spans) of large families, their windows counted by 128-bit hash."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            family = batch.column(0).to_numpy()
            for row, (seg, joined, copies) in enumerate(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)):
                space = [-1, *np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist(), len(joined)]
                n = len(space) - window
                digests = b"".join(xxhash.xxh3_128_digest(joined[space[i] + 1 : space[i + window]]) for i in range(n))
                # A window that recurs inside a segment, as in a repeated line, is one row with all its places.
                own, number, times = np.unique(np.frombuffer(digests, "V16"), return_inverse=True, return_counts=True)
                pair = np.frombuffer(own.tobytes(), "<i8").reshape(-1, 2)
                offsets = np.concatenate(([0], np.cumsum(times))).astype(np.int32)
                places = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.argsort(number, kind="stable").astype(np.int32)))
                cols = [
                    pa.array(np.full(len(own), family[row])), pa.array([seg] * len(own), pa.binary()), places,
                    pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(times * np.int64(copies)),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["family", "seg", "places", "h1", "h2", "copies"])

    windows = arrow_map(distinct.select("family", "seg", "words", "copies"), explode, "family long, seg binary, places array<int>, h1 long, h2 long, copies long")
    windows = materialize(windows, "substring-windows")
    twice = windows.groupBy("family", "h1", "h2").agg(F.sum("copies").alias("n")).filter("n > 1").drop("n")
    found = windows.join(twice, ["family", "h1", "h2"]).groupBy("family", "seg").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("at"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [_spans(_cover(np.array(x), x[-1] + window, window)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(lists, pa.list_(pa.int32()))], names=["family", "seg", "spans"])

    return arrow_map(found, spans, "family long, seg binary, spans array<int>")


def _found(keyed: DataFrame, window: int, family_words: int) -> tuple[DataFrame, DataFrame]:
    """The scan of all documents, and (did, tk, text, spans) of those that lose words, one row per (did, tk)."""
    scanned = materialize(_scan(keyed, window), "substring-scan")
    placed = scanned.select("did", "tk", F.explode(F.arrays_zip("hashes", "places")).alias("a"))
    placed = placed.select("did", "tk", F.col("a.hashes").alias("h"), F.col("a.places").alias("place"))
    counted = placed.groupBy("h").agg(F.count("*").alias("n"), F.min(F.xxhash64("did", "tk")).alias("family"))
    repeated = materialize(counted.filter("n > 1"), "substring-anchors")
    total = scanned.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0)).alias("n")).first().n
    # A line found everywhere is an anchor of very many rows: such keys go through a broadcast of bounded size.
    routed = lookup_join(placed, repeated, ["h"], "n", total)
    routes = routed.groupBy("did", "tk").agg(F.collect_set(F.struct("family", "place")).alias("routes"))
    candidates = materialize(keyed.select("did", "tk", "text").join(routes, ["did", "tk"]), "substring-candidates")
    segments = materialize(_segments(candidates, window), "substring-segments")
    distinct = segments.groupBy("family", "seg").agg(F.count("*").alias("copies"), F.first("n").alias("n"), F.first("words").alias("words"))
    distinct = materialize(distinct, "substring-distinct")
    sizes = distinct.groupBy("family").agg((F.sum("n") > family_words).alias("large"))
    sized = distinct.join(sizes, "family")
    spans = _by_automaton(sized.filter("NOT large"), window).unionByName(_by_windows(sized.filter("large"), window))
    shifted = F.transform("spans", lambda x: x + F.col("start"))
    per_doc = segments.select("did", "tk", "family", "seg", "start").join(spans, ["family", "seg"]).select("did", "tk", shifted.alias("s"))
    per_doc = per_doc.groupBy("did", "tk").agg(F.collect_set("s").alias("spans"))
    texts = candidates.select("did", "tk", "text").dropDuplicates(["did", "tk"])
    return scanned, texts.join(per_doc, ["did", "tk"])


def _cut(found: DataFrame) -> DataFrame:
    """(did, tk, n_removed, kept): the words left, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = words_of(text)
                mask = np.zeros(len(words), bool)
                for span in spans:
                    for a, b in zip(span[::2], span[1::2], strict=True):
                        mask[a:b] = True
                removed.append(int(mask.sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~mask).tolist()]).decode("utf-8", "surrogatepass"))
            cols = [*batch.columns[:2], pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["did", "tk", "n_removed", "kept"])

    return arrow_map(found, run, "did long, tk long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, family_words: int = FAMILY_WORDS) -> DataFrame:
    """One row per document: doc_id, text (the words left, joined by one space), n_words, n_removed.

    A word goes if a window of `window` words covers it whose word sequence also starts anywhere else, in the same document
    or another, copies of rows included; windows are judged on the input. Null and empty texts have no words. Other columns
    of `docs` are ignored.
    """
    keyed = _keyed(docs, doc_id, text)
    scanned, found = _found(keyed, window, family_words)
    cut = _cut(found)
    whole = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ")
    counts = scanned.select("did", "tk", "n_words").dropDuplicates(["did", "tk"])
    out = keyed.join(counts, ["did", "tk"]).join(cut, ["did", "tk"], "left")
    return out.select("doc_id", F.coalesce("kept", whole).alias("text"), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"))


def repeat_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, family_words: int = FAMILY_WORDS) -> DataFrame:
    """The same without the texts: doc_id, n_words, n_removed, kept_sha256. Untouched texts are not shuffled."""
    scanned, found = _found(_keyed(docs, doc_id, text), window, family_words)
    cut = _cut(found).select("did", "tk", "n_removed", F.sha2("kept", 256).alias("kept_sha"))
    out = scanned.select("doc_id", "did", "tk", "n_words", "sha").join(cut, ["did", "tk"], "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256")
    )
