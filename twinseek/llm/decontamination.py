"""Benchmark decontamination by a distributed positional inverted index of the training words.

`build_index` writes the index once. It is cut by documents into segments of a few MB of text; a segment is one row with
its documents, its terms and, for every term, the list of its places in the segment (differences of places, one to five
bytes each). A common term is thereby spread over all segments, and lists that have to be intersected are always in one row.

`phrase_hits` finds exact phrases. Terms of the tested texts are counted in the index; the windows of a segment start from
the list of their rarest term, less its offset in the window, and keep the starts that the offset-adjusted lists of the
other terms hold too, in order of rarity. `proximity_hits` finds all terms of a text within a span of words.

The tested texts are worked through in blocks of bounded size; one block is held by every task, and every block meets every
segment. So the tables may both grow: tasks hold one segment and one block.

Words are runs of [0-9a-z] and of non-ASCII characters after A-Z are lower-cased. Null and empty texts have no words and hit
nothing. Null ids stay null, a null item counts as ''. Repeated documents are judged one by one, repeated items of one id
count once, and empty tables give no hits. Only the id and the text columns are read; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinseek.llm.common import arrow_map
from twinseek.llm.words import as_bytes, folded, pick, ragged, slices
from twinseek.plans.layout import spread
from twinseek.session import materialize

# Words of tested texts in one block.
BLOCK_WORDS = 500_000
# Places of a document are numbered on from those of the one before, with a gap that no phrase bridges.
GAP = 1
# Starts that are tried at once.
_TRIED = 1 << 21


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes of non-negative numbers below 2^35, low 7 bits first, and the length of each."""
    sizes = 1 + sum((values >> (7 * k) > 0).astype(np.int64) for k in range(1, 5))
    at, owner = ragged(np.zeros(len(values), np.int64), sizes)
    out = (values[owner] >> (7 * at)) & 127
    return (out | np.where(at + 1 < sizes[owner], 128, 0)).astype(np.uint8), sizes


def unpack(data: np.ndarray) -> np.ndarray:
    """The numbers that `pack` wrote."""
    if not len(data):
        return np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(data < 128)[:-1] + 1])
    at = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * at), starts)


def _segment(texts: list[bytes | None]) -> tuple[list[int], list[bytes], np.ndarray, bytes]:
    """(words per text, sorted terms, places per term, their packed lists one after the other)."""
    split = [folded(t) for t in texts]
    n_words = [len(w) for w in split]
    words = [w for ws in split for w in ws]
    terms = sorted(set(words))
    number = {t: i for i, t in enumerate(terms)}
    term = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    place = np.arange(len(words)) + GAP * np.repeat(np.arange(len(split)), n_words)
    order = np.argsort(term, kind="stable")
    counts = np.bincount(term, minlength=len(terms))
    lists = place[order]
    steps = np.diff(lists, prepend=0)
    first = np.cumsum(counts) - counts
    steps[first] = lists[first]
    return n_words, terms, counts, pack(steps)[0].tobytes()


@dataclass(frozen=True)
class Segment:
    """A row of the index in the memory of a task. `keys` holds (term number, place), sorted."""

    terms: pa.Array
    keys: np.ndarray
    first: np.ndarray
    counts: np.ndarray
    doc_starts: np.ndarray

    @classmethod
    def read(cls, n_words: np.ndarray, terms: pa.Array, counts: np.ndarray, packed: bytes) -> Segment:
        first = np.cumsum(counts) - counts
        run = np.cumsum(unpack(np.frombuffer(packed, np.uint8)))
        if len(run):
            before = np.where(first > 0, run[first - 1], 0)
            run = run - np.repeat(before, counts)
        owner = np.repeat(np.arange(len(counts)), counts)
        starts = np.cumsum(n_words + GAP) - (n_words + GAP)
        return cls(terms, (owner.astype(np.int64) << 32) | run, first, counts, starts)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Number of each word among the terms, -1 for one that does not occur."""
        return pc.fill_null(pc.index_in(words, self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def holds(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Does each term's list hold this place?"""
        wanted = (term << 32) | place
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return (place >= 0) & (self.keys[at] == wanted)

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_starts, place, "right") - 1


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the index: (segment, doc_ids, n_words, terms, counts, places), one row for a few MB of text."""
    source = pick(spread(docs), doc_id=doc_id, text=text)
    id_type = source.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("segment", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(id_type)),
            T.StructField("n_words", T.ArrayType(T.LongType())),
            T.StructField("terms", T.ArrayType(T.StringType())),
            T.StructField("counts", T.ArrayType(T.LongType())),
            T.StructField("places", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for lo, hi in slices(texts):
                n_words, terms, counts, places = _segment(texts[lo:hi])
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                cols = [
                    pa.array([number]), one(batch.column(0).slice(lo, hi - lo)), one(pa.array(n_words, pa.int64())),
                    one(pa.array(terms, pa.binary()).cast(pa.string())), one(pa.array(counts, pa.int64())), pa.array([places], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
                number += 1

    return materialize(arrow_map(source, run, schema), "positional-index")


def indexed_documents(index: DataFrame) -> DataFrame:
    """(segment, row, doc_id, n_words) of every document."""
    pairs = F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("row", "doc")
    return index.select("segment", pairs).select("segment", "row", F.col("doc.doc_ids").alias("doc_id"), F.col("doc.n_words").alias("n_words"))


@dataclass(frozen=True)
class Block:
    """Tested texts of one pass, as windows of numbers into `terms`, which are sorted from the rarest in the index on.

    Row i of `words` has the words of window i from its rarest on, -1 behind the last one, and `offsets` their places in
    the window. `items` are ids; those of window i are `item_of[held_from[i]:held_from[i + 1]]`.
    """

    terms: pa.Array
    words: np.ndarray
    offsets: np.ndarray
    sizes: np.ndarray
    items: list[str]
    held_from: np.ndarray
    item_of: np.ndarray

    @classmethod
    def of(cls, terms: list[str], windows: dict[tuple[int, ...], set[int]], items: list[str]) -> Block:
        sizes = np.array([len(w) for w in windows])
        at, owner = ragged(np.zeros(len(sizes), np.int64), sizes)
        words = np.full((len(sizes), int(sizes.max())), len(terms), np.int32)
        words[owner, at] = np.fromiter((x for w in windows for x in w), np.int32, int(sizes.sum()))
        offsets = np.argsort(words, axis=1, kind="stable")
        words = np.take_along_axis(words, offsets, axis=1)
        words[words == len(terms)] = -1
        held = np.array([len(h) for h in windows.values()])
        item_of = np.fromiter((x for h in windows.values() for x in sorted(h)), np.int64, int(held.sum()))
        return cls(pa.array(terms, pa.string()), words, offsets.astype(np.int32), sizes, items, np.concatenate([[0], np.cumsum(held)]), item_of)

    def present(self, number: np.ndarray) -> np.ndarray:
        """Windows whose words all occur in a segment, where `number` has the words' numbers, from the rarest word on."""
        alive = np.flatnonzero(number[self.words[:, 0]] >= 0)
        known = np.append(number, 0)  # the last one answers for -1
        for k in range(1, self.words.shape[1]):
            alive = alive[known[self.words[alive, k]] >= 0]
        return alive


def tested_words(items: DataFrame, window: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(block, item_id, words): the words of every item, written once; items longer than a block are cut so that no window is lost."""
    source = pick(items, item_id=item_id, text=text).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    step = max(1, BLOCK_WORDS // 8 - window + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cut = [], []
            for name, data in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                words = folded(data)
                for start in range(0, max(1, len(words) - window + 1), step) if words else ():
                    ids.append(name)
                    cut.append([w.decode() for w in words[start : start + step + window - 1]])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(cut, pa.list_(pa.string()))], names=["item_id", "words"])

    return materialize(arrow_map(source, run, "item_id string, words array<string>").distinct(), "tested-words")


def term_counts(index: DataFrame, tested: DataFrame) -> DataFrame:
    """(term, n) for the terms of the tested texts that the index holds."""
    terms = tested.select(F.explode("words").alias("term")).distinct()
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).select(F.col("p.terms").alias("term"), F.col("p.counts").alias("n"))
    return pairs.groupBy("term").agg(F.sum("n").alias("n")).join(terms, "term", "left_semi")


def _blocks(tested: DataFrame, counts: DataFrame, window: int) -> Iterator[Block]:
    """Loads the tested texts block by block, with windows that are equal inside a block made one."""
    total = tested.agg(F.sum(F.size("words"))).first()[0] or 0
    n_blocks = -(-total // (BLOCK_WORDS // 2))
    dealt = tested.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(max(n_blocks, 1)))) if n_blocks > 1 else tested.withColumn("block", F.lit(0))
    for b in range(n_blocks):
        rows = dealt.filter(F.col("block") == b)
        known = counts.join(rows.select(F.explode("words").alias("term")).distinct(), "term", "left_semi")
        terms = [r.term for r in known.orderBy("n", "term").collect()]  # at most the words of a block
        number = {t: i for i, t in enumerate(terms)}
        windows: dict[tuple[int, ...], set[int]] = {}
        items: dict[str, int] = {}
        for r in rows.toLocalIterator():
            item = items.setdefault(r.item_id, len(items))
            codes = [number.get(w, -1) for w in r.words]
            for i in range(max(1, len(codes) - window + 1)):
                found = tuple(codes[i : i + window])
                if -1 not in found:  # a term that occurs nowhere
                    windows.setdefault(found, set()).add(item)
        if windows:
            yield Block.of(terms, windows, list(items))


def find_phrases(segment: Segment, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first place, place behind the last, window) of all exact occurrences, some windows at a time."""
    number = segment.numbers(block.terms)
    alive = block.present(number)
    if not len(alive):
        return
    rarest = number[block.words[alive, 0]]
    work = np.cumsum(segment.counts[rarest])
    cuts = np.unique(np.searchsorted(work, np.arange(0, work[-1] + _TRIED, _TRIED)))
    for lo, hi in zip(cuts, [*cuts[1:], len(alive)], strict=True):
        at, owner = ragged(segment.first[rarest[lo:hi]], segment.counts[rarest[lo:hi]])
        window = alive[lo:hi][owner]
        start = (segment.keys[at] & 0xFFFFFFFF) - block.offsets[window, 0]
        for k in range(1, block.words.shape[1]):
            word = block.words[window, k]
            keep = (word < 0) | segment.holds(number[word], start + block.offsets[window, k])
            window, start = window[keep], start[keep]
        yield start, start + block.sizes[window], window


def find_near(segment: Segment, block: Block, span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same for the shortest stretches of at most `span` words that hold all words of a window in any order."""
    number = segment.numbers(block.terms)
    for w in block.present(number):
        terms = np.unique(number[block.words[w, : block.sizes[w]]])
        lists = [segment.keys[segment.first[t] : segment.first[t] + segment.counts[t]] & 0xFFFFFFFF for t in terms]
        rarest = min(lists, key=len)
        ends = np.unique(np.concatenate([x[_near(x, rarest, span)] for x in lists]))
        start = ends
        for x in lists:  # the last place of every term up to each end
            at = np.searchsorted(x, ends, "right") - 1
            start = np.where(at >= 0, np.minimum(start, x[np.maximum(at, 0)]), -1)
        good = (start >= 0) & (ends - start < span) & (segment.document(start) == segment.document(ends))
        start, ends = start[good], ends[good]
        shortest = np.diff(start, prepend=-1) > 0
        yield start[shortest], ends[shortest] + 1, np.full(int(shortest.sum()), w)


def _near(places: np.ndarray, others: np.ndarray, span: int) -> np.ndarray:
    """Which of the sorted places lie less than `span` from one of the sorted others?"""
    at = np.searchsorted(others, places)
    after = others[np.minimum(at, len(others) - 1)] - places
    before = places - others[np.maximum(at - 1, 0)]
    return (np.abs(after) < span) | (np.abs(before) < span)


def _union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged stretches of places; the input is sorted by start."""
    upto = np.maximum.accumulate(ends)
    cut = np.flatnonzero(np.concatenate([[True], starts[1:] > upto[:-1]]))
    return starts[cut], np.append(upto[cut[1:] - 1], upto[-1])


HITS = "segment long, row int, starts array<long>, ends array<long>, items array<string>"


def _scan_index(index: DataFrame, block: Block, find) -> DataFrame:
    """Runs `find(segment, block)`, which yields (start, end, window) arrays, on every segment."""
    shared = index.sparkSession.sparkContext.broadcast(block)  # at most BLOCK_WORDS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment.read(
                    batch.column(1)[i].values.to_numpy(zero_copy_only=False), batch.column(2)[i].values,
                    batch.column(3)[i].values.to_numpy(zero_copy_only=False), batch.column(4)[i].as_py(),
                )
                found = [f for f in find(segment, block) if len(f[0])]
                if not found:
                    continue
                start, end, window = (np.concatenate(c) for c in zip(*found, strict=True))
                order = np.argsort(start, kind="stable")
                start, end, window = start[order], end[order], window[order]
                doc = segment.document(start)
                # Distinct (document, window) pairs first, then their items.
                pairs = np.unique(np.stack([doc, window], axis=1), axis=0)
                at, owner = ragged(block.held_from[pairs[:, 1]], np.diff(block.held_from)[pairs[:, 1]])
                met = np.unique(np.stack([pairs[owner, 0], block.item_of[at]], axis=1), axis=0)
                rows, out = np.unique(doc), ([], [], [])
                edges, met_edges = np.searchsorted(doc, [rows, rows + 1]).T, np.searchsorted(met[:, 0], [rows, rows + 1]).T
                for row, (a, b), (c, d) in zip(rows, edges, met_edges, strict=True):
                    base = segment.doc_starts[row]
                    for o, values in zip(out, _union(start[a:b], end[a:b]), strict=False):
                        o.append((values - base).tolist())
                    out[2].append([block.items[x] for x in met[c:d, 1]])
                cols = [
                    pa.array(np.full(len(rows), batch.column(0)[i].as_py())), pa.array(rows, pa.int32()),
                    *[pa.array(o, pa.list_(pa.int64())) for o in out[:2]], pa.array(out[2], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["segment", "row", "starts", "ends", "items"])

    return arrow_map(index.select("segment", "n_words", "terms", "counts", "places"), run, HITS)


def phrase_hits(index: DataFrame, items: DataFrame, window: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(segment, row, starts, ends, items): exact occurrences of any `window` consecutive words of an item, as stretches of
    word numbers of a document, and the items they belong to; a shorter item is a window as a whole.

    Several rows of a document are possible, one for each block of items.
    """
    return _over_blocks(index, tested_words(items, window, item_id, text), window, find_phrases)


def proximity_hits(index: DataFrame, items: DataFrame, span: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Like `phrase_hits`, for stretches of at most `span` words of a document that hold all different words of an item,
    in any order; of such stretches the shortest ones, those that hold no other. Items have to be shorter than a block."""
    whole = BLOCK_WORDS // 8
    return _over_blocks(index, tested_words(items, whole, item_id, text), whole, partial(find_near, span=span))


def _over_blocks(index: DataFrame, tested: DataFrame, window: int, find) -> DataFrame:
    counts = materialize(term_counts(index, tested), "term-counts")
    hits = None
    for block in _blocks(tested, counts, window):
        part = materialize(_scan_index(index, block, find), "hits")
        hits = part if hits is None else hits.unionByName(part)
    return index.sparkSession.createDataFrame([], HITS) if hits is None else hits


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document, and `spans`, the hit stretches of words."""
    index = build_index(docs, doc_id, text)
    return summary(index, phrase_hits(index, items, window))


def summary(index: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per indexed document with the hits of all blocks put together."""
    split = hits.withColumn("s", F.arrays_zip("starts", "ends")).select("segment", "row", "s", "items")
    joined = split.groupBy("segment", "row").agg(
        F.array_sort(F.flatten(F.collect_list("s"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    # Stretches in order of start: each one counts for what lies beyond the furthest end so far.
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["ends"] - F.greatest(s["starts"], acc["upto"]), F.lit(0))).alias("n"), F.greatest(acc["upto"], s["ends"]).alias("upto")
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    hit = joined.select("segment", "row", F.aggregate("s", zero, step)["n"].alias("n_hit"), "items", F.col("s").alias("spans"))
    n_hit, ids = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return (
        indexed_documents(index)
        .join(hit, ["segment", "row"], "left")
        .select(
            "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
            F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans",
        )
    )
