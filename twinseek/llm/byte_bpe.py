"""Byte-level BPE encoding and decoding with numpy.

Texts are split by the tokenizer's pattern. Inside a task every distinct piece is encoded once (a bounded cache). Pieces
that are not whole tokens are bucketed by length into padded matrices of byte tokens; in every round each row merges its
leftmost pair of least rank, all rows at once. Ranks of pairs come from an open-addressing hash table; a merge closes the
gap in its row, finished rows leave the matrix, and rows that have become short move on as a narrower matrix.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinseek.llm.common import arrow_map, column_last, texts_of

# Distinct pieces a task remembers; beyond it the cache starts anew.
CACHE_PIECES = 400_000
# Pieces above this many bytes are merged one by one with a heap: a matrix round would move the whole row.
MATRIX_BYTES = 1024
# Pieces handled at once, so that one very long text needs no more memory than many short ones.
STREAM_PIECES = 400_000
_NONE = np.int32(2**31 - 1)


class PairTable:
    """Hash table from a pair of token ids to the rank of their concatenation; linear probing, vectorised."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 3))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, _NONE, np.int32)
        keys = self._key(left, right)
        slot, waiting = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(waiting):
            self.probes += 1
            at = slot[waiting]
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[waiting[free]]  # of several that want one slot, the last gets it
            won = free & (self.keys[at] == keys[waiting])
            self.ranks[at[won]] = rank[waiting[won]]
            waiting = waiting[~won]
            slot[waiting] = (slot[waiting] + 1) & (size - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right.astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, or a number above all ranks. Padding is -1 and is in no pair."""
        keys = self._key(left, right)
        slot = self._slot(keys)
        found = np.where((left >= 0) & (right >= 0) & (self.keys[slot] == keys), self.ranks[slot], _NONE)
        open_ = np.flatnonzero((left >= 0) & (right >= 0) & (self.keys[slot] != keys) & (self.keys[slot] != -1))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & (len(self.keys) - 1)
            here = self.keys[slot]
            hit = here == keys[open_]
            found[open_[hit]] = self.ranks[slot[hit]]
            on = ~hit & (here != -1)
            open_, slot = open_[on], slot[on]
        return found


class ByteBpe:
    """Encoder and decoder for a table of ranks (token bytes -> id) that holds all single bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        splits = [
            (ranks[t[:k]], ranks[t[k:]], i)
            for t, i in ranks.items()
            for k in range(1, len(t))
            if t[:k] in ranks and t[k:] in ranks
        ]
        table = np.array(splits, np.int64).reshape(-1, 3)
        self.pairs = PairTable(table[:, 0], table[:, 1], table[:, 2].astype(np.int32))
        self.pair_rank = {(a, b): r for a, b, r in splits}
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)  # ids of all remembered pieces, one after the other
        self.starts = np.zeros(1 << 16, np.int64)
        self.sizes = np.zeros(1 << 16, np.int64)
        self.used = 0

    def _merge_matrix(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, token matrices padded with -1) of rows that can't be merged further."""
        rows = np.arange(len(ids))
        ranks = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(ids):
            if ids.shape[1] < 2:
                yield rows, ids
                return
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(ids)), at]
            done = best == _NONE
            if done.any():
                yield rows[done], ids[done]
                ids, ranks, rows, at, best = ids[~done], ranks[~done], rows[~done], at[~done], best[~done]
                if not len(ids):
                    return
            n, width = ids.shape
            line = np.arange(n)
            ids[line, at] = best
            keep = np.ones((n, width), bool)
            keep[line, at + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            keep = np.ones((n, width - 1), bool)
            keep[line, at] = False
            ranks = ranks[keep].reshape(n, width - 2)
            # Only the pairs on both sides of the new token have changed.
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.pairs.get(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at < width - 2)
            ranks[right, at[right]] = self.pairs.get(ids[right, at[right]], ids[right, at[right] + 1])
            longest = int((ids >= 0).sum(axis=1).max())
            if longest <= ids.shape[1] // 2:
                ids, ranks = ids[:, :longest], ranks[:, : max(longest - 1, 0)]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same for one long piece: a heap of (rank, place) over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.pair_rank.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := rank((r, ids[k]))) is not None:
                    heapq.heappush(heap, (s, i, r, ids[k]))
            if (h := before[i]) >= 0 and (s := rank((ids[h], r))) is not None:
                heapq.heappush(heap, (s, h, ids[h], r))
        return [x for x in ids if x >= 0]

    def _remember(self, pieces: list[str], ids: list[np.ndarray]) -> None:
        first, total = len(self.slot), sum(map(len, ids))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(pieces) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.sizes[first : first + len(pieces)] = sizes
        self.starts[first : first + len(pieces)] = self.used + np.cumsum(sizes) - sizes
        if total:
            self.flat[self.used : self.used + total] = np.concatenate(ids)
        self.used += total
        self.slot.update(zip(pieces, range(first, first + len(pieces)), strict=True))

    def _learn(self, pieces: list[str]) -> None:
        """Encodes pieces that are not remembered yet."""
        whole: list[np.ndarray] = []
        whole_pieces: list[str] = []
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            token = self.ranks.get(raw)
            if token is not None:
                whole_pieces.append(p)
                whole.append(np.array([token], np.int32))
            elif len(raw) > MATRIX_BYTES:
                whole_pieces.append(p)
                whole.append(np.array(self._merge_long(raw), np.int32))
            else:
                buckets.setdefault((len(raw) + 3) // 4 * 4, []).append((p, raw))
        self._remember(whole_pieces, whole)
        for width, members in buckets.items():
            step = max(1, (1 << 21) // width)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                raws = [raw for _, raw in part]
                sizes = np.fromiter(map(len, raws), np.int64, len(raws))
                ids = np.full((len(raws), width), -1, np.int32)
                ids[np.arange(width) < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(raws), np.uint8)]
                for rows, done in self._merge_matrix(ids):
                    live = done >= 0
                    cuts = np.cumsum(live.sum(axis=1))[:-1]
                    self._remember([part[r][0] for r in rows.tolist()], np.split(done[live], cuts))

    def _stream(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one after the other, and where each piece ends."""
        if len(self.slot) > CACHE_PIECES:
            self._forget()
        new = list(set(pieces).difference(self.slot))
        if new:
            self._learn(new)
        at = np.fromiter(map(self.slot.__getitem__, pieces), np.int64, len(pieces))
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        if not len(at):
            return np.zeros(0, np.int32), ends
        places = np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(int(ends[-1]))
        return self.flat[places], ends

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_many([text]))

    def encode_many(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Token ids of each text, in order."""
        waiting: list[int] = []
        pieces: list[str] = []

        def flush() -> Iterator[np.ndarray]:
            ids, ends = self._stream(pieces)
            ends = np.concatenate(([0], ends))
            stops = np.cumsum(waiting)
            for n, stop in zip(waiting, stops.tolist(), strict=True):
                yield ids[ends[stop - n] : ends[stop]]
            waiting.clear()
            pieces.clear()

        for text in texts:
            if len(text) > 4 * STREAM_PIECES:
                yield from flush()
                found = (m.group() for m in self.pattern.finditer(text))
                parts = []
                while part := list(islice(found, STREAM_PIECES)):
                    parts.append(self._stream(part)[0])
                yield np.concatenate(parts) if parts else np.zeros(0, np.int32)
                continue
            got = self.pattern.findall(text)
            waiting.append(len(got))
            pieces += got
            if len(pieces) > STREAM_PIECES:
                yield from flush()
        yield from flush()

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def _codec(rank_file: bytes, pattern: str) -> ByteBpe:
    lines = (line.split() for line in rank_file.splitlines() if line)
    return ByteBpe({base64.b64decode(token): int(rank) for token, rank in lines}, pattern)


def _through(df: DataFrame, rank_file: str, pattern: str, column: str, outs: list[T.StructField], fn, drop: bool = False) -> DataFrame:
    """Adds columns made by `fn(codec, Arrow column)`; the rank file (under 1 MB) is read on the driver and broadcast."""
    with open(rank_file, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    source, kept = column_last(df, column, [o.name for o in outs], drop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch in batches:
            cols = fn(codec, batch.column(len(kept)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=[o.name for o in [*kept, *outs]])

    return arrow_map(source, run, T.StructType([*kept, *outs]))


def _id_lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
    values = np.concatenate(found) if found else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """`df` with the token ids (ARRAY<INT>) of every whole text; null counts as empty. A column already called `out`, in any case, is replaced."""
    field = T.StructField(out, T.ArrayType(T.IntegerType()))
    return _through(df, rank_file, pattern, text, [field], lambda codec, column: [_id_lists(list(codec.encode_many(texts_of(column))))])


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` with the bytes (BINARY) that the ids stand for; null counts as no ids."""

    def back(codec: ByteBpe, column: pa.Array) -> list[pa.Array]:
        return [pa.array([codec.decode(np.asarray(x or [], np.int32)) for x in column.to_pylist()], pa.binary())]

    return _through(df, rank_file, pattern, ids, [T.StructField(out, T.BinaryType())], back)


def round_trip(df: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: bool = False) -> DataFrame:
    """`df` without its text, with n_tokens, ids_sha256 and decoded_sha256: encoding and decoding in one pass; with `ids`, also the ids.

    ids_sha256 is of the ids as little-endian unsigned 32-bit integers, decoded_sha256 of the bytes decoded from the ids.
    Null counts as empty; one row per row; columns that have one of the new names, in any case, are replaced.
    """
    outs = [T.StructField("n_tokens", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")]]
    if ids:
        outs.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def digest(codec: ByteBpe, column: pa.Array) -> list[pa.Array]:
        sizes, coded, decoded, lists = [], [], [], []
        for found in codec.encode_many(texts_of(column)):
            sizes.append(len(found))
            coded.append(hashlib.sha256(found.astype("<u4").tobytes()).hexdigest())
            decoded.append(hashlib.sha256(codec.decode(found)).hexdigest())
            if ids:
                lists.append(found)
        cols = [pa.array(sizes, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
        return [*cols, _id_lists(lists)] if ids else cols

    return _through(df, rank_file, pattern, text, outs, digest, drop=True)
