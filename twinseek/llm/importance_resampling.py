"""Target-distribution importance resampling on hashed n-grams (prefix-CRC substrings).

A feature is a run of 1 to n words joined by one space, its bucket the CRC-32 of its bytes modulo the number of buckets.
Each document is normalised to its words and scanned once: the running CRC is kept at the word edges. CRC-32 is linear over
GF(2), so the CRC of any substring is the prefix CRC at its end, from which the prefix CRC at its start, shifted by the
length of the substring, is cancelled; n-grams of every length come from the same two arrays and no n-gram text is built.

1. Scan: one row per document with its buckets, written once.
2. Bucket totals of the documents and of the target texts, added up in tasks before they are shuffled.
3. Gains per bucket (a table of fixed size), summed over the features of each document, plus Gumbel noise from a hash of
   the id: the k highest scores are a weighted draw without replacement.

Null and empty texts have no features, weight 0, and are never drawn if `min_words` is positive; a null id counts as ''.
Repeated rows are documents of their own and tie; an empty table of documents or targets gives totals of 0. Only the id
and the text column are read, so that other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinseek.llm.common import arrow_map
from twinseek.llm.words import as_bytes, folded, pick, slices
from twinseek.plans.layout import global_row_number, spread
from twinseek.session import materialize

# Fixed value: the CRC-32 polynomial, bits reversed.
POLYNOMIAL = 0xEDB88320
_ONES = np.uint32(0xFFFFFFFF)
# Bytes of one row of the scan; all rows of a slice advance together.
_STRIDE = 1024
# The gains of all buckets are one array in every task.
MAX_BUCKETS = 1 << 22


def _zero_byte_tables() -> np.ndarray:
    """4 x 256 table: effect of one appended zero byte on each byte of a CRC register."""
    low = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        low = np.where(low & 1, (low >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), low >> np.uint32(1))
    tables = np.zeros((4, 256), np.uint32)
    for i in range(4):
        register = np.arange(256, dtype=np.uint32) << np.uint32(8 * i)
        tables[i] = low[register & np.uint32(255)] ^ (register >> np.uint32(8))
    return tables


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = tables[0][crc & np.uint32(255)]
    for i in range(1, 4):
        out = out ^ tables[i][(crc >> np.uint32(8 * i)) & np.uint32(255)]
    return out


_SHIFTS = [_zero_byte_tables()]
while len(_SHIFTS) < 31:  # the k-th one appends 2^k zero bytes
    _SHIFTS.append(np.stack([_apply(_SHIFTS[-1], t) for t in _SHIFTS[-1]]))


def shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """The registers after `n_bytes` more zero bytes each: multiplication by a power of x in GF(2)[x]."""
    out, left, k = crc.copy(), np.asarray(n_bytes, np.int64), 0
    while len(left) and int(left.max()) >> k:
        odd = np.flatnonzero((left >> k) & 1)
        out[odd] = _apply(_SHIFTS[k], out[odd])
        k += 1
    return out


def running_crc(text: bytes, ends: np.ndarray) -> np.ndarray:
    """Registers (started at 0) after the first `ends` bytes of the text, from one scan of it."""
    size = len(text)
    if not size or not len(ends):
        return np.zeros(len(ends), np.uint32)
    n_rows = -(-size // _STRIDE)
    padded = np.zeros(n_rows * _STRIDE, np.uint8)
    padded[:size] = np.frombuffer(text, np.uint8)
    columns = np.ascontiguousarray(padded.reshape(n_rows, _STRIDE).T)
    states = np.empty((_STRIDE + 1, n_rows), np.uint32)
    states[0] = 0
    table = _SHIFTS[0][0]
    for c in range(_STRIDE):
        s = states[c]
        states[c + 1] = table[(s ^ columns[c]) & np.uint32(255)] ^ (s >> np.uint32(8))
    # What the rows before contribute to the start of each row.
    stride = _SHIFTS[_STRIDE.bit_length() - 1].tolist()
    carry, before = 0, np.empty(n_rows, np.uint32)
    for r, last in enumerate(states[_STRIDE].tolist()):
        before[r] = carry
        carry = last ^ stride[0][carry & 255] ^ stride[1][carry >> 8 & 255] ^ stride[2][carry >> 16 & 255] ^ stride[3][carry >> 24]
    row = np.maximum(ends - 1, 0) // _STRIDE
    place = ends - row * _STRIDE
    return states[place, row] ^ shift(before[row], place)


def feature_buckets(texts: list[bytes | None], n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words per text, features per text, buckets of all features, text by text)."""
    split = [folded(t) for t in texts]
    n_words = np.fromiter((len(w) for w in split), np.int64, len(split))
    scan = b" ".join([b" ".join(w) for w in split if w])
    starts = np.zeros(0, np.int64)
    if scan:
        starts = np.concatenate([[0], np.flatnonzero(np.frombuffer(scan, np.uint8) == 32) + 1])
    ends = np.append(starts[1:] - 1, len(scan))[: len(starts)]
    at_start, at_end = np.split(running_crc(scan, np.concatenate([starts, ends])), 2)
    at_start = at_start ^ _ONES  # the register of a CRC-32 starts with ones
    owner = np.repeat(np.arange(len(split)), n_words)
    found, owners = [], []
    for length in range(1, n + 1):
        first = np.arange(max(0, len(starts) - length + 1))
        first = first[owner[first] == owner[first + length - 1]] if len(first) else first
        last = first + length - 1
        crc = at_end[last] ^ shift(at_start[first], ends[last] - starts[first]) ^ _ONES
        found.append((crc % np.uint32(buckets)).astype(np.uint32))
        owners.append(owner[first])
    found, owners = np.concatenate(found), np.concatenate(owners)
    if n > 1:
        found = found[np.argsort(owners, kind="stable")]
    return n_words, np.bincount(owners, minlength=len(split)), found


@dataclass(frozen=True)
class Features:
    """How texts become features; `n` is the longest run of words."""

    n: int = 1
    buckets: int = 10_000

    def __post_init__(self) -> None:
        if self.n < 1 or not 1 <= self.buckets <= MAX_BUCKETS:
            raise ValueError(f"n is at least 1 and buckets between 1 and {MAX_BUCKETS}: {self}")


def scan(docs: DataFrame, features: Features, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and `codes` (the buckets, repeats included, 32-bit little-endian) of every document."""
    source = pick(docs, doc_id=doc_id, text=text)
    outs = [T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("codes", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for lo, hi in slices(texts):
                n_words, sizes, codes = feature_buckets(texts[lo:hi], features.n, features.buckets)
                packed, edges = codes.astype("<u4").tobytes(), 4 * np.concatenate([[0], np.cumsum(sizes)])
                cols = [pa.array(n_words), pa.array(sizes), pa.array([packed[a:b] for a, b in zip(edges[:-1], edges[1:])], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *cols], names=["doc_id", *[o.name for o in outs]])

    return arrow_map(source, run, T.StructType([source.schema["doc_id"], *outs]))


def bucket_totals(scanned: DataFrame, features: Features, name: str) -> DataFrame:
    """(bucket, `name`): features per bucket; each task adds up before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(features.buckets, np.int64)
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4")
            total += np.bincount(codes, minlength=features.buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return arrow_map(scanned.select("codes"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def bucket_gains(documents: DataFrame, target: DataFrame, features: Features) -> np.ndarray:
    """floor(1000 ln) of how much likelier a bucket is in the target than in the documents, add-one smoothed."""
    both = documents.join(target, "bucket", "full")
    sums = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    s, t = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("s", "t"))
    all_s, all_t = (F.lit(float(x + features.buckets)) for x in sums)

    def gain(s: Column, t: Column) -> Column:
        return F.floor(1000 * F.log((t + 1) * all_s / ((s + 1) * all_t))).cast("long")

    zero = F.lit(0.0)
    rest = documents.sparkSession.range(1).select(gain(zero, zero)).first()[0]
    out = np.full(features.buckets, rest, np.int64)
    for row in both.select("bucket", gain(s, t).alias("gain")).collect():  # at most `buckets` rows
        out[row.bucket] = row.gain
    return out


def weights(scanned: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight, the sum of the gains of a document's features."""
    shared = scanned.sparkSession.sparkContext.broadcast(gains)  # its size is a parameter, at most MAX_BUCKETS
    fields = [scanned.schema[c] for c in ("doc_id", "n_words", "n_features")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(3).to_pylist()
            total = np.concatenate([[0], np.cumsum(shared.value[np.frombuffer(b"".join(codes), "<u4")])])
            edges = np.cumsum([0, *[len(c) // 4 for c in codes]])
            weight = pa.array(total[edges[1:]] - total[edges[:-1]], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], weight], names=[*[f.name for f in fields], "weight"])

    source = scanned.select(*[f.name for f in fields], "codes")
    return arrow_map(source, run, T.StructType([*fields, T.StructField("weight", T.LongType())]))


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(1000 x a Gumbel variate) from the first 32 bits of sha256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(uniform))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, features: Features = Features(), share: tuple[int, int] = (10, 100),
    min_words: int = 20, seed: int = 2024, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (1, 2 ... for drawn documents, else null) of every document.

    Of the documents with at least `min_words` words the part `share` is drawn, rounded down, by highest score; ties go to
    the smaller id.
    """
    scanned = materialize(scan(spread(docs), features, doc_id, text), "resample-scan")
    aim = scan(pick(target, text=target_text).withColumn("doc_id", F.lit(0)), features)
    totals = materialize(bucket_totals(scanned, features, "s"), "resample-totals")
    gains = bucket_gains(totals, materialize(bucket_totals(aim, features, "t"), "resample-target"), features)
    scored = weights(scanned, gains).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = materialize(scored, "resample-scored")
    eligible = F.col("n_words") >= min_words
    drawn = scored.filter(eligible).count() * share[0] // share[1]
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("n_words"), F.asc("weight")]
    ranked = global_row_number(scored.filter(eligible), order, "rank")
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank")
    names = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*names, rank).unionByName(scored.filter(~eligible).select(*names, F.lit(None).cast("long").alias("rank")))


def drawn_documents(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of `docs`, all columns unchanged; rows that share an id go by the best rank of them."""
    ranks = resample(docs, target, doc_id=doc_id, **options).filter("rank IS NOT NULL")
    keys = ranks.select(F.col("doc_id").alias("key")).distinct()
    return docs.join(keys, docs[doc_id].eqNullSafe(F.col("key")), "left_semi")
