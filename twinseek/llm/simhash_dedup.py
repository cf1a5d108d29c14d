"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. If two fingerprints differ in at most three bits, one of
their segments differs in at most one, so the two share either that whole segment or the segment with one bit wiped out
(a wildcard at that place). Every distinct fingerprint is indexed under its 2 whole segments and its 64 one-wildcard
variants; equal signatures meet by a shuffle on the signature and are verified by counting differing bits.

Only distinct fingerprints are indexed, so copies cost nothing. Inside a bucket no pair is emitted that joins what is
already joined: a bucket of n fingerprints gives fewer than n links. A bucket above `BUCKET_ROWS` is cut again by the
same rule on its other segment; 46 bits are then shared (but for wildcards), so no bucket exceeds 2**18 fingerprints
whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinseek.llm.common import arrow_map, components, run_bounds, whole_runs
from twinseek.session import materialize

WORDS = 3
SEED = 42
MAX_BITS = 3
BUCKET_ROWS = 4096
_WHOLE = 32  # the "place" of a signature without a wildcard


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of the word shingles of `text`, A-Z lower-cased; 0 if there is no word."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) < words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        block = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8").astype(np.int64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """`docs` with one more BIGINT column; all other columns pass through untouched, except one already called `out`."""
    kept = [c for c in docs.columns if c != out]
    position = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t) for t in batch.column(position).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*kept, out])

    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*source.schema.fields]).add(out, "long")
    return arrow_map(source, run, schema)


def _close(a: np.ndarray | np.uint64, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= MAX_BITS


def bucket_links(values: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that join all values of a bucket that differ by at most three bits, directly or through others: a forest."""
    left: list[int] = []
    right: list[int] = []
    rest = values
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = _close(x, rest)
            if near.any():
                found = rest[near]
                rest = rest[~near]
                left += [int(x)] * len(found)
                right += found.tolist()
                frontier += list(found)
    return left, right


def signatures(values: DataFrame) -> DataFrame:
    """(key, fp): 66 signatures of every distinct fingerprint; the key packs segment number, wildcard place and segment."""
    fp = F.col("fp")
    low = fp.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(fp, 32)

    def keys(segment: Column, number: int) -> list[Column]:
        whole = segment.bitwiseOR(F.lit((number * 64 + _WHOLE) << 32))
        wiped = [segment.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << i))).bitwiseOR(F.lit((number * 64 + i) << 32)) for i in range(32)]
        return [whole, *wiped]

    return values.select(F.explode(F.array(*keys(low, 0), *keys(high, 1))).alias("key"), "fp")


def _sub_signatures(hot: DataFrame) -> DataFrame:
    """(key, sub, fp): the rows of a large bucket once more under the halves of their other segment, whole and with one bit wiped."""
    fp = F.col("fp")
    number = F.shiftrightunsigned(F.col("key"), 38)
    other = F.when(number == 0, F.shiftrightunsigned(fp, 32)).otherwise(fp.bitwiseAND(F.lit(0xFFFFFFFF)))
    halves = [other.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(other, 16)]
    subs = [
        half.bitwiseAND(F.lit(0xFFFF ^ (0 if i == 16 else 1 << i))).bitwiseOR(F.lit((h * 32 + i) << 16))
        for h, half in enumerate(halves)
        for i in range(17)
    ]
    return hot.select("key", F.explode(F.array(*subs)).alias("sub"), "fp")


def _emit(hot: bool, a: np.ndarray | list[int], b: np.ndarray | list[int]) -> pa.RecordBatch:
    a, b = (np.asarray(x, np.uint64).view(np.int64) for x in (a, b))
    flags = pa.array(np.full(len(a), hot))
    return pa.RecordBatch.from_arrays([flags, pa.array(a), pa.array(b)], names=["hot", "a", "b"])


def _links_of(keys: list[np.ndarray], fps: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links of whole runs."""
    at = run_bounds(*keys)
    sizes = np.diff(at)
    two = at[:-1][sizes == 2]
    if len(two):
        near = _close(fps[two], fps[two + 1])
        yield _emit(False, fps[two][near], fps[two + 1][near])
    for start, size in zip(at[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        a, b = bucket_links(fps[start : start + size])
        if a:
            yield _emit(False, a, b)


def links(values: DataFrame, label: str = "simhash", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) joining, directly or through others, all fingerprints of column `fp` (distinct) that differ by at most three bits."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        hot_key = None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                yield from _links_of([keys], fps)

        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if hot_key is not None and len(keys):
                same = int(np.searchsorted(keys, hot_key, side="right"))
                yield _emit(True, keys[:same], fps[:same])
                keys, fps = keys[same:], fps[same:]
            if not len(keys):
                continue
            hot_key = None
            held.append((keys, fps))
            keys, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            last = int(run_bounds(keys)[-2])  # the last run may go on in the next batch
            if last:
                yield from _links_of([keys[:last]], fps[:last])
            held[:] = [(keys[last:], fps[last:])]
            if len(keys) - last > bucket_rows:
                hot_key = keys[-1]
                yield _emit(True, keys[last:], fps[last:])
                held.clear()
        yield from close()

    def meet_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, [0, 1]):
            cols = [table.column(i).to_numpy() for i in range(3)]
            yield from _links_of(cols[:2], cols[2].view(np.uint64))

    schema = "hot boolean, a long, b long"
    dealt = signatures(values).repartition("key").sortWithinPartitions("key", "fp")
    first = materialize(arrow_map(dealt, meet, schema), f"{label}-met")
    large = first.filter("hot").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    again = _sub_signatures(large).repartition("key", "sub").sortWithinPartitions("key", "sub", "fp")
    return first.filter("NOT hot").unionByName(arrow_map(again, meet_again, schema)).select("a", "b")


def group_fingerprints(prints: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(fp, root) for every distinct value of column `fp`: the smallest fingerprint (as a signed number) it is linked with."""
    values = materialize(prints.select("fp").distinct(), "simhash-values")
    roots = components(links(values, bucket_rows=bucket_rows), "simhash")
    return values.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable by links).

    Null and blank texts have the fingerprint zero and are linked like any other. Repeated rows give repeated rows. A null
    doc_id is never a component_id unless all ids of the component are null. Other columns of `docs` are ignored.
    """
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    prints = materialize(with_fingerprint(source, out="fp").select("doc_id", "fp"), "simhash-prints")
    lowest = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    grouped = group_fingerprints(prints, bucket_rows).join(lowest, "fp")
    ids = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    by_print = materialize(grouped.join(ids, "root").select("fp", "component_id"), "simhash-groups")
    return prints.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, with one document of each group of near-duplicates: the smallest doc_id.

    Rows that tie on doc_id are ordered by the sha256 of their text; of rows that tie on both, one stays. Null ids come last.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("row"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    prints = with_fingerprint(packed.select("text", rank.alias("rank")), out="fp").select("rank", "fp")
    prints = materialize(prints, "simhash-prints")
    grouped = group_fingerprints(prints)
    first = prints.join(grouped, "fp").groupBy("root").agg(F.min("rank").alias("rank"))
    first = materialize(first.select("rank.*"), "simhash-kept")
    kept = packed.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    same = (kept["sha"] == first["sha"]) & kept["id"].eqNullSafe(first["id"])
    kept = kept.join(first, same, "left_semi")
    return kept.dropDuplicates(["id", "sha"]).select("row.*")
