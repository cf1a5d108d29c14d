"""Exact duplicates by a content sort.

Rows are range-partitioned by sampled splitters and sorted inside each partition by Spark's external sort, which puts
equal texts next to each other; each text is then compared in full with its neighbour. The order is (first characters,
64-bit hash, whole text, id). Splitters are cut from the first characters, the hash and the id, never from whole texts,
so what the driver samples is small however long texts are; and because the id is part of them, a text that fills a
third of the table is spread over as many partitions as any other rows. Runs that touch the edge of a partition are
put together by comparing their whole texts: two or so per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinseek.llm.common import arrow_map
from twinseek.session import materialize

PREFIX = 16
_RUNS = 1 << 33  # runs of one partition; its number fills the higher bits


def _sorted_runs(rows: DataFrame, largest: bool, heads_only: bool) -> DataFrame:
    """`rows` (payload, id, text) with the number of the run of equal texts a row is in, and `head` for its first row.

    Rows with `edge` are extra: one for each run whose sort key is the first or the last of its partition, with its text.
    """
    from pyspark import TaskContext

    id_order = F.col("id").desc_nulls_last() if largest else F.col("id").asc_nulls_last()
    keyed = rows.select("*", F.substring("text", 1, PREFIX).alias("start"), F.xxhash64("text").alias("hash"))
    ranged = keyed.repartitionByRange("start", "hash", id_order).sortWithinPartitions("start", "hash", "text", id_order)
    names = keyed.columns
    at_text, at_start, at_hash = (names.index(c) for c in ("text", "start", "hash"))
    payload = [c for c in names if c not in ("text", "start", "hash")]
    schema = T.StructType([*[keyed.schema[c] for c in payload]]).add("run", "long").add("head", "boolean").add("edge", "boolean").add("text", "string")
    for field in schema.fields:
        field.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() * _RUNS - 1
        before = None  # (start, hash, text) of the row before
        open_key: list[tuple[int, pa.RecordBatch]] = []  # heads of the runs that have the present sort key
        first_key = True

        def edges(heads: list[tuple[int, pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
            for n, row in heads:
                yield out(row, np.array([n]), np.array([True]), True)

        def out(batch: pa.RecordBatch, runs: np.ndarray, heads: np.ndarray, edge: bool) -> pa.RecordBatch:
            n = batch.num_rows
            text = batch.column(at_text).cast(pa.string()) if edge else pa.nulls(n, pa.string())
            cols = [batch.column(names.index(c)) for c in payload]
            return pa.RecordBatch.from_arrays(
                [*cols, pa.array(runs, pa.int64()), pa.array(heads), pa.array(np.full(n, edge)), text], names=schema.names
            )

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            text, start, hashes = batch.column(at_text), batch.column(at_start), batch.column(at_hash)
            now = (start[0].as_py(), hashes[0].as_py(), text[0].as_py())
            new = np.ones(n, bool)
            new_key = np.ones(n, bool)
            new[0] = before is None or now[2] != before[2]
            new_key[0] = before is None or now[:2] != before[:2]
            if n > 1:
                new[1:] = pc.not_equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                new_key[1:] = pc.or_(
                    pc.not_equal(hashes.slice(1), hashes.slice(0, n - 1)), pc.not_equal(start.slice(1), start.slice(0, n - 1))
                ).to_numpy(zero_copy_only=False)
            runs = number + np.cumsum(new)
            number = int(runs[-1])
            at_keys = np.flatnonzero(new_key)
            if first_key and len(at_keys) > (before is None):  # the first key ends inside this batch
                end = int(at_keys[1 if before is None else 0])
                open_key += [(int(runs[i]), batch.slice(i, 1)) for i in np.flatnonzero(new[:end])]
                yield from edges(open_key)
                first_key, open_key = False, []
                since = int(at_keys[-1])
            elif len(at_keys):
                open_key, since = [], int(at_keys[-1])
            else:
                since = 0
            open_key += [(int(runs[i]), batch.slice(i, 1)) for i in since + np.flatnonzero(new[since:])]
            before = (start[n - 1].as_py(), hashes[n - 1].as_py(), text[n - 1].as_py())
            if heads_only:
                mask = pa.array(new)
                yield out(batch.filter(mask), runs[new], np.ones(int(new.sum()), bool), False)
            else:
                yield out(batch, runs, new, False)
        yield from edges(open_key)

    return arrow_map(ranged, run, schema)


def _rank(largest: bool) -> Column:
    """Greatest for the row to keep."""
    known = F.col("id").isNotNull().alias("known")
    return F.struct(known, (F.col("id") if largest else -F.col("id")).alias("id"), (-F.col("run")).alias("run"))


def normalized(text: Column) -> Column:
    """The text compared: unchanged, null as empty."""
    return F.coalesce(text, F.lit(""))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "min", normalize=normalized) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if `normalize` makes them identical; the row with the smallest (or largest) id stays, exactly one row
    of each group even if ids repeat; null ids stay only in groups of null ids. Ids are integers. Other columns of `docs`
    are ignored.
    """
    largest = {"min": False, "max": True}[keep]
    whole = normalize(F.col(f"`{text}`"))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.sha2(whole, 256).alias("sha"), whole.alias("text"))
    rows = materialize(_sorted_runs(rows, largest, False), "exact-runs")
    stored = rows.filter("NOT edge")
    groups = stored.groupBy("run").agg(F.max(_rank(largest)).alias("best"), F.count("*").alias("n"))
    joint = rows.filter("edge").groupBy("text").agg(F.min("run").alias("group"), F.collect_set("run").alias("runs"))
    joint = joint.filter(F.size("runs") > 1).select("group", F.explode("runs").alias("run"))  # one row per partition a text crosses
    split = groups.join(joint, "run")
    merged = split.groupBy("group").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    merged = joint.join(merged, "group").select("run", "best", "n")
    groups = groups.join(joint, "run", "left_anti").unionByName(merged)
    keep_id = F.col("best.id") if largest else -F.col("best.id")
    return stored.join(groups, "run").select(
        F.col("id").alias("doc_id"),
        keep_id.alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("head") & (F.col("run") == -F.col("best.run"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "min", normalize=normalized) -> DataFrame:
    """The rows of `docs`, all columns, with one row of each group of equal texts."""
    largest = {"min": False, "max": True}[keep]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(f"`{doc_id}`").cast("long").alias("id"), normalize(F.col(f"`{text}`")).alias("text"))
    heads = materialize(_sorted_runs(rows, largest, True), "exact-heads")
    edge = heads.filter("edge").withColumn("rank", _rank(largest))
    best = edge.groupBy("text").agg(F.max("rank").alias("best"))
    lost = edge.join(best, "text").filter(F.col("run") != -F.col("best.run")).select("run")  # the other parts of a split text
    return heads.filter("NOT edge").join(lost, "run", "left_anti").select("row.*")
