"""Helpers shared by the operators of this package: Arrow batches, runs of equal keys, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinseek.session import materialize

# Rows of one Arrow batch. Texts may be very long, so batches are kept short; this bounds a Python worker's memory.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lowers (never raises) the session's Arrow batch length, which Spark sets only session-wide."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def arrow_map(df: DataFrame, fn, schema: str | T.StructType) -> DataFrame:
    """`mapInArrow` with short batches; `fn` maps an iterator of record batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def column_last(df: DataFrame, column: str, made: Iterable[str], drop: bool) -> tuple[DataFrame, list[T.StructField]]:
    """(columns of `df` that stay, then `column`; fields of those that stay). Names are positions, so no name can clash.

    Columns called like one of `made` go, whatever their case; `drop` leaves `column` itself out of those that stay.
    """
    at, taken = df.columns.index(column), {m.lower() for m in made}
    kept = [i for i, c in enumerate(df.columns) if c.lower() not in taken and not (drop and i == at)]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}") for i in kept], F.col(f"c{at}").alias("last")), [df.schema.fields[i] for i in kept]


def texts_of(column: pa.Array) -> list[str]:
    """Strings of an Arrow column; null becomes the empty text."""
    return [t or "" for t in column.to_pylist()]


def held_out(doc_id: Column) -> Column:
    """True for the documents kept away from training: crc32 of the id as text, modulo 3, is 1. A null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def whole_runs(batches: Iterable[pa.RecordBatch], key: int | list[int]) -> Iterator[pa.Table]:
    """Tables of whole runs of equal key, from batches whose rows are sorted by that key (column numbers).

    The last run of a table is held back until the next key appears, so memory holds a batch and one run: callers make
    sure that runs are bounded.
    """
    keys = [key] if isinstance(key, int) else key
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, bool)
        for k, col in zip(keys, cols, strict=True):
            change[1:] |= col[1:] != col[:-1]
            if kept:
                change[0] |= kept[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py()
        at = np.flatnonzero(change)
        if len(at):
            cut = int(at[-1])
            head = [*kept, batch.slice(0, cut)] if cut else kept
            if head:
                yield pa.Table.from_batches(head)
            kept = [batch.slice(cut)]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept)


def run_bounds(*cols: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows, and the end."""
    n = len(cols[0])
    change = np.ones(n + 1, bool)
    if n:
        change[1:n] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return np.flatnonzero(change) if n else np.zeros(1, np.int64)


def components(edges: DataFrame, label: str) -> DataFrame:
    """Connected components of undirected edges (a, b), BIGINT: one row (node, root) for every node that is not itself the root.

    Alternating large-star and small-star steps: every step is a grouped minimum (combined before the shuffle) and an
    equi-join, and each round is written to the shared folder. A round keeps the components and ends when nothing
    changes. Self-loops and rows with nulls are ignored.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    pairs = materialize(pairs.distinct(), f"{label}-edges")
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(lowest.withColumnRenamed("m", "b")).distinct()
        pairs = materialize(small, f"{label}-round")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
