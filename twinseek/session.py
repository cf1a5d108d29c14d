"""Session set-up and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Rows that a Python worker gets at once.
BATCH_ROWS = "500"


def build_session(app_name: str = "twinseek", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on; `conf` entries override the defaults.

    Shuffle partition counts are left to the cluster (adaptive execution merges and splits them);
    pass ``shuffle_partitions`` for local runs.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    shuffle_partitions = conf.pop("shuffle_partitions", None)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    Where it is absent, a session on one machine gets a temporary folder, remembered in the session so that all later
    tables land in it. On a cluster every executor would write to a disk of its own, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("twinseek.scratch.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder all executors share; the master is {master!r}")
        root = "file://" + tempfile.mkdtemp(prefix="twinseek-")
        spark.conf.set("twinseek.scratch.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return os.path.join(scratch_root(spark), f"{label}-{uuid.uuid4().hex}")


@contextmanager
def released(spark: SparkSession, batch_rows: str = BATCH_ROWS) -> Iterator[None]:
    """Shuffle files of a query that is run inside go when it ends; by default they stay until the driver collects garbage.

    Python workers get few rows at a time: a row may hold the tokens of a long text.
    """
    held = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": batch_rows}
    before = {name: spark.conf.get(name) for name in held}
    for name, value in held.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def write_table(df: DataFrame, path: str, batch_rows: str = BATCH_ROWS) -> DataFrame:
    """Writes `df` as a new table at `path` and reads it back; shuffle files go with the job."""
    spark = df.sparkSession
    with released(spark, batch_rows):
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_table(spark: SparkSession, path: str) -> None:
    """Deletes a table of `write_table` that nothing reads any more."""
    table = spark._jvm.org.apache.hadoop.fs.Path(path)
    table.getFileSystem(spark._jsc.hadoopConfiguration()).delete(table, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once as a table in the shared folder and read it back.

    Later stages then start from files that survive lost executors, read only the columns they need, and
    give the optimizer real sizes.
    """
    return write_table(df, scratch_path(df.sparkSession, label))
