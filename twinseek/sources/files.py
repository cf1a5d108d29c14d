"""Readers: source files, text tables and lists of changed paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _read_files(spark: SparkSession, root: str, suffix: str, recursive: bool) -> DataFrame:
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", f"*{suffix}")
        .load(root)
    )
    # Paths are made relative to the root, for the corpus and for changed files alike.
    clean_root = root.removeprefix("file://").rstrip("/") + "/"
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9+.-]+:(//[^/]*)?(?=/)", ""), "^/+", "/")
    start = F.instr(relative, clean_root if clean_root.startswith("/") else "/" + clean_root)
    text = F.col("content").cast("string")
    return (
        raw.filter(F.expr("is_valid_utf8(cast(content AS string))"))
        .select(
            F.substring(relative, start + F.lit(len(clean_root) + (0 if clean_root.startswith("/") else 1)),
                        F.length(relative)).alias("file_path"),
            F.regexp_replace(text, "\r\n?", "\n").alias("content"),
        )
    )


def scan_files(spark: SparkSession, root: str, suffix: str = ".py") -> DataFrame:
    """(file_path, content) of all files below `root`, one row each; a file that is not UTF-8 gives no row."""
    return _read_files(spark, root, suffix, recursive=True)


def scan_folder(spark: SparkSession, root: str, suffix: str = ".py") -> DataFrame:
    """Same for the files directly in `root`."""
    return _read_files(spark, root, suffix, recursive=False)


def changed_set(lists: DataFrame, files: DataFrame, column: str = "value", suffix: str = ".py") -> DataFrame:
    """Changed paths from newline-separated text: trimmed, blanks dropped, suffix kept, missing files dropped."""
    paths = (
        lists.select(F.explode(F.split(F.col(column), "\n")).alias("file_path"))
        .select(F.regexp_replace("file_path", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "").alias("file_path"))
        .filter((F.col("file_path") != "") & F.col("file_path").endswith(suffix))
        .distinct()
    )
    return paths.join(files.select("file_path"), "file_path", "left_semi")


def changed_cap(paths: DataFrame, cap: int | None = None) -> DataFrame:
    """First `cap` changed paths in path order. Off unless asked for."""
    return paths if cap is None else paths.orderBy("file_path").limit(cap)


def table_units(
    table: DataFrame, unit_id: Column, file_path: Column, name: Column, body: Column, signature: Column | None = None
) -> DataFrame:
    """Units from any text table; a unit covers lines 1 to the number of lines of its body."""
    return table.select(
        unit_id.cast("bigint").alias("unit_id"),
        name.alias("name"),
        file_path.alias("file_path"),
        F.lit(1).alias("line_start"),
        F.size(F.split(body, "\n", -1)).alias("line_end"),
        (F.lit(None).cast("string") if signature is None else signature).alias("signature"),
        body.alias("body"),
    )


def document_units(documents: DataFrame) -> DataFrame:
    """Units of a `documents(doc_id, text, lang, source)` table."""
    name = F.concat(F.lit("d"), F.col("doc_id"))
    path = F.concat_ws("/", "source", "lang", F.concat(name, F.lit(".txt")))
    return table_units(documents, F.col("doc_id"), path, name, F.col("text"))
