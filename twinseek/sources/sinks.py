"""Reading and writing pair tables, match reports and metric tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinseek.operators.report import match_summary, top_matches
from twinseek.schema import PAIR_SCHEMA, match_record
from twinseek.session import released

# Matches that a pass of a report joins with their texts.
PASS_MATCHES = 150_000
REQUIRED_PAIR_COLUMNS = ("func1", "func2", "clone")


def load_pairs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Labelled pairs from JSON array files (or JSON lines with ``multi_line=False``).

    A JSON array can only be read as a whole: one file is one task and has to fit its memory, so keep array files under
    about 100 MB and give many of them. JSON lines are split like any text.
    """
    pairs = spark.read.option("multiLine", multi_line).json(path)
    missing = [c for c in REQUIRED_PAIR_COLUMNS if c not in pairs.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return pairs


def read_pairs(spark: SparkSession, path: str, file_format: str = "json") -> DataFrame:
    """Pairs written by `write_pairs`."""
    reader = spark.read.schema(PAIR_SCHEMA)
    if file_format == "json":
        return reader.json(path)
    if file_format == "parquet":
        return reader.parquet(path)
    return reader.csv(path, header=True, multiLine=True, quote='"', escape='"', nullValue="\\N", emptyValue="")


def write_pairs(pairs: DataFrame, path: str, file_format: str = "json", mode: str = "errorifexists") -> None:
    """Pairs as JSON lines, Parquet, or CSV; any other format name also means CSV."""
    writer = pairs.select(*PAIR_SCHEMA.fieldNames()).write.mode(mode)
    if file_format.lower() == "json":
        writer.option("ignoreNullFields", False).json(path)
    elif file_format.lower() == "parquet":
        writer.parquet(path)
    else:
        writer.csv(path, header=True, quote='"', escape='"', nullValue="\\N", emptyValue="", lineSep="\n",
                   ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_pair_arrays(pairs: DataFrame, path: str, keys: list[str], files: int, mode: str = "errorifexists") -> None:
    """Pairs in about `files` files that each hold one JSON array, dealt by a hash of `keys`, which tell pairs apart.

    A group of pairs, however large, is spread over all files; a file has its share of the pairs.
    """
    dealt = pairs.withColumn("_file", F.pmod(F.xxhash64(*keys), F.lit(files)))
    rows = F.array_join(F.collect_list(F.to_json(F.struct("func1", "func2", "clone", "source_module1"))), ",")
    arrays = dealt.groupBy("_file").agg(F.concat(F.lit("["), rows, F.lit("]")).alias("value"))
    arrays.select("value").write.mode(mode).option("maxRecordsPerFile", 1).text(path)


def report_document(matches: DataFrame, top: int) -> DataFrame:
    """One row with one JSON document: summary, statistics, the best `top` matches and how many are left out.

    A single document is a single row: `top` bounds it. The whole report is what `write_report` writes.
    """
    best = match_record(top_matches(matches, top)).agg(F.collect_list(F.struct("*")).alias("matches"))
    summary = match_summary(matches).select(
        F.struct("total_matches", "high_confidence_matches", F.lit(True).alias("analysis_complete")).alias("summary"),
        F.struct("confidence_distribution", "avg_similarity_score").alias("statistics"),
        F.greatest(F.lit(0), F.col("total_matches") - top).alias("matches_left_out"),
    )
    one = F.lit(1).alias("_one")
    both = summary.select("*", one).join(best.select("*", one), "_one")
    return both.select(F.to_json(F.struct("summary", "matches", "matches_left_out", "statistics")).alias("document"))


def write_report(matches: DataFrame, path: str, top: int | None = None, mode: str = "errorifexists") -> None:
    """The whole report: all matches as JSON lines (gzip) and a one-row summary; with `top`, also one document of the best ones.

    Signature and body of both sides are written if `matches` has them. Matches are written in passes by the hash of their new
    side, so that the texts under way need bounded disk; only the report itself holds them. Every pass and the summary read
    `matches` again, which should be a stored table, or one joined with texts (`with_texts`).
    """
    spark, key = matches.sparkSession, "new_id" if "new_id" in matches.columns else "new_path"
    passes = 1 if mode == "ignore" else max(1, math.ceil(matches.count() / PASS_MATCHES))
    for i in range(passes):
        part = matches if passes == 1 else matches.filter(F.pmod(F.xxhash64(key), F.lit(passes)) == i)
        with released(spark):
            match_record(part).write.mode("append" if i else mode).option("compression", "gzip").json(f"{path}/matches")
    match_summary(matches).write.mode(mode).json(f"{path}/summary")
    if top is not None:
        report_document(matches, top).write.mode(mode).text(f"{path}/document")


def write_metrics(metrics: DataFrame, path: str, mode: str = "errorifexists") -> None:
    metrics.write.mode(mode).csv(path, header=True)
