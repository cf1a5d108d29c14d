from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinseek.sources.files import document_units, table_units

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return document_units(table(spark, sf, "documents"))


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """Short texts: one unit per part."""
    part = table(spark, sf, "part")
    name = F.concat(F.lit("p"), "p_partkey")
    path = F.concat_ws("/", "p_type", F.regexp_replace("p_brand", "#", ""), F.concat(name, F.lit(".txt")))
    return table_units(part, F.col("p_partkey"), path, name, F.concat_ws(" ", "p_name", "p_brand", "p_type"))


def benchmark(spark: SparkSession, sf: str) -> DataFrame:
    bench = table(spark, sf, "benchmark")
    name = F.concat(F.lit("b"), "item_id")
    return table_units(bench, F.col("item_id"), F.concat(F.lit("bench/"), name, F.lit(".txt")), name, F.col("text"))


# SQL twins of the inputs and of the token pattern (RE2 needs the Unicode classes spelled out).
TOKENS = r"[A-Za-z_][\p{L}\p{N}_]*|\p{Nd}+|==|!=|<=|>=|[\(\)\[\]\{\}\.,:;\+\-\*/%<>]"
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
DOCUMENTS_SQL = """docs AS (SELECT doc_id AS unit_id, source || '/' || lang || '/d' || doc_id || '.txt' AS file_path,
  'd' || doc_id AS name, 1 AS line_start, len(string_split(text, chr(10))) AS line_end, text AS body FROM documents)"""
PARTS_SQL = """parts AS (SELECT p_partkey AS unit_id,
  p_type || '/' || replace(p_brand, '#', '') || '/p' || p_partkey || '.txt' AS file_path, 'p' || p_partkey AS name,
  1 AS line_start, 1 AS line_end, p_name || ' ' || p_brand || ' ' || p_type AS body FROM part)"""
BENCHMARK_SQL = """bench AS (SELECT item_id AS unit_id, 'bench/b' || item_id || '.txt' AS file_path, 'b' || item_id AS name,
  1 AS line_start, len(string_split(text, chr(10))) AS line_end, text AS body FROM benchmark)"""
