from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinseek.catalog.registry import query, table
from twinseek.operators.filters import pair_quality
from twinseek.operators.pairs import (
    PairIndex, balance_stats, balanced_sample, cross_group_pairs, index_units, pair_stats, same_group_pairs,
    sample_modules, sample_one_per_module,
)
from twinseek.session import scratch_path
from twinseek.sources.sinks import load_pairs, read_pairs, write_pair_arrays, write_pairs


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation is a module, its turns are the units."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("module"), F.col("turn").alias("unit_key"), F.col("role").alias("name"), F.col("text").alias("body")
    )


def turn_index(spark: SparkSession, sf: str) -> PairIndex:
    return index_units(turns(spark, sf), seed=42)


def index_sql(units: str, counts: str = "counts") -> str:
    """CTEs that number the units of a CTE (module, unit_key, body) as `index_units` does."""
    run = "OVER (ORDER BY md5(module::VARCHAR), module ROWS UNBOUNDED PRECEDING)"
    return f"""m0 AS (SELECT module, count(*)::HUGEINT AS n FROM {units} GROUP BY 1),
    m1 AS (SELECT *, sum(n) {run} - n AS start, n * (n - 1) // 2 AS same FROM m0),
    m2 AS (SELECT *, sum(n * start) {run} - n * start AS cross_from, sum(same) {run} - same AS same_from FROM m1),
    numbered AS (SELECT u.*, m2.start + row_number() OVER (PARTITION BY u.module ORDER BY md5('42:' || unit_key), unit_key) - 1 AS number
      FROM {units} u JOIN m2 USING (module)),
    {counts} AS (SELECT sum(same) AS t, sum(n * start) AS f, sum(n) AS u FROM m2)"""


def draw_sql(k: str, size: str, counts: str = "counts") -> str:
    """CTE `drawn(point)`: k numbers of [0, size) as `draw` picks them, for the cross-module pairs."""
    edge = lambda i: f"({i} * (size // k) + ({i} * (size % k)) // k)"
    low, high = edge("i"), edge("(i + 1)")
    return f"""wanted AS (SELECT {k}::HUGEINT AS k, {size}::HUGEINT AS size FROM {counts}),
    steps AS (SELECT k, size, unnest(range(0, k::BIGINT))::HUGEINT AS i FROM wanted),
    drawn AS (SELECT CASE WHEN k = size THEN i ELSE
      {low} + ('0x' || substr(md5('42:cross:' || i), 1, 15))::HUGEINT % ({high} - {low}) END AS point FROM steps)"""


PAIR_FIELDS = "x.module AS source_module1, x.unit_key AS unit_key1, y.module AS source_module2, y.unit_key AS unit_key2"
SAME_SQL = f"SELECT {PAIR_FIELDS}, TRUE AS clone FROM {{u}} x JOIN {{u}} y ON x.module = y.module AND x.unit_key < y.unit_key"
DRAWN_CROSS_SQL = """places AS (SELECT start + (point - cross_from) // start AS a, (point - cross_from) % start AS b FROM drawn JOIN m2
    ON point >= cross_from AND point < cross_from + n * start),
  drawn_pairs AS (SELECT CASE WHEN p.module <= q.module THEN p ELSE q END AS x, CASE WHEN p.module <= q.module THEN q ELSE p END AS y
    FROM places JOIN numbered p ON p.number = a JOIN numbered q ON q.number = b)"""
TURNS_SQL = "turns AS (SELECT conv_id AS module, turn AS unit_key, role AS name, text AS body FROM conversations)"
# Pairs, and bytes of text, that a file of one JSON array has on average at most.
ARRAY_PAIRS = 2000
ARRAY_BYTES = 8_000_000
KEYS = ["source_module1", "unit_key1", "source_module2", "unit_key2", "clone"]
SAME_TURNS_SQL = f"WITH {TURNS_SQL} " + SAME_SQL.format(u="turns")


@query("same_group_pairs", SAME_TURNS_SQL)
def q_same_group_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return same_group_pairs(turn_index(spark, sf)).select(*KEYS)


@query(
    "cross_group_pairs",
    f"""WITH {TURNS_SQL}, {index_sql('turns')}, {draw_sql('least(8 * u, f)', 'f')}, {DRAWN_CROSS_SQL}
      SELECT x.module AS source_module1, x.unit_key AS unit_key1, y.module AS source_module2, y.unit_key AS unit_key2, FALSE AS clone FROM drawn_pairs""",
)
def q_cross_group_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Eight drawn pairs per turn; the whole pool has quadratically many."""
    return cross_group_pairs(turn_index(spark, sf), 8 * turns(spark, sf).count()).select(*KEYS)


# Clones are the smaller class here: all are taken, and as many non-clones for a share of 0.5.
SAMPLED_CROSS = "least(t, f)"
BALANCED_SQL = f"""WITH {TURNS_SQL}, {index_sql('turns')}, {draw_sql(SAMPLED_CROSS, 'f')}, {DRAWN_CROSS_SQL},
  sampled AS ({SAME_SQL.format(u='turns')} UNION ALL
    SELECT x.module, x.unit_key, y.module, y.unit_key, FALSE FROM drawn_pairs)"""


@query("balanced_sample", f"{BALANCED_SQL} SELECT * FROM sampled")
def q_balanced_sample(spark: SparkSession, sf: str) -> DataFrame:
    return balanced_sample(turn_index(spark, sf), 0.5, 42).select(*KEYS)


@query(
    "balance_stats",
    f"""{BALANCED_SQL} SELECT clone, CASE WHEN clone THEN (SELECT t FROM counts) ELSE (SELECT f FROM counts) END::BIGINT AS available,
      count(*) AS selected, count(*)::DOUBLE / (SELECT count(*) FROM sampled) AS share FROM sampled GROUP BY clone""",
)
def q_balance_stats(spark: SparkSession, sf: str) -> DataFrame:
    index = turn_index(spark, sf)
    return balance_stats(balanced_sample(index, 0.5, 42), index)


_TEXT_PAIRS = f"""WITH {TURNS_SQL}, p AS (SELECT x.body AS func1, y.body AS func2, x.name AS func1_name, y.name AS func2_name, x.module AS source_module1,
  y.module AS source_module2, TRUE AS clone FROM turns x JOIN turns y ON x.module = y.module AND x.unit_key < y.unit_key)"""


@query(
    "pair_stats",
    f"""{_TEXT_PAIRS} SELECT count(*) AS total_pairs, count_if(clone)::BIGINT AS true_clones, count_if(NOT clone)::BIGINT AS false_clones,
      avg(clone::INT) AS clone_ratio, round(avg(length(func1)), 6) AS avg_func1_length, round(avg(length(func2)), 6) AS avg_func2_length,
      min(least(length(func1), length(func2))) AS min_func_length, max(greatest(length(func1), length(func2))) AS max_func_length FROM p""",
)
def q_pair_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = pair_stats(same_group_pairs(turn_index(spark, sf)))
    return stats.withColumn("avg_func1_length", F.round("avg_func1_length", 6)).withColumn(
        "avg_func2_length", F.round("avg_func2_length", 6)
    )


@query(
    "pair_quality",
    f"""{_TEXT_PAIRS}, both_labels AS (SELECT func1, func2, clone FROM p UNION ALL SELECT func2, func1, FALSE FROM p
      UNION ALL SELECT func1, func2, FALSE FROM p WHERE length(func1) % 3 = 0)
    SELECT md5(func1) AS a, md5(func2) AS b, min(clone) AS clone FROM both_labels WHERE least(length(func1), length(func2)) >= 100
      AND greatest(length(func1), length(func2)) <= 1000 GROUP BY func1, func2 HAVING min(clone) = max(clone)""",
)
def q_pair_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Clones, the same texts the other way round as non-clones, and some clones labelled both ways, which have to go."""
    clones = same_group_pairs(turn_index(spark, sf)).select("func1", "func2", "clone")
    swapped = clones.select(F.col("func2").alias("func1"), F.col("func1").alias("func2"), F.lit(False).alias("clone"))
    doubtful = clones.filter(F.length("func1") % 3 == 0).withColumn("clone", F.lit(False))
    kept = pair_quality(clones.unionByName(swapped).unionByName(doubtful), 100, 1000, exclude_trivial=False)
    return kept.select(F.md5("func1").alias("a"), F.md5("func2").alias("b"), "clone")


def _round_trip(file_format: str):  # noqa: ANN202
    def run(spark: SparkSession, sf: str) -> DataFrame:
        path = scratch_path(spark, "pairs")
        index = index_units(turns(spark, sf).withColumn("module", F.col("module").cast("string")), seed=42)
        write_pairs(same_group_pairs(index), path, file_format)
        back = read_pairs(spark, path, file_format)
        return back.select("source_module1", "func1_name", "func2_name", F.md5("func1").alias("a"), F.md5("func2").alias("b"), "clone")

    return run


_ROUND_TRIP_SQL = f"{_TEXT_PAIRS} SELECT source_module1::VARCHAR AS source_module1, func1_name, func2_name, md5(func1) AS a, md5(func2) AS b, clone FROM p"
for _name, _format in (("write_pairs", "json"), ("write_pairs_parquet", "parquet"), ("write_pairs_csv", "csv")):
    query(_name, _ROUND_TRIP_SQL)(_round_trip(_format))


@query("load_pairs", f"{_TEXT_PAIRS} SELECT source_module1, md5(func1) AS a, md5(func2) AS b, clone FROM p")
def q_load_pairs(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "pairs")
    write_pairs(same_group_pairs(turn_index(spark, sf)), path)
    back = load_pairs(spark, path, multi_line=False)
    return back.select("source_module1", F.md5("func1").alias("a"), F.md5("func2").alias("b"), "clone")


@query("load_pairs_arrays", f"{_TEXT_PAIRS} SELECT source_module1, md5(func1) AS a, md5(func2) AS b, clone FROM p")
def q_load_pairs_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs in files that each hold one JSON array; the number of files follows from the pairs and their text."""
    path = scratch_path(spark, "pair-arrays")
    index = turn_index(spark, sf)
    # A turn is written once for every other turn of its module.
    text = F.octet_length(F.to_json(F.struct("body"))).cast("decimal(38,0)")
    modules = index.units.groupBy("module").agg(F.count("*").alias("n"), F.sum(text).alias("b"))
    size = int(modules.agg(F.sum((F.col("n") - 1) * F.col("b"))).first()[0] or 0)
    files = max(1, -(-index.n_same // ARRAY_PAIRS), -(-size // ARRAY_BYTES))
    write_pair_arrays(same_group_pairs(index), path, ["source_module1", "unit_key1", "unit_key2"], files)
    back = load_pairs(spark, path)
    return back.select("source_module1", F.md5("func1").alias("a"), F.md5("func2").alias("b"), "clone")


@query("sample_modules", f"WITH {TURNS_SQL} SELECT module FROM (SELECT DISTINCT module FROM turns) ORDER BY md5('42:' || module), module LIMIT 50")
def q_sample_modules(spark: SparkSession, sf: str) -> DataFrame:
    return sample_modules(turns(spark, sf), 50, 42)


@query(
    "sample_one_per_module",
    f"""WITH {TURNS_SQL}, o AS (SELECT *, md5('42:' || module || ':' || unit_key) AS h FROM turns),
    p AS (SELECT module, arg_min(name, h) AS name FROM o GROUP BY 1)
    SELECT module, name, min(unit_key) AS unit_key FROM turns JOIN p USING (module, name) GROUP BY ALL""",
)
def q_sample_one_per_module(spark: SparkSession, sf: str) -> DataFrame:
    return sample_one_per_module(turns(spark, sf), 42)
