"""The three jobs, end to end: match changed files, build labelled pairs, evaluate measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinseek.functions.measures import MEASURES
from twinseek.operators.changes import touched_units
from twinseek.operators.evaluate import ranked_strategies, score_pairs, strategy_metrics
from twinseek.operators.extract import extract_functions, number_units
from twinseek.operators.filters import filter_units
from twinseek.operators.match import match_units, with_texts
from twinseek.operators.pairs import PairIndex, balanced_sample, index_units, to_pair_table
from twinseek.operators.thresholds import ThresholdConfig
from twinseek.session import materialize
from twinseek.sources.files import changed_cap, changed_set, scan_files, scan_folder
from twinseek.sources.sinks import load_pairs, write_metrics, write_pairs, write_report


def check_changes(
    spark: SparkSession,
    root: str,
    changed: str,
    measure: str = "jaccard_tokens",
    thresholds: ThresholdConfig | None = None,
    min_lines: int = 5,
    changed_lines: DataFrame | None = None,
    max_files: int | None = None,
    report_path: str | None = None,
    allow_wide: bool = False,
) -> DataFrame:
    """Matches of the functions in the changed files (newline-separated paths below `root`) with all functions there.

    With `changed_lines` only functions that hold a changed line are checked.
    """
    files = scan_files(spark, root)
    units = materialize(number_units(filter_units(extract_functions(files), min_lines=min_lines)), "functions")
    listed = spark.createDataFrame([(changed,)], "value string")
    paths = changed_cap(changed_set(listed, files), max_files)
    if changed_lines is None:
        matches = match_units(units, changed_paths=paths, measure=measure, thresholds=thresholds, allow_wide=allow_wide)
    else:
        new = touched_units(units.join(paths, "file_path", "left_semi"), changed_lines)
        matches = match_units(units, new_units=new, measure=measure, thresholds=thresholds, allow_wide=allow_wide)
    matches = materialize(matches, "matches")
    if report_path:
        write_report(with_texts(matches, units), report_path)
    return matches


def module_functions(spark: SparkSession, folder: str) -> DataFrame:
    """(module, unit_key, name, body) of the Python files of a folder, with exact source segments."""
    found = extract_functions(scan_folder(spark, folder), body_mode="segment")
    return found.select(
        F.col("file_path").alias("module"), F.col("pos").cast("bigint").alias("unit_key"), "name", "body"
    )


def build_pairs(
    units: DataFrame, path: str | None = None, file_format: str = "json", clone_ratio: float = 0.5, seed: int = 42
) -> tuple[DataFrame, PairIndex]:
    """Balanced labelled pairs of units(module, unit_key, name, body), written when a path is given."""
    index = index_units(units, seed)
    pairs = balanced_sample(index, clone_ratio, seed)
    if path:
        write_pairs(to_pair_table(pairs), path, file_format)
    return pairs, index


def evaluate_measures(
    spark: SparkSession,
    pairs: DataFrame | str,
    methods: tuple[str, ...] = tuple(MEASURES),
    normalizer: str = "literals",
    compat: bool = True,
    metrics_path: str | None = None,
) -> DataFrame:
    """Metrics of every measure on labelled pairs, best first."""
    table = load_pairs(spark, pairs) if isinstance(pairs, str) else pairs
    scored = materialize(score_pairs(table, methods, normalizer), "scored")
    metrics = ranked_strategies(strategy_metrics(scored, compat))
    if metrics_path:
        write_metrics(metrics, metrics_path)
    return metrics
