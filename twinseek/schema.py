"""Row shapes, row checks and the columns derived from a unit or a match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT_SCHEMA = T.StructType(
    [
        T.StructField("unit_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("line_start", T.IntegerType()),
        T.StructField("line_end", T.IntegerType()),
        T.StructField("signature", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)

PAIR_SCHEMA = T.StructType(
    [
        T.StructField("func1", T.StringType()),
        T.StructField("func2", T.StringType()),
        T.StructField("func1_name", T.StringType()),
        T.StructField("func2_name", T.StringType()),
        T.StructField("clone", T.BooleanType()),
        T.StructField("source_module1", T.StringType()),
        T.StructField("source_module2", T.StringType()),
    ]
)

# Confidence buckets and their lower bounds; units below SMALL_UNIT_LINES lines are small.
CONFIDENCE_BOUNDS = (("High", 0.8), ("Medium", 0.6), ("Low", 0.4))
LOWEST_CONFIDENCE = "Very Low"
SMALL_UNIT_LINES = 5


def confidence(score: Column) -> Column:
    """Confidence bucket of a score."""
    out = None
    for label, bound in CONFIDENCE_BOUNDS:
        out = F.when(score >= bound, label) if out is None else out.when(score >= bound, label)
    return out.otherwise(LOWEST_CONFIDENCE)


def is_high_confidence(score: Column) -> Column:
    return score >= CONFIDENCE_BOUNDS[0][1]


def line_count() -> Column:
    return F.col("line_end") - F.col("line_start") + 1


def unit_metrics(units: DataFrame) -> DataFrame:
    """Adds `line_count` and `is_small`."""
    return units.withColumn("line_count", line_count()).withColumn(
        "is_small", F.col("line_count") < SMALL_UNIT_LINES
    )


def unit_error(with_body: bool = False) -> Column:
    """Text of the first broken row rule, NULL for a valid unit; `with_body` also asks for a body."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return (
        F.when(blank("name"), "name is empty")
        .when(blank("file_path"), "file path is empty")
        .when(F.col("line_start").isNull() | (F.col("line_start") <= 0), "line start is not positive")
        .when(F.col("line_end").isNull() | (F.col("line_end") < F.col("line_start")), "line end precedes line start")
        .when(F.col("body").isNull() if with_body else F.lit(False), "body is missing")
    )


def match_error() -> Column:
    """Text of the broken rule of a match row, NULL for a valid one."""
    return F.when(
        F.col("similarity").isNull() | ~F.col("similarity").between(0.0, 1.0), "similarity is outside [0, 1]"
    )


def validate_units(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid units, quarantined units with `error`). Where units have a body, it must not be NULL."""
    checked = units.withColumn("error", unit_error("body" in units.columns))
    return checked.filter("error IS NULL").drop("error"), checked.filter("error IS NOT NULL")


def unit_struct(prefix: str, extra: tuple[str, ...] = ("signature", "body")) -> Column:
    """Nested record of one side of a match, from its `<prefix>_*` columns."""
    start, end = F.col(f"{prefix}_line_start"), F.col(f"{prefix}_line_end")
    fields = [
        F.col(f"{prefix}_name").alias("name"),
        F.col(f"{prefix}_path").alias("file_path"),
        start.alias("line_start"),
        end.alias("line_end"),
    ]
    fields += [F.col(f"{prefix}_{c}").alias({"body": "body_content"}.get(c, c)) for c in extra]
    return F.struct(*fields, (end - start + 1).alias("line_count"))


def match_record(matches: DataFrame) -> DataFrame:
    """One nested record per match: both units, the score and its confidence bucket.

    Signature and body of both sides are part of it if `matches` has them, see `with_texts`.
    """
    extra = tuple(c for c in ("signature", "body") if {f"new_{c}", f"old_{c}"} <= {*matches.columns})
    return matches.select(
        unit_struct("new", extra).alias("new_function"),
        unit_struct("old", extra).alias("existing_function"),
        F.col("similarity").alias("similarity_score"),
        confidence(F.col("similarity")).alias("confidence_level"),
    )
