"""Building blocks that keep every task bounded when one key holds a large share of the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from twinseek.session import materialize

# A broadcast side never holds more rows than this; the bound is proven by counting, see `lookup_join`.
BROADCAST_ROWS = 1_000_000
# Rows of one key that one task may have to hold.
KEY_ROWS = 100_000
# Counts of pairs outgrow BIGINT.
BIG = T.DecimalType(38, 0)


def spread(df: DataFrame) -> DataFrame:
    """Splits an input of fewer partitions than cores (one small file); larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def lookup_join(
    left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, rows: int | None = None
) -> DataFrame:
    """Inner join with a table holding one row per key, safe for hot keys.

    `weight` (a column of `right`) is the number of rows of `left` with that key, and `total` the number of rows of
    `left`. At most ``total / c`` keys can have a weight of at least ``c``, so with ``c = total / rows`` the heavy keys
    fit a broadcast of `rows` rows: by default fewer if they hold texts, and always to be given if those may be long. The
    others have fewer than ``c`` rows each and are joined by a shuffle.
    """
    if rows is None:
        rows = BROADCAST_ROWS // 5 if "string" in dict(right.dtypes).values() else BROADCAST_ROWS
    cut = max(1, math.ceil(total / rows))
    if cut == 1:
        return left.join(F.broadcast(right), keys)
    head = right.filter(F.col(weight) >= cut).withColumn("_head", F.lit(True))
    tail = right.filter(F.col(weight) < cut)
    marked = left.join(F.broadcast(head), keys, "left")
    hot = marked.filter("_head").drop("_head")
    cold = marked.filter("_head IS NULL").select(*left.columns).join(tail, keys)
    return hot.unionByName(cold)


def hub_join(
    rows: DataFrame, facts: DataFrame, key: str, spread_by: str, counted: DataFrame | None = None, key_rows: int = KEY_ROWS
) -> DataFrame:
    """Inner join of `rows` with one row of `facts` per key, of any size; heavy keys are split.

    A key with more than `key_rows` rows gets several salts, and its row of `facts` a copy for each. Rows per key are
    counted in `counted` (a stored table with the same keys) or in `rows`; at most ``count / key_rows`` keys are heavy, so
    that their list is broadcast and neither side, which may hold texts, is shuffled for the salts.
    """
    heavy = (rows if counted is None else counted).groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > key_rows)
    heavy = F.broadcast(heavy.select(key, F.ceil(F.col("_n") / key_rows).cast("bigint").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1).cast("bigint"))
    salted = rows.join(heavy, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread_by), parts)).drop("_parts")
    copied = facts.join(heavy, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("_parts")
    return salted.join(copied, [key, "_salt"]).drop("_salt")


def hash_hex(*parts: Column | str | int) -> Column:
    """md5 of the parts joined with ':': a pseudo-random order every SQL engine can repeat."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def hash_number(hex_text: Column) -> Column:
    """First 15 hexadecimal digits as a non-negative BIGINT."""
    return F.conv(F.substring(hex_text, 1, 15), 16, 10).cast("bigint")


def dense_index(
    df: DataFrame, group: list[str], order: str, out: str, tie: str | None = None, digits: int = 3
) -> DataFrame:
    """0-based position inside each group in the order of `order` (an md5 text), then `tie`.

    No group is sorted as a whole: the first `digits` hexadecimal digits split it into up to 16**digits slices, slice
    sizes are added up, and only slices are sorted.
    """
    sliced = df.withColumn("_slice", F.substring(F.col(order), 1, digits))
    sizes = sliced.groupBy(*group, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    keys = [order] + ([tie] if tie else [])
    inside = Window.partitionBy(*group, "_slice").orderBy(*keys)
    return (
        sliced.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, [*group, "_slice"])
        .withColumn(out, F.col("_before") + F.col("_rank") - 1)
        .drop("_slice", "_rank", "_before")
    )


def running_totals(df: DataFrame, key: str, values: dict[str, str], digits: int = 4) -> DataFrame:
    """Adds, for each `out: value` of `values`, the sum of `value` over all rows before this one.

    Rows are ordered by md5(`key`), then `key`, which is unique. Works slice by slice like `dense_index`; the one window
    without partitions runs over the slice totals, at most 16**digits rows.
    """
    zero = F.lit(0).cast(BIG)
    hashed = df.withColumn("_h", hash_hex(F.col(key))).withColumn("_slice", F.substring("_h", 1, digits))
    totals = hashed.groupBy("_slice").agg(*[F.sum(F.col(v).cast(BIG)).alias(f"_{o}") for o, v in values.items()])
    everything = Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_slice", *[F.coalesce(F.sum(f"_{o}").over(everything), zero).alias(f"_{o}") for o in values])
    inside = Window.partitionBy("_slice").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, -1)
    out = hashed.select("*", *[F.coalesce(F.sum(F.col(v).cast(BIG)).over(inside), zero).alias(o) for o, v in values.items()])
    out = out.join(F.broadcast(offsets), "_slice")  # at most 16**digits rows
    for o in values:
        out = out.withColumn(o, (F.col(o) + F.col(f"_{o}")).cast(BIG))
    return out.drop("_h", "_slice", *[f"_{o}" for o in values])


def take_smallest(df: DataFrame, order: str, k: int, tie: str, digits: int = 4) -> DataFrame:
    """Exactly min(k, rows) rows with the smallest `order` (an md5 text), then `tie`, without sorting the table.

    Whole slices below the cut are kept as they are; only the slice the cut falls into is numbered.
    """
    if k <= 0:
        return df.limit(0)
    if k <= KEY_ROWS:
        return df.orderBy(order, tie).limit(k)
    sliced = df.withColumn("_slice", F.substring(F.col(order), 1, digits))
    everything = Window.partitionBy(F.lit(0)).orderBy("_slice")  # at most 16**digits rows
    sizes = (
        sliced.groupBy("_slice")
        .agg(F.count("*").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(everything))
        .withColumn("_left", F.lit(k) - (F.col("_upto") - F.col("_n")))
        .filter("_left > 0")
    )
    kept = sliced.join(F.broadcast(sizes.select("_slice", "_n", "_left")), "_slice")
    whole = kept.filter("_n <= _left")
    inside = Window.partitionBy("_slice").orderBy(order, tie)
    cut = kept.filter("_n > _left").withColumn("_rank", F.row_number().over(inside)).filter("_rank <= _left")
    return whole.unionByName(cut.drop("_rank")).drop("_slice", "_n", "_left")


def global_row_number(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """1-based row number over a total order, without moving all rows to one task.

    The rows are range-partitioned, sorted and written once, each with its partition and place there. Row numbers are the
    place plus the sizes of the earlier partitions, so nothing is sorted or shuffled again.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialize(ranged.withColumn("_place", F.monotonically_increasing_id()), "ranged")
    # Fixed by Spark: the partition is in the bits from 33 on, the place below.
    stored = stored.withColumn("_part", F.shiftright("_place", 33)).withColumn("_place", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = stored.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per partition
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    numbered = stored.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_before") + F.col("_place") + 1)
    return numbered.drop("_part", "_place", "_before")


def int_div(a: Column, b: Column) -> Column:
    """Whole-number division; also exact for numbers beyond BIGINT as long as the quotient fits."""
    return F.call_function("div", a, b)


def locate(points: DataFrame, point: str, intervals: DataFrame, low: str, high: str, cells: int, end: int) -> DataFrame:
    """Joins each point with the interval that holds it (`low` <= point < `high`); the intervals are disjoint.

    [0, end) is cut into `cells` equal cells. An interval is listed under every cell it touches, a point under one. Inside a
    cell, points and interval starts are put in one order and each point takes the last start before it: the work is the
    number of rows, however many intervals a cell holds, and one wide interval is spread over many cells.
    """
    width = F.lit(max(1, -(-end // max(1, cells)))).cast(BIG)
    cell_of = lambda c: int_div(c.cast(BIG), width)
    own = F.struct(*intervals.columns)
    listed = intervals.filter(F.col(high) > F.col(low)).select(
        own.alias("_interval"), F.col(low).cast(BIG).alias("_low"), F.explode(F.sequence(cell_of(F.col(low)), cell_of(F.col(high) - 1))).alias("_cell")
    )
    listed = listed.select("_cell", F.greatest("_low", (F.col("_cell") * width).cast(BIG)).alias("_at"), F.lit(0).alias("_is_point"), "_interval")
    placed = points.select(cell_of(F.col(point)).alias("_cell"), F.col(point).cast(BIG).alias("_at"), F.lit(1).alias("_is_point"), F.struct(*points.columns).alias("_row"))
    upto = Window.partitionBy("_cell").orderBy("_at", "_is_point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = listed.unionByName(placed, allowMissingColumns=True).withColumn("_interval", F.last("_interval", ignorenulls=True).over(upto))
    found = held.filter("_is_point = 1 AND _interval IS NOT NULL").select("_row.*", "_interval.*")
    return found.filter((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high)))


def draw(spark: SparkSession, size: int, k: int, seed: int, out: str) -> DataFrame:
    """`k` distinct numbers of [0, size), the same ones for the same seed.

    [0, size) is cut into `k` stretches whose lengths differ by at most one; a hash of the seed picks one number of
    each. Nothing is rejected, sorted or de-duplicated, and ``k = size`` gives every number.
    """
    whole, extra = divmod(size, k) if k else (0, 0)
    t = F.col("t").cast(BIG)
    start = lambda n: (n * F.lit(whole).cast(BIG) + int_div(n * F.lit(extra).cast(BIG), F.lit(max(k, 1)).cast(BIG))).cast(BIG)
    one = F.lit(1).cast(BIG)
    picks = spark.range(k).withColumnRenamed("id", "t")
    if k == size:
        return picks.select(t.alias(out), "t")
    low, high = start(t), start((t + one).cast(BIG))
    return picks.select((low + F.pmod(hash_number(hash_hex(seed, F.col("t"))).cast(BIG), high - low)).cast(BIG).alias(out), "t")
