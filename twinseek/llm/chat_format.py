"""Chat formatting with cumulative-snapshot collapse.

A conversation is often logged again after every turn, so most logged ones are prefixes of a longer one. Every turn gets
a rolling hash of all turns up to it: the sum of hashes of (position, role, text), 120 bits in two numbers. A conversation
whose last hash is an inner hash of another one is its prefix; of equal ones the smallest id stays. Both are equi-joins
on (length, hash), with the inner hashes made distinct before they are joined. What remains is rendered.

Positions and running sums are taken in blocks of `BLOCK` turn numbers, so that a conversation that holds a third of all
rows is spread over tasks like any other rows. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinseek.session import materialize

BLOCK = 1000
# The markers of the widely used ChatML layout.
START, END = "<|im_start|>", "<|im_end|>"
_BIG = "decimal(38,0)"


def rendered_turn(role: Column, text: Column) -> Column:
    """One turn in ChatML; a marker inside a text is broken up by a space, so that texts can't end a turn."""
    return F.concat(F.lit(START), role, F.lit("\n"), F.replace(text, F.lit("<|"), F.lit("< |")), F.lit(f"{END}\n"))


def _number(hex_digest: Column, at: int) -> Column:
    return F.conv(F.substring(hex_digest, at, 15), 16, 10).cast(_BIG)


def rolling(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(conv, block, position, role, text, n, ha, hb): each turn with its position from 1, the length of its conversation and its prefix hash.

    Turns are ordered by number (null first), then role, then text; null roles and texts count as ''. Rows with a null
    conversation id form one conversation.
    """
    rows = turns.select(
        F.col(f"`{conv_id}`").alias("conv"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(2**62))))
    inside = Window.partitionBy("conv", "block").orderBy(F.asc_nulls_first("turn"), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("conv", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("conv", "block").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    sizes = sizes.withColumn("n", F.sum("size").over(Window.partitionBy("conv"))).select(
        F.col("conv").alias("_conv"), F.col("block").alias("_block"), "before", "n"
    )
    rows = rows.join(sizes, rows["conv"].eqNullSafe(sizes["_conv"]) & (rows["block"] == sizes["_block"])).drop("_conv", "_block")
    rows = rows.withColumn("position", F.col("before") + F.col("rank"))
    rows = rows.withColumn("digest", F.sha2(F.concat_ws(":", F.col("position").cast("string"), F.length("role").cast("string"), "role", "text"), 256))
    sums = [F.sum(_number(F.col("digest"), at)).over(inside).cast(_BIG).alias(h) for h, at in (("ra", 1), ("rb", 16))]
    rows = materialize(rows.select("conv", "block", "position", "role", "text", "n", *sums), "chat-turns")
    # Sums of the earlier blocks of the conversation.
    ends = rows.groupBy("conv", "block").agg(F.max("ra").alias("ra"), F.max("rb").alias("rb"))
    ends = ends.withColumns({f"_{h}": F.coalesce(F.sum(h).over(earlier), F.lit(0)).cast(_BIG) for h in ("ra", "rb")})
    ends = ends.select(F.col("conv").alias("_conv"), F.col("block").alias("_block"), "_ra", "_rb")
    rows = rows.join(ends, rows["conv"].eqNullSafe(ends["_conv"]) & (rows["block"] == ends["_block"]))
    hashes = [(F.col(h) + F.col(f"_{h}")).cast(_BIG).alias(out) for h, out in (("ra", "ha"), ("rb", "hb"))]
    return rows.select("conv", "block", "position", "role", "text", "n", *hashes)


def maximal(turns: DataFrame) -> DataFrame:
    """(conv, n, copies): conversations, from `rolling`, that are no proper prefix of another; of equal ones the smallest id, with their number."""
    ident = F.struct(F.col("conv").isNull().alias("none"), F.col("conv").alias("conv"))
    whole = turns.filter("position = n").groupBy("n", "ha", "hb").agg(F.min(ident).alias("first"), F.count("*").alias("copies"))
    inner = turns.filter("position < n").select(F.col("position").alias("n"), "ha", "hb").distinct()
    return whole.join(inner, ["n", "ha", "hb"], "left_anti").select(F.col("first.conv").alias("conv"), "n", "copies")


def chat_examples(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, copies (equal conversations), text (all turns rendered in order).

    Turns are put together block by block; one conversation must fit one string. Other columns are ignored.
    """
    turns = materialize(rolling(conversations, conv_id, turn, role, text, block), "chat-rolling")
    kept = maximal(turns).withColumnRenamed("conv", "_conv").withColumnRenamed("n", "_n")
    rows = turns.join(kept, turns["conv"].eqNullSafe(kept["_conv"]))

    def joined(parts: str) -> Column:
        ordered = F.sort_array(F.collect_list(F.struct("place", parts)))
        return F.array_join(F.transform(ordered, lambda x: x[parts]), "").alias(parts)

    pieces = rows.select("conv", "block", "n", "copies", F.col("position").alias("place"), rendered_turn(F.col("role"), F.col("text")).alias("text"))
    blocks = pieces.groupBy("conv", "block", "n", "copies").agg(joined("text")).withColumnRenamed("block", "place")
    out = blocks.groupBy("conv", "n", "copies").agg(joined("text"))
    return out.select(F.col("conv").alias("conv_id"), F.col("n").alias("n_turns"), "copies", "text")
