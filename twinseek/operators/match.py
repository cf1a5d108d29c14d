"""The similarity join: new units against existing units, by any registered measure.

1. Units with the same features (same token set, or same text) and the same threshold form one class; a class is
   scored once, however many copies it has.
2. Classes with equal features score 1.0; other class pairs come from the overlap join and are scored exactly.
3. Class pairs are expanded to unit pairs block by block, so that a class of many copies is spread over many tasks.

A corpus can be indexed once (`build_index`) and asked for any number of new tables (`match_index`).
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinseek.functions.measures import Measure, get_measure
from twinseek.functions.text import token_set
from twinseek.operators.overlap import bucket_counts, overlap_pairs, prefixes, rarity_table
from twinseek.operators.thresholds import DEFAULT_THRESHOLD, ThresholdConfig, folder_threshold, folder_threshold_table
from twinseek.operators.segments import segment_pairs
from twinseek.operators.signatures import EPS, sketches_differ
from twinseek.plans.layout import BROADCAST_ROWS, hub_join, lookup_join, spread
from twinseek.schema import confidence
from twinseek.session import delete_table, materialize, scratch_path, write_table

BLOCK_ROWS = 1024
# Candidate pairs of texts that one task scores.
PAIRS_PER_TASK = 5_000
# A join of token sets is made in passes, each written before the next, so that the disk it needs grows no faster than the input:
# postings of both sides, sketches that candidate pairs meet (two a pair), and tokens of one side of the pairs that are scored. A pass
# reads the classes, so it takes more of each where there are more than PASS_CLASSES of them.
PASS_POSTINGS, PASS_PAIRS, PASS_TOKENS = 3_000_000, 3_000_000, 40_000_000
PASS_CLASSES = 120_000
# Postings that a Python worker gets at once; they are numbers.
POSTING_ROWS = "10000"
# Classes of several units whose keys a broadcast may hold.
COPIED_ROWS = BROADCAST_ROWS // 5
# Rows with whole texts that a broadcast may hold.
TEXT_ROWS = 10_000
MATCH_COLUMNS = [
    "new_id", "new_path", "new_name", "new_line_start", "new_line_end",
    "old_id", "old_path", "old_name", "old_line_start", "old_line_end",
    "similarity", "threshold", "confidence",
]


def exclude_self() -> Column:
    """False for a unit paired with itself, that is same path and same name."""
    return ~((F.col("new_path") == F.col("old_path")) & (F.col("new_name") == F.col("old_name")))


Thresholds = ThresholdConfig | DataFrame


@dataclass(frozen=True)
class CorpusIndex:
    """A corpus prepared once for any number of new tables: its units, classes and rare-first prefixes, all written.

    The order of features is frozen with the index. Features that only new units have come first in it and meet nothing,
    unless units were added since: then `holders_now` says how many hold the features of a bucket by now, where these are many.
    Units and classes that were added in parts have a column `segment`.
    """

    measure: Measure
    thresholds: Thresholds
    global_threshold: float
    units: DataFrame
    classes: DataFrame
    rows: int
    lowest: float | None
    highest: float | None
    floor: float
    rarity: np.ndarray
    prefix: DataFrame
    holders_now: DataFrame | None = None


def unit_classes(units: DataFrame, m: Measure, thresholds: Thresholds, global_threshold: float, side: int, write: bool = True) -> tuple[DataFrame, DataFrame]:
    """(units with class key and threshold, classes). `side` keeps the class ids of two tables apart.

    Without `write` the classes are not written; the caller does it.
    """
    columns = ["unit_id", "file_path", "name", "line_start", "line_end", "body"]
    rows = spread(units.select(*columns, (F.col("unit_id") * 2 + side).alias("uid"))).filter("body IS NOT NULL")
    if isinstance(thresholds, DataFrame):
        rows = folder_threshold_table(rows, thresholds, global_threshold).withColumnRenamed("threshold", "t")
    else:
        rows = rows.withColumn("t", folder_threshold("file_path", thresholds))
    payload = token_set("body") if m.by_tokens else F.col("body")
    key = F.sha2(F.to_json(F.sort_array("payload")) if m.by_tokens else F.col("payload"), 256)
    size = F.size("payload") if m.by_tokens else F.length("payload")
    listed = rows.withColumn("payload", payload).withColumn("set_key", key).withColumn("size", size)
    stored = materialize(listed.drop("body").withColumn("_row", F.monotonically_increasing_id()), "units")
    units = stored.drop("payload", "size", "_row")
    counted = stored.groupBy("set_key", "t").agg(F.min("uid").alias("cid"), F.count("*").alias("members"), F.min("_row").alias("_first"))
    copied = materialize(counted.filter("members > 1"), "copied")
    if copied.count() <= COPIED_ROWS:
        # No text moves: a class is its first unit as it was written, and only classes of several units are looked up.
        many = copied.select(F.col("set_key").alias("_key"), F.col("t").alias("_t"), "cid", "members", "_first")
        found = stored.join(F.broadcast(many), (F.col("set_key") == F.col("_key")) & F.col("t").eqNullSafe(F.col("_t")), "left")
        found = found.filter("_first IS NULL OR _row = _first")
        cid, members = F.when(F.col("_first").isNull(), F.col("uid")).otherwise(F.col("cid")), F.coalesce("members", F.lit(1).cast("bigint"))
        return units, found.select("set_key", "t", cid.alias("cid"), members.alias("members"), "payload", "size")
    classes = stored.groupBy("set_key", "t").agg(
        F.min("uid").alias("cid"), F.count("*").alias("members"), F.first("payload").alias("payload"), F.first("size").alias("size")
    )
    return units, materialize(classes, "classes") if write else classes


def least_positive(thresholds: Thresholds, global_threshold: float) -> float:
    """The smallest threshold above 0 that any path can have, 1 if there is none."""
    if isinstance(thresholds, DataFrame):
        found = [thresholds.agg(F.min(F.when(F.col("threshold") > 0, F.col("threshold"))).alias("t")).first().t, global_threshold]
    else:
        found = [thresholds.global_threshold, *[v for _, v in thresholds.ranked_folders()]]
    return min((float(v) for v in found if v), default=1.0)


def build_index(
    corpus: DataFrame,
    measure: str = "jaccard_tokens",
    thresholds: Thresholds | None = None,
    allow_wide: bool = False,
    global_threshold: float = DEFAULT_THRESHOLD,
) -> CorpusIndex:
    """Index of a corpus for `match_index`; the arguments are those of `match_units`."""
    m, thresholds = get_measure(measure), ThresholdConfig() if thresholds is None else thresholds
    units, classes = unit_classes(corpus, m, thresholds, global_threshold, 0)
    in_use = classes.agg(F.min("t").alias("low"), F.max("t").alias("high")).first()
    if in_use.low is not None and in_use.low < m.wide_below and not allow_wide:
        warnings.warn(f"threshold {in_use.low} makes {measure} compare almost all pairs", stacklevel=2)
    # A pair needs the stricter of two thresholds. Unless the corpus has zeros, its own smallest one is therefore safe.
    floor = in_use.low if in_use.low else least_positive(thresholds, global_threshold)
    rarity = rarity_table(bucket_counts(classes, m, floor))
    prefix = materialize(prefixes(classes, m, floor, rarity), "prefix")
    return CorpusIndex(m, thresholds, global_threshold, units, classes, units.count(), in_use.low, in_use.high, floor, rarity, prefix)


def _passes(rows: float, most: int, classes: int) -> int:
    return max(1, math.ceil(rows / (most * max(1.0, classes / PASS_CLASSES))))


def _sliced(df: DataFrame, passes: int, *keys: str) -> list[DataFrame]:
    """`df` in parts by the hash of `keys`."""
    return [df] if passes == 1 else [df.filter(F.pmod(F.xxhash64(*keys), F.lit(passes)) == i) for i in range(passes)]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def token_pairs(
    smaller: DataFrame, larger: DataFrame, measure: Measure, floor: float, ties: str, holders_now: DataFrame | None = None, few: str | None = None
) -> DataFrame:
    """The pairs of `overlap_pairs` of token sets that their sketches don't rule out, see `_near`; each once, written.

    Features are taken in passes. A pass drops the pairs that are known and keeps those that are near; the others are deleted with
    it. Candidates grow with the square of the sets: after a pass that had too many, the parts that are left are halved.
    """
    held = lambda df, role: df.agg(F.sum(F.least(f"p_{role}", F.size("ordered")))).first()[0] or 0
    spark, classes, key = larger.sparkSession, larger.count(), ["small_cid", "large_cid"]
    # A table that meets itself sends its postings once.
    passes = 1 if few else _passes(held(larger, "large") + (0 if larger is smaller else held(smaller, "small")), PASS_POSTINGS, classes)
    parts, kept = [(i, passes) for i in range(passes)], []
    while parts:
        part, *parts = parts
        options = {"few": few, "holders_now": holders_now, "part": None if part[1] == 1 else part}
        met = overlap_pairs(smaller, larger, measure, floor, ties, **{k: v for k, v in options.items() if v is not None})
        if kept:
            # Unit ids may repeat, and class ids with them: then a pair may come again with a stricter threshold.
            known = _union(kept).groupBy(*key).agg(F.max("threshold").alias("_known"))
            met = met.join(known, key, "left").filter("_known IS NULL OR _known < threshold").drop("_known")
        path = scratch_path(spark, "candidates")
        met = write_table(met, path, POSTING_ROWS)
        n = met.count()
        kept += _near(met, n, smaller, larger, measure, classes)
        delete_table(spark, path)
        if _passes(2 * n, PASS_PAIRS, classes) > 1:
            parts = [(i + again, 2 * of) for i, of in parts for again in (0, of)]
    return kept[0] if len(kept) == 1 else materialize(_union(kept).groupBy(*key).agg(F.max("threshold").alias("threshold")), "near")


def _near(pairs: DataFrame, n: int, smaller: DataFrame, larger: DataFrame, measure: Measure, classes: int) -> list[DataFrame]:
    """The `n` pairs whose sketches, in the tables of prefixes, don't rule them out, written in parts: sketches travel, no texts."""
    near = sketches_differ("_small", "_large") <= measure.differ_max(F.col("_small_size"), F.col("_large_size"), F.col("threshold")) + EPS
    kept = []
    for part in _sliced(pairs, _passes(2 * n, PASS_PAIRS, classes), "small_cid", "large_cid"):
        out = part
        for role, other, side in (("small", "large", smaller), ("large", "small", larger)):
            sketches = side.select(F.col("cid").alias(f"{role}_cid"), F.col("size").alias(f"_{role}_size"), F.col("sketch").alias(f"_{role}"))
            out = hub_join(out, sketches, f"{role}_cid", f"{other}_cid", counted=part)
        # Unit ids may repeat, and class ids with them: a pair stays one row.
        kept.append(materialize(out.filter(near).select(*pairs.columns).distinct(), "near"))
    return kept


def _in_question(classes: DataFrame, pairs: DataFrame, *sides: str) -> DataFrame:
    """The classes that `pairs` name, where these are few enough to be broadcast; else all, which the join then sorts out."""
    ids = pairs.select(F.explode(F.array(*sides)).alias("cid")).distinct()
    return classes.join(F.broadcast(ids), "cid", "left_semi") if ids.count() <= BROADCAST_ROWS else classes


def _scored(found: list[DataFrame], new: DataFrame, old: DataFrame, measure: Measure) -> DataFrame:
    """Adds the exact score of class pairs (new_cid, old_cid, threshold) and keeps those that reach their threshold.

    Classes with equal features are left to `_equal_features`. Of token sets, `found` are the pairs that `token_pairs` leaves.
    """
    pairs = _union(found)
    if not measure.by_tokens:
        return _exact(materialize(pairs, "candidates"), new, old, measure)
    held = new.agg(F.avg("size").alias("size"), F.count("*").alias("n")).first()
    tokens = pairs.count() * (held["size"] or 0)
    found = []
    for part in _sliced(pairs, _passes(tokens, PASS_TOKENS, held.n), "new_cid"):
        asked = _in_question(new, part, "new_cid", "old_cid")
        found.append(_exact(part, asked, asked if old is new else _in_question(old, part, "new_cid", "old_cid"), measure))
    return found[0] if len(found) == 1 else _union([materialize(x, "scored") for x in found])


def _exact(pairs: DataFrame, new: DataFrame, old: DataFrame, measure: Measure) -> DataFrame:
    """`_scored` for stored pairs, all of which are joined with token sets or texts."""
    left = new.select(F.col("cid").alias("new_cid"), F.col("payload").alias("_a"), F.col("set_key").alias("_ka"))
    right = old.select(F.col("cid").alias("old_cid"), F.col("payload").alias("_b"), F.col("set_key").alias("_kb"))
    joined = hub_join(hub_join(pairs, left, "new_cid", "old_cid"), right, "old_cid", "new_cid", counted=pairs)
    joined = joined.filter("_ka <> _kb").drop("_ka", "_kb")
    if measure.possible:
        joined = joined.filter(measure.possible(F.col("_a"), F.col("_b"), F.col("threshold")))
    if not measure.by_tokens:
        # Scoring one pair of long texts is slow: spread the pairs evenly, those of one second text in a few runs. The
        # number of tasks follows the number of pairs, since their bytes say little about the work.
        n = pairs.count()
        cores = joined.sparkSession.sparkContext.defaultParallelism
        runs = F.pmod(F.xxhash64("new_cid"), F.lit(8 + n // PAIRS_PER_TASK))
        joined = joined.repartition(max(cores, n // PAIRS_PER_TASK + 1), "old_cid", runs).sortWithinPartitions("old_cid")
    # A generated column is computed once; a plain one would be computed again inside the filter.
    once = F.explode(F.array(measure.score_above(F.col("_a"), F.col("_b"), F.col("threshold"))))
    return joined.withColumn("similarity", once).drop("_a", "_b").filter(F.col("similarity") >= F.col("threshold"))


def _both_ways(pairs: DataFrame, *carry: str) -> DataFrame:
    """(new_cid, old_cid) in both directions for unordered pairs (small_cid, large_cid), which are made once."""
    ways = [F.struct(F.col(a).alias("new_cid"), F.col(b).alias("old_cid")) for a, b in (("small_cid", "large_cid"), ("large_cid", "small_cid"))]
    return pairs.select(F.inline(F.array(*ways)), *carry)


def _equal_features(new: DataFrame, old: DataFrame, same_table: bool) -> DataFrame:
    """Class pairs with the same features; a class of one table meets itself if it has several members."""
    a = new.select("set_key", F.col("cid").alias("new_cid"), F.col("t").alias("_ta"), "members")
    b = old.select("set_key", F.col("cid").alias("old_cid"), F.col("t").alias("_tb"))
    out = a.join(b, "set_key")  # at most one class per threshold value and key on either side
    if same_table:
        out = out.filter("new_cid <> old_cid OR members > 1")
    return out.select("new_cid", "old_cid", F.greatest("_ta", "_tb").alias("threshold"), F.lit(1.0).alias("similarity"))


def _zero_threshold(new: DataFrame, old: DataFrame, measure: Measure) -> DataFrame:
    """All class pairs whose threshold is 0: every pair counts, so pairs are laid out on a grid of bounded blocks."""
    new, old = new.filter("t = 0"), old.filter("t = 0")
    side = max(1, int((max(new.count(), old.count()) / BLOCK_ROWS) + 1))
    ids = F.sequence(F.lit(0), F.lit(side - 1))
    own = F.pmod(F.xxhash64("cid"), F.lit(side)).cast("int")
    a = new.select(F.col("cid").alias("new_cid"), F.col("set_key").alias("_ka"), F.col("payload").alias("_a"), own.alias("_x"), F.explode(ids).alias("_y"))
    b = old.select(F.col("cid").alias("old_cid"), F.col("set_key").alias("_kb"), F.col("payload").alias("_b"), own.alias("_y"), F.explode(ids).alias("_x"))
    pairs = a.join(b, ["_x", "_y"]).filter("_ka <> _kb").withColumn("threshold", F.lit(0.0))
    score = measure.score_above(F.col("_a"), F.col("_b"), F.col("threshold"))
    return pairs.withColumn("similarity", F.coalesce(score, F.lit(0.0))).select(
        "new_cid", "old_cid", "threshold", "similarity"
    )


def _expanded(found: DataFrame, new: tuple[DataFrame, DataFrame, int], old: tuple[DataFrame, DataFrame, int]) -> DataFrame:
    """Unit pairs of class pairs; `new` and `old` are (units, classes, number of units).

    The members of a class are cut into blocks of about BLOCK_ROWS. Both block numbers are on a row before members are
    joined, so that no join gathers a class, only blocks.
    """
    found = materialize(found, "class-matches")
    blocks = F.ceil(F.col("members") / F.lit(BLOCK_ROWS)).cast("bigint")
    out = found
    for prefix, other, (_, classes, _) in (("new", "old", new), ("old", "new", old)):
        counts = classes.select(F.col("cid").alias(f"{prefix}_cid"), blocks.alias(f"{prefix}_blocks"))
        out = hub_join(out, counts, f"{prefix}_cid", f"{other}_cid", counted=found)
    for prefix in ("new", "old"):
        numbers = F.sequence(F.lit(0).cast("bigint"), F.col(f"{prefix}_blocks") - 1)
        out = out.withColumn(f"{prefix}_block", F.explode(numbers)).drop(f"{prefix}_blocks")
    for prefix, (units, classes, total) in (("new", new), ("old", old)):
        key = [c for c in ("segment", "set_key", "t") if c in classes.columns]
        members = lookup_join(units, classes.select(*key, "cid", "members"), key, "members", total)
        side = members.select(
            F.col("cid").alias(f"{prefix}_cid"),
            F.pmod(F.xxhash64("uid"), blocks).alias(f"{prefix}_block"),
            F.col("unit_id").alias(f"{prefix}_id"),
            F.col("file_path").alias(f"{prefix}_path"),
            F.col("name").alias(f"{prefix}_name"),
            F.col("line_start").alias(f"{prefix}_line_start"),
            F.col("line_end").alias(f"{prefix}_line_end"),
        )
        out = out.join(side, [f"{prefix}_cid", f"{prefix}_block"]).drop(f"{prefix}_block")
    return out.filter(exclude_self()).withColumn("confidence", confidence(F.col("similarity"))).select(*MATCH_COLUMNS)


def match_index(index: CorpusIndex, new_units: DataFrame) -> DataFrame:
    """Directed matches of new units with an indexed corpus, as `match_units` finds them.

    Only the new units are tokenised; of the corpus, prefixes are read, and the texts of classes that come into question.
    """
    units, classes = unit_classes(new_units, index.measure, index.thresholds, index.global_threshold, 1)
    prefix = materialize(prefixes(classes, index.measure, index.floor, index.rarity), "prefix") if index.floor < 1.0 else None
    return match_prepared(index, units, classes, prefix)


def match_prepared(index: CorpusIndex, units: DataFrame, classes: DataFrame, prefix: DataFrame | None) -> DataFrame:
    """`match_index` for new units whose classes and prefixes (under the order of the index) are there already."""
    m, floor, now = index.measure, index.floor, index.holders_now
    found = _equal_features(classes, index.classes, False)
    if floor < 1.0:
        few = (prefix.agg(F.sum(F.size("ordered"))).first()[0] or 0) <= BROADCAST_ROWS // 10  # a posting has about 60 bytes
        meet = token_pairs if m.by_tokens else overlap_pairs
        up = [meet(prefix, index.prefix, m, floor, "all", few="small" if few else None, holders_now=now)]
        down = [meet(index.prefix, prefix, m, floor, "none", few="large" if few else None, holders_now=now)]
        if m.segments:
            up.append(segment_pairs(classes, index.classes, m, floor, "all"))
            down.append(segment_pairs(index.classes, classes, m, floor, "none"))
        pairs = [x.withColumnsRenamed({"small_cid": "new_cid", "large_cid": "old_cid"}) for x in up]
        pairs += [x.select(F.col("large_cid").alias("new_cid"), F.col("small_cid").alias("old_cid"), "threshold") for x in down]
        found = found.unionByName(_scored(pairs, classes, index.classes, m))
    if index.lowest == 0:
        found = found.unionByName(_zero_threshold(classes, index.classes, m))
    return _expanded(found, (units, classes, units.count()), (index.units, index.classes, index.rows))


def with_texts(matches: DataFrame, units: DataFrame, new_units: DataFrame | None = None) -> DataFrame:
    """`matches` with signature and body of both sides, for reports.

    Ids that stand in very many matches are split by `lookup_join`, so no key gathers them in one task.
    """
    total = matches.count()
    for side, source in (("new", units if new_units is None else new_units), ("old", units)):
        held = matches.groupBy(f"{side}_id").agg(F.count("*").alias("_rows"))
        texts = source.select(F.col("unit_id").alias(f"{side}_id"), F.col("signature").alias(f"{side}_signature"), F.col("body").alias(f"{side}_body"))
        heavy = materialize(held.join(texts, f"{side}_id"), "match-texts")
        matches = lookup_join(matches, heavy, [f"{side}_id"], "_rows", total, TEXT_ROWS).drop("_rows")
    return matches


def match_units(
    corpus: DataFrame,
    new_units: DataFrame | None = None,
    changed_paths: DataFrame | None = None,
    measure: str = "jaccard_tokens",
    thresholds: Thresholds | None = None,
    allow_wide: bool = False,
    global_threshold: float = DEFAULT_THRESHOLD,
) -> DataFrame:
    """Directed matches (new unit, existing unit) whose score reaches the stricter threshold of the two paths.

    The new side is `new_units` (another table), or the corpus units under `changed_paths`, or the whole corpus. Units
    need a BIGINT `unit_id`, see `number_units`. `thresholds` may be a table (folder, threshold, pos) of any size; other
    paths then have `global_threshold`. Units without a body (NULL) have nothing to compare and match nothing:
    `validate_units` tells them apart. Low thresholds make the text measures compare almost every pair; a warning says so
    unless `allow_wide` is set.
    """
    index = build_index(corpus, measure, thresholds, allow_wide, global_threshold)
    if new_units is None and changed_paths is not None:
        new_units = corpus.join(changed_paths.select("file_path").distinct(), "file_path", "left_semi")
    if new_units is not None:
        return match_index(index, new_units)
    side = (index.units, index.classes, index.rows)
    return _expanded(_class_matches(index), side, side)


def match_classes(
    corpus: DataFrame, measure: str = "jaccard_tokens", thresholds: Thresholds | None = None, allow_wide: bool = False, global_threshold: float = DEFAULT_THRESHOLD
) -> tuple[DataFrame, DataFrame]:
    """`match_units` of a whole corpus without its expansion to copies: (pairs of classes, members).

    Units with equal features and threshold are a class, named by its smallest unit_id. `pairs` (new_id, old_id, similarity,
    threshold, confidence) has each two different classes that match, in either order; `members` (unit_id, file_path, class_id)
    has every unit with a body once. Copies make rows in proportion to their number, not to its square.
    """
    index = build_index(corpus, measure, thresholds, allow_wide, global_threshold)
    name = lambda cid: F.shiftright(cid, 1)  # noqa: E731  class ids are unit ids, twice
    # Unit ids may repeat, and class ids with them: only a class with itself has the same id and score 1.
    pairs = _class_matches(index).filter("new_cid <> old_cid OR similarity < 1").select(
        name("new_cid").alias("new_id"), name("old_cid").alias("old_id"), "similarity", "threshold", confidence(F.col("similarity")).alias("confidence")
    )
    held = index.classes.select("set_key", "t", "cid", "members")
    members = lookup_join(index.units, held, ["set_key", "t"], "members", index.rows)
    return pairs, members.select("unit_id", "file_path", name("cid").alias("class_id"))


def _class_matches(index: CorpusIndex) -> DataFrame:
    """Directed matches of the classes of an index with each other."""
    m, classes = index.measure, index.classes
    found = _equal_features(classes, classes, True)
    if index.floor < 1.0:
        pairs = (token_pairs if m.by_tokens else overlap_pairs)(index.prefix, index.prefix, m, index.floor, "once")
        if m.segments:
            pairs = pairs.unionByName(segment_pairs(classes, classes, m, index.floor, "once"))
        if m.symmetric:
            once = pairs.select(F.col("small_cid").alias("new_cid"), F.col("large_cid").alias("old_cid"), "threshold")
            scored = _scored([once], classes, classes, m).withColumnsRenamed({"new_cid": "small_cid", "old_cid": "large_cid"})
            found = found.unionByName(_both_ways(scored, "threshold", "similarity"))
        else:
            found = found.unionByName(_scored([_both_ways(pairs, "threshold")], classes, classes, m))
    if index.lowest == 0:
        found = found.unionByName(_zero_threshold(classes, classes, m))
    return found


def rank_order() -> list[Column]:
    """Best score first; ties by the keys of both units."""
    keys = ["new_path", "new_line_start", "new_name", "old_path", "old_line_start", "old_name"]
    return [F.col("similarity").desc(), *[F.col(k).asc() for k in keys]]


def rank_matches(matches: DataFrame) -> DataFrame:
    return matches.orderBy(*rank_order())
