"""Interval algebra on half-open ranges of integer milliseconds, [onset, offset), within recordings.

Every operator shuffles on its key (the recording, as a rule) at most once for each input. Intervals without length are
dropped where they would have no part in the result.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REC = "recording_filename"
SEGMENT = ("segment_onset", "segment_offset")
RANGE = ("range_onset", "range_offset")
#: Characters of a recording's name by which ``collapse`` sums in groups.
GROUPED = 6
#: Beyond any recording.
FAR = 1 << 60


def clip(df: DataFrame, start: Column | int | str, stop: Column | int | str, cols: tuple[str, str] = SEGMENT, points: bool = False) -> DataFrame:
    """Clamp both ends to [start, stop] and keep what has a length, with ``points`` also what had none and lies between the bounds. A null bound makes a row vanish."""
    start, stop = (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x).cast("bigint") for x in (start, stop))
    on, off = cols
    # greatest and least skip nulls, so nulls are sorted out first
    whole = F.col(on).isNotNull() & F.col(off).isNotNull() & start.isNotNull() & stop.isNotNull()
    clamp = lambda c: F.greatest(F.least(F.col(c), stop), start)
    kept = F.col(off) > F.col(on)
    if points:
        kept = kept | ((F.col(off) == F.col(on)) & (F.col(on) > start) & (F.col(on) < stop))
    return df.where(whole).withColumns({on: clamp(on), off: clamp(off)}).where(kept)


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str] = (REC,), left_cols: tuple[str, str] = RANGE, right_cols: tuple[str, str] = RANGE, bucket_ms: int | None = None, points: bool = False) -> DataFrame:
    """All pairs with equal ``keys`` that overlap by more than a point, with the overlap in overlap_onset and overlap_offset.

    The result has the columns of ``left``, then those of ``right`` but for the keys and its range. Other clashing names raise
    an error. Spark joins on the keys and tests the overlap within the join. Where the keys are few for the rows,
    ``bucket_ms`` also makes the time an equi key: each side is repeated for each bucket that it touches, and a pair is kept
    in the bucket in which its overlap begins, once. With ``points`` rows of ``left`` without length take part as well, where they
    lie inside a range and not at its ends.
    """
    (lo, lf), (ro, rf) = left_cols, right_cols
    keys = list(keys)
    if clash := {*left.columns} & {c for c in right.columns if c not in (*keys, ro, rf)}:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    rest = [c for c in right.columns if c not in (*keys, ro, rf)]
    r = right.select(*keys, *rest, F.col(ro).alias("_r_on"), F.col(rf).alias("_r_off")).where("_r_off > _r_on")
    l = left.where(F.col(lf) >= F.col(lo) if points else F.col(lf) > F.col(lo))  # noqa: E741
    on = keys
    if bucket_ms:
        spread = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket_ms), F.floor(F.greatest(F.col(b) - 1, F.col(a)) / bucket_ms)))
        l, r, on = l.withColumn("_bucket", spread(lo, lf)), r.withColumn("_bucket", spread("_r_on", "_r_off")), [*keys, "_bucket"]  # noqa: E741
    both = l.join(r, on).where((F.col(lo) < F.col("_r_off")) & (F.col("_r_on") < F.col(lf)))
    out = both.withColumns({"overlap_onset": F.greatest(F.col(lo), F.col("_r_on")), "overlap_offset": F.least(F.col(lf), F.col("_r_off"))})
    if bucket_ms:
        out = out.where(F.floor(F.col("overlap_onset") / bucket_ms) == F.col("_bucket"))
    return out.select(*left.columns, *rest, "overlap_onset", "overlap_offset")


def cut_to(left: DataFrame, right: DataFrame, keys: Sequence[str] = (REC,), cols: tuple[str, str] = RANGE, right_cols: tuple[str, str] = RANGE, bucket_ms: int | None = None) -> DataFrame:
    """``left`` cut to each range of ``right`` that it overlaps, with left's columns."""
    bounds = right.select(*keys, *right_cols)
    joined = range_join(left, bounds, keys, cols, right_cols, bucket_ms)
    return joined.withColumns({cols[0]: F.col("overlap_onset"), cols[1]: F.col("overlap_offset")}).select(*left.columns)


def intersect_sets(index: DataFrame, sets: Sequence[str], bucket_ms: int | None = None) -> DataFrame:
    """The index rows of all ``sets``, cut to the time that every one of them annotates.

    A recording that lacks one of the sets has no rows. One set gives its own rows.
    """
    of = [index.where(F.col("set") == s).select(REC, *RANGE) for s in sets]
    common = reduce(lambda a, b: cut_to(a, b, bucket_ms=bucket_ms), of)
    return cut_to(index.where(F.col("set").isin(*sets)), common, bucket_ms=bucket_ms)


def within_ranges(index: DataFrame, ranges: DataFrame, sets: Sequence[str] | None = None, missing_data: str = "ignore", bucket_ms: int | None = None) -> DataFrame:
    """Index rows cut to the wanted ranges of their recordings.

    missing_data: "ignore", or "warn" or "raise" if a set covers less of a recording than is wanted; ``coverage`` gives the figures.
    """
    if missing_data not in ("ignore", "warn", "raise"):
        raise ValueError("missing_data is ignore, warn or raise")
    rows = index if sets is None else index.where(F.col("set").isin(*sets))
    if missing_data != "ignore" and (bad := coverage(rows, ranges).where("covered < requested").first()) is not None:
        text = f"annotations from set '{bad['set']}' do not cover recording '{bad[REC]}': covered {bad['covered'] / 1000:.3f} s of {bad['requested'] / 1000:.3f} s"
        if missing_data == "raise":
            raise ValueError(text)
        warnings.warn(text, stacklevel=2)
    return cut_to(rows, ranges, bucket_ms=bucket_ms)


def coverage(index: DataFrame, ranges: DataFrame) -> DataFrame:
    """For each recording that has wanted ranges, and each set of the index: requested and covered ms."""
    length = lambda a, b: F.sum(F.col(b) - F.col(a))
    wanted = ranges.groupBy(REC).agg(length(*RANGE).alias("requested"))
    covered = cut_to(index.select("set", REC, *RANGE), ranges).groupBy("set", REC).agg(length(*RANGE).alias("covered"))
    pairs = wanted.crossJoin(index.select("set").distinct())
    return pairs.join(covered, ["set", REC], "left").select(REC, "set", "requested", F.coalesce("covered", F.lit(0)).alias("covered"))


def overlap_flags(df: DataFrame, keys: Sequence[str] = (REC,), cols: tuple[str, str] = SEGMENT, name: str = "overlaps") -> DataFrame:
    """Whether another row of equal ``keys`` overlaps this one: the greatest offset before it, or the next onset, tells.

    Rows of no or negative length overlap nothing and hide nothing.
    """
    on, off = cols
    real = F.coalesce(F.col(off) > F.col(on), F.lit(False))
    order = Window.partitionBy(*keys, real).orderBy(on, off)
    before = F.max(off).over(order.rowsBetween(Window.unboundedPreceding, -1)) > F.col(on)
    after = F.lead(on).over(order) < F.col(off)
    return df.withColumn(name, real & (F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))))


def merge_ranges(df: DataFrame, keys: Sequence[str] = (REC,), cols: tuple[str, str] = RANGE) -> DataFrame:
    """The union of the ranges of equal keys: overlapping and touching ones become one."""
    on, off = cols
    order = Window.partitionBy(*keys).orderBy(on, off)
    before = F.max(off).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.where(F.col(off) > F.col(on)).withColumn("_new", F.when(before >= F.col(on), 0).otherwise(1))
    grouped = marked.withColumn("_island", F.sum("_new").over(order)).groupBy(*keys, "_island")
    return grouped.agg(F.min(on).alias(on), F.max(off).alias(off)).drop("_island")


def subtract_others(segments: DataFrame, id_col: str, keys: Sequence[str] = (REC,), cols: tuple[str, str] = SEGMENT) -> DataFrame:
    """Each segment without the time of any other segment of equal keys: none, one or several pieces of it.

    A sweep over the bounds: the piece between two bounds belongs to a single segment where the running count is 1, and the
    running sum of ids is then its id. No pairs are formed. ``id_col`` is unique among rows of equal keys.
    """
    on, off = cols
    real = segments.where(F.col(off) > F.col(on))
    ident = F.col(id_col).cast("decimal(38,0)")
    bound = lambda sign, at: F.struct(F.col(at).alias("t"), F.lit(sign).alias("n"), (ident * sign).alias("owner"))
    bounds = real.select(*keys, F.explode(F.array(bound(1, on), bound(-1, off))).alias("b")).select(*keys, "b.*")
    steps = bounds.groupBy(*keys, "t").agg(F.sum("n").alias("n"), F.sum("owner").alias("owner")).where("n != 0 or owner != 0")
    order = Window.partitionBy(*keys).orderBy("t")
    swept = steps.select(*keys, F.col("t").alias("_on"), F.lead("t").over(order).alias("_off"), F.sum("n").over(order).alias("_n"), F.sum("owner").over(order).alias("_owner"))
    pieces = swept.where("_n = 1").select(*keys, F.col("_owner").cast("bigint").alias(id_col), "_on", "_off")
    return real.join(pieces, [*keys, id_col]).withColumns({on: F.col("_on"), off: F.col("_off")}).select(*segments.columns)


def exclude(sampled: DataFrame, excluded: DataFrame, keys: Sequence[str] = (REC,), cols: tuple[str, str] = SEGMENT) -> DataFrame:
    """The distinct sampled ranges without the excluded time; keys and range only."""
    on, off = cols
    wanted = sampled.select(*keys, *cols).where(F.col(off) > F.col(on)).distinct()
    gone = merge_ranges(excluded.select(*keys, *cols), keys, cols)
    order = Window.partitionBy(*keys).orderBy(on)
    before = gone.select(*keys, F.coalesce(F.lag(off).over(order), F.lit(-FAR)).alias("_g_on"), F.col(on).alias("_g_off"))
    last = gone.groupBy(*keys).agg(F.max(off).alias("_g_on")).withColumn("_g_off", F.lit(FAR))
    free = before.unionByName(last)
    touched = cut_to(wanted, free, keys, cols, ("_g_on", "_g_off"))
    return touched.unionByName(wanted.join(gone.select(*keys).distinct(), [*keys], "left_anti"))


def collapse(segments: DataFrame, index: DataFrame) -> DataFrame:
    """Move segments to one timeline for each set, on which the set's annotated ranges follow on one another without gaps.

    Ranges are in order of recording and onset. Their positions are summed in three steps, groups of recordings with the same
    first GROUPED characters first, so that no single task holds all recordings or ranges of a set. ``segments`` has set, recording and the range that a segment lies in.
    """
    ranges = index.select("set", REC, *RANGE).distinct().withColumn("_len", F.col("range_offset") - F.col("range_onset"))
    total = ranges.groupBy("set", REC).agg(F.sum("_len").alias("_total"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # first the totals of groups of recordings with the same beginning of their names, then within each group
    head = F.substring(REC, 1, GROUPED)
    of_head = earlier(Window.partitionBy("set").orderBy("_head"))
    heads = total.groupBy("set", head.alias("_head")).agg(F.sum("_total").alias("_all")).select("set", "_head", F.coalesce(F.sum("_all").over(of_head), F.lit(0)).alias("_before"))
    in_head = earlier(Window.partitionBy("set", "_head").orderBy(REC))
    starts = total.withColumn("_head", head).join(heads, ["set", "_head"]).select("set", REC, (F.col("_before") + F.coalesce(F.sum("_total").over(in_head), F.lit(0))).alias("_start"))
    of_rec = earlier(Window.partitionBy("set", REC).orderBy(*RANGE))
    placed = ranges.withColumn("_within", F.coalesce(F.sum("_len").over(of_rec), F.lit(0))).join(starts, ["set", REC])
    at = placed.select("set", REC, *RANGE, (F.col("_start") + F.col("_within")).alias("position"))
    moved = segments.join(at, ["set", REC, *RANGE])
    return moved.withColumns({c: F.col(c) - F.col("range_onset") + F.col("position") for c in SEGMENT})


def merge_sets(left: DataFrame, right: DataFrame, left_columns: Sequence[str], right_columns: Sequence[str], keys: Sequence[str] = (REC, *RANGE)) -> DataFrame:
    """Full outer merge of two sets' segments on recording, range and segment bounds.

    Of each side the named columns are taken; where a side has no such segment they are "NA". raw_filename holds both names,
    joined by a comma. Sides are matched by the values of their ranges.
    """
    on = [*keys, *SEGMENT]
    if clash := {*left_columns} & {*right_columns}:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    side = lambda df, cols, raw: df.select(*on, *cols, *([F.col("raw_filename").alias(raw)] if "raw_filename" in df.columns else [F.lit(None).cast("string").alias(raw)]))
    both = side(left, left_columns, "_raw_left").join(side(right, right_columns, "_raw_right"), on, "full_outer")
    fill = [F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in (*left_columns, *right_columns)]
    return both.select(*on, *fill, F.concat_ws(",", "_raw_left", "_raw_right").alias("raw_filename"))
