"""Restriction to times of day, and clock times of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions.clock import DAY, format_time, parse_time
from earshot.operators.interval import RANGE, REC


def daily(df: DataFrame, start: Column, stop: Column, begins: Column, cols: tuple[str, str] = RANGE) -> DataFrame:
    """Each range cut to every daily occurrence of the clock window from ``start`` to ``stop``; one row for each day that it meets.

    ``begins`` is the time of day at ms 0 of the recording. A window with start > stop wraps midnight, and one with start ==
    stop is the whole day.
    """
    on, off = cols
    length = F.when(stop > start, stop - start).otherwise(stop - start + DAY)
    days = F.explode(F.sequence(F.floor((F.col(on) + begins) / DAY) - 1, F.floor((F.col(off) + begins) / DAY)))
    opened = df.where((F.col(off) > F.col(on)) & begins.isNotNull() & start.isNotNull() & stop.isNotNull()).withColumn("_day", days)
    from_ = F.col("_day") * DAY + start - begins
    cut = opened.withColumns({"_w_on": F.greatest(F.col(on), from_), "_w_off": F.least(F.col(off), from_ + length)}).where("_w_off > _w_on")
    return cut.withColumns({on: F.col("_w_on"), off: F.col("_w_off")}).drop("_day", "_w_on", "_w_off")


def within_time_range(index: DataFrame, recordings: DataFrame, start: int, stop: int) -> DataFrame:
    """Index rows cut to a daily clock window, with range_onset_time and range_offset_time as HH:MM. Recordings without a readable start time have no rows."""
    # aggregated, so that start times are parsed once a recording and not again for each piece
    begins = recordings.groupBy(REC).agg(F.min(parse_time("start_time")).alias("_begins"))
    lit = lambda x: F.lit(x).cast("bigint")
    rows = daily(index.join(begins, REC), lit(start), lit(stop), F.col("_begins"))
    clock = lambda c: format_time(F.col(c) + F.col("_begins"))
    return rows.withColumns({"range_onset_time": clock("range_onset"), "range_offset_time": clock("range_offset")}).select(*index.columns, "range_onset_time", "range_offset_time")


def segment_timestamps(segments: DataFrame, recordings: DataFrame, ignore_date: bool = False) -> DataFrame:
    """onset_time and offset_time of each segment, from the date and start time of its recording; null where these can't be read.

    With ``ignore_date`` the day of each recording is 1900-01-01.
    """
    day = F.lit("1900-01-01").cast("date") if ignore_date else F.col("date_iso").try_cast("date")
    base = recordings.select(REC, (F.unix_millis(day.cast("timestamp")) + parse_time("start_time")).alias("_base"))
    at = lambda c: F.timestamp_millis(F.col("_base") + F.col(c))
    return segments.join(base, REC, "left").withColumns({"onset_time": at("segment_onset"), "offset_time": at("segment_offset")}).drop("_base")
