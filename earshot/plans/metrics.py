"""The metric plan: one clip of the index, one join with the segments, one aggregation for all metrics and sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.functions.clock import DAY, circular_intersect, format_time, parse_time, time_ms
from earshot.functions.metrics import Rows, Wanted, resolve
from earshot.operators.clock import daily
from earshot.operators.interval import RANGE, REC, SEGMENT, range_join

UNITS = ("recording_filename", "session_id", "child_id", "experiment", "segments")


def turn_flags(segments: DataFrame, keys: Sequence[str], first: Sequence[str] = ("CHI",), second: Sequence[str] = ("FEM", "MAL", "OCH"), max_interval: int = 1000, min_delay: int = 0, name: str = "is_turn", order: Sequence[str] | None = None) -> DataFrame:
    """Whether a row takes the turn: the row before it, among the interlocutors', is a partner's, its end less than ``max_interval`` ms ago, its onset at least ``min_delay``.

    Rows are in order of row_no where there is one, else of time, within ``keys``. Rows of others stand aside.
    """
    a, b = F.col("speaker_type").isin(*first), F.col("speaker_type").isin(*second)
    takes_part = F.coalesce(a | b, F.lit(False))
    w = Window.partitionBy(*keys, takes_part).orderBy(*(order or (["row_no", SEGMENT[0]] if "row_no" in segments.columns else list(SEGMENT))))
    before = lambda c: F.lag(c).over(w)
    partner = (a & before("speaker_type").isin(*second)) | (b & before("speaker_type").isin(*first))
    flag = takes_part & partner & (F.col("segment_onset") - before("segment_offset") < max_interval) & (F.col("segment_onset") - before("segment_onset") >= min_delay)
    return segments.withColumn(name, F.coalesce(flag, F.lit(False)))


def _in_pandas(rows: DataFrame, w: Wanted, keys: Sequence[str]) -> DataFrame:
    """``keys`` and the value of a metric that is a function of a unit's rows."""
    apply, args, keys = w.metric.apply, {k: v for k, v in w.args.items() if k in w.metric.args}, list(keys)
    shape = T.StructType([*(rows.schema[k] for k in keys), T.StructField(w.name, T.DoubleType())])

    def task(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        value = apply(part, **args)
        return pd.DataFrame([[*key, None if value is None else float(value)]], columns=[*keys, w.name])

    return rows.groupBy(*keys).applyInPandas(task, shape)


def periods_of(period_ms: int | None, window: tuple[int, int] | None) -> list[tuple[int, int, int, int]]:
    """(period start, period end, start, stop) of each piece of the periods of a day that lies in the clock window; a last incomplete period is dropped."""
    cuts = [(0, 0)] if period_ms is None else [(i * period_ms, (i + 1) * period_ms % DAY) for i in range(DAY // period_ms)]
    return [(p[0], p[1], *piece) for p in cuts for piece in (circular_intersect(p, window) if window else [p])]


def extract(segments: DataFrame, index: DataFrame, recordings: DataFrame, metrics: Sequence[Mapping[str, object]], by: str = REC, *, period_ms: int | None = None, from_time: str | None = None, to_time: str | None = None, units: DataFrame | None = None, children: DataFrame | None = None, rec_cols: Sequence[str] = (), child_cols: Sequence[str] = (), bucket_ms: int | None = DAY) -> DataFrame:
    """One row for each unit (and period) with the annotated ms of each set, duration_<set>, and all ``metrics``.

    ``by`` is a column of ``recordings``, or "segments" with ``units`` having recording_filename, segment_onset and
    segment_offset. With ``period_ms`` a unit has one row for each period of the day; from_time and to_time restrict to a
    daily window. Segments are cut to the ranges left; those without length count where they lie inside one. Metrics are null
    where nothing is annotated. ``rec_cols`` are null unless unique in the unit; ``child_cols`` need ``children``. Segments meet
    ranges by set, recording and ``bucket_ms`` of time (None for the whole recording).
    """
    if by not in UNITS:
        raise ValueError(f"by is one of {UNITS}")
    if (from_time is None) != (to_time is None) or (by == "segments") != (units is not None):
        raise ValueError("from_time goes with to_time, and units with by='segments'")
    asked = resolve(metrics)
    sets = sorted({w.set for w in asked})
    segments = segments.where(F.col("set").isin(*sets))  # prunes the scan by set
    clocked = period_ms is not None or from_time is not None
    unit = [REC, "unit_onset", "unit_offset"] if by == "segments" else [by]
    about_rec = list(dict.fromkeys([REC, *([by] if by != "segments" else [])]))
    # start times are parsed once a recording: a projection would be evaluated again for each piece of each range
    rec = recordings.groupBy(*about_rec).agg(F.min(parse_time("start_time")).alias("_begins")) if clocked else recordings.select(*about_rec)
    base = index.where(F.col("set").isin(*sets)).select("set", REC, *RANGE).join(rec, REC)
    if by == "segments":
        these = units.select(REC, F.col("segment_onset").alias("unit_onset"), F.col("segment_offset").alias("unit_offset")).distinct()
        pairs = range_join(base, these.withColumns({"_u_on": F.col("unit_onset"), "_u_off": F.col("unit_offset")}), [REC], RANGE, ("_u_on", "_u_off"), bucket_ms)
        base = pairs.withColumns({"range_onset": F.col("overlap_onset"), "range_offset": F.col("overlap_offset")}).drop("overlap_onset", "overlap_offset")
    else:
        these = base.select(by).distinct()
    keys = unit
    if clocked:
        pieces = periods_of(period_ms, (time_ms(from_time), time_ms(to_time)) if from_time else None)
        clock = base.sparkSession.createDataFrame(pieces, "period_on bigint, period_off bigint, _start bigint, _stop bigint")
        grid = base.sparkSession.createDataFrame(periods_of(period_ms, None), "period_on bigint, period_off bigint, a bigint, b bigint").select("period_on", "period_off")
        base = daily(base.crossJoin(F.broadcast(clock)), F.col("_start"), F.col("_stop"), F.col("_begins"))
        if period_ms is not None:
            keys, these = [*unit, "period_on"], these.crossJoin(F.broadcast(grid))
    base = base.select("set", *dict.fromkeys([REC, *keys]), *RANGE)

    length = F.col("range_offset") - F.col("range_onset")
    annotated = base.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("set") == s, length)), F.lit(0)).alias(f"duration_{s}") for s in sets])
    joined = range_join(segments, base, ["set", REC], SEGMENT, RANGE, bucket_ms, points=True) if not {*unit, "period_on"} & {*segments.columns} - {REC} else None
    if joined is None:
        joined = range_join(segments.drop(*[c for c in (*unit, "period_on") if c != REC]), base, ["set", REC], SEGMENT, RANGE, bucket_ms, points=True)
    cut = joined.withColumns({"segment_onset": F.col("overlap_onset"), "segment_offset": F.col("overlap_offset"), "duration": F.col("overlap_offset") - F.col("overlap_onset")}).drop("overlap_onset", "overlap_offset")
    columns = {*cut.columns}

    def aggregated(rows: DataFrame, some: list[Wanted], keys: list[str]) -> DataFrame:
        """``keys`` and a raw value for each of ``some``."""
        for i, w in enumerate(some):
            if w.metric.turns:
                o = w.args
                rows = turn_flags(rows, list(dict.fromkeys([*keys, "set", REC])), o["interlocutors_1"], o["interlocutors_2"], o["max_interval"], o["min_delay"], f"_turn{i}")
        build = lambda i, w: w.build(Rows(F.col("set") == w.set, columns, F.col(f"_turn{i}")))
        return rows.groupBy(*keys).agg(*[build(i, w).alias(w.name) for i, w in enumerate(some)])

    out = these.join(annotated, keys, "left")
    plain = [w for w in asked if w.peak_ms is None and w.metric.apply is None]
    if plain:
        out = out.join(aggregated(cut, plain, keys), keys, "left")
    for w in (w for w in asked if w.metric.apply is not None):
        out = out.join(_in_pandas(cut.where(F.col("set") == w.set), w, keys), keys, "left")
    for period in sorted({w.peak_ms for w in asked if w.peak_ms is not None}):
        some = [w for w in asked if w.peak_ms == period]
        bucketed = aggregated(cut.withColumn("_bucket", F.floor(F.col("segment_onset") / period)), some, [*keys, "_bucket"])
        full = lambda w: F.floor(F.col(f"duration_{w.set}") / period)
        peaks = bucketed.join(annotated, keys).groupBy(*keys).agg(*[F.max(F.when(F.col("_bucket") < full(w), F.col(w.name))).alias(w.name) for w in some])
        out = out.join(peaks, keys, "left")

    def final(w: Wanted) -> Column:
        ms = F.col(f"duration_{w.set}")
        value = F.col(w.name)
        if w.metric.empty is not None:
            value = F.coalesce(value, F.lit(w.metric.empty))
        if w.peak_ms is not None:
            value = F.when(ms >= w.peak_ms, value)
            return (value * (3_600_000 / w.peak_ms) if w.per_hour else value).alias(w.name)
        return F.when(ms > 0, value * (F.lit(3_600_000.0) / ms) if w.per_hour else value).alias(w.name)

    about: list[Column] = []
    if period_ms is not None:
        about = [format_time(F.col("period_on"), True).alias("period_start"), format_time(F.col("period_off"), True).alias("period_end")]
    more = [c for c in ("child_id", *rec_cols) if c in recordings.columns and c not in unit] if by != "segments" else [c for c in ("child_id", *rec_cols) if c in recordings.columns]
    key = REC if by == "segments" else by
    if more:
        one = recordings.groupBy(key).agg(*[(F.min(c) if c == "child_id" else F.when((F.count_distinct(c) == 1) & (F.count(c) == F.count("*")), F.min(c))).alias(c) for c in more])
        out = out.join(one, key, "left")
    if child_cols:
        if children is None:
            raise ValueError("child_cols need children")
        out = out.join(children.select("child_id", *child_cols), "child_id", "left")
    shown = [F.col("unit_onset").alias("segment_onset"), F.col("unit_offset").alias("segment_offset")] if by == "segments" else []
    return out.select(key, *shown, *about, *more, *[c for c in child_cols], *[F.coalesce(f"duration_{s}", F.lit(0)).alias(f"duration_{s}") for s in sets], *[final(w) for w in asked])


def extract_spec(spec: Mapping[str, object], segments: DataFrame, index: DataFrame, recordings: DataFrame, **more) -> DataFrame:
    """``extract`` with the options of a specification: {metrics_list, by, period (ms), from, to, rec_cols, child_cols}."""
    names = lambda k: [c for c in str(spec.get(k) or "").split(",") if c]
    return extract(segments, index, recordings, spec["metrics_list"], str(spec.get("by", REC)), period_ms=spec.get("period"), from_time=spec.get("from"), to_time=spec.get("to"), rec_cols=names("rec_cols"), child_cols=names("child_cols"), **more)
