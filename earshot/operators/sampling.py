"""Samplers of recording time: every one gives recording_filename, segment_onset and segment_offset."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.operators.interval import REC, SEGMENT


def _top(df: DataFrame, unit: str, count: int, *order: Column) -> DataFrame:
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(unit).orderBy(*order))).where(F.col("_nth") <= count).drop("_nth")


def periodic(recordings: DataFrame, length: int, period: int, offset: int = 0, by: str = REC) -> DataFrame:
    """A window of ``length`` ms, then a gap of ``period`` ms, and so on over the timeline of each unit, cut to its recordings.

    ``recordings`` has duration and, unless each is a unit, start_ts (ms on a timeline of the unit). The first window begins
    ``offset`` ms after the unit's start.
    """
    if length <= 0 or period < 0:
        raise ValueError("length is positive and period not negative")
    rec = recordings.select(REC, *([by] if by != REC else []), "duration", (F.col("start_ts") if by != REC else F.lit(0).cast("bigint")).alias("_from")).where("duration > 0")
    rec = rec.withColumn("_to", F.col("_from") + F.col("duration"))
    bounds = rec.groupBy(by).agg((F.min("_from") + offset).alias("_begin"), F.max("_to").alias("_end")).where("_begin < _end")
    # the slots that a recording meets follow from arithmetic: no unit's whole grid is laid out
    step = length + period
    low, high = F.ceil((F.col("_from") - F.col("_begin") - length + 1) / step), F.floor((F.col("_to") - 1 - F.col("_begin")) / step)
    met = rec.join(bounds, by).withColumns({"_low": F.greatest(low, F.lit(0)), "_high": high}).where("_low <= _high")
    slots = met.select(REC, "duration", "_from", "_begin", F.explode(F.sequence("_low", "_high")).alias("_k")).withColumn("_slot", F.col("_begin") + F.col("_k") * step)
    on, off = F.greatest(F.col("_slot") - F.col("_from"), F.lit(0)), F.least(F.col("_slot") + length - F.col("_from"), F.col("duration"))
    return slots.select(REC, on.cast("bigint").alias("segment_onset"), off.cast("bigint").alias("segment_offset"))


def random_vocalizations(segments: DataFrame, n: int, speakers: Sequence[str] | None = None, by: str = REC, seed: int = 0) -> DataFrame:
    """``n`` segments of each unit, drawn without replacement by a seeded hash, so that a recomputed task draws the same."""
    rows = segments if speakers is None else segments.where(F.col("speaker_type").isin(*speakers))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), REC, *[F.col(c).cast("string") for c in (*SEGMENT, *(["row_no"] if "row_no" in rows.columns else []))]))
    return _top(rows, by, n, key, F.col(REC), *map(F.col, SEGMENT)).select(REC, *SEGMENT)


def switches(segments: DataFrame, gap: int = 1000, keys: Sequence[str] = (REC,), name: str = "switch") -> DataFrame:
    """Rows where speech passes between the child and another within ``gap`` ms, in order of time, and the time since the row before, _iti."""
    w = Window.partitionBy(*keys).orderBy(*SEGMENT, *(["row_no"] if "row_no" in segments.columns else []))
    child = F.col("speaker_type") == "CHI"
    out = segments.withColumns({"_iti": F.col("segment_onset") - F.lag("segment_offset").over(w), "_was": F.lag(child).over(w), "_is": child})
    return out.withColumn(name, F.coalesce((F.col("_iti") < gap) & (F.col("_was") != F.col("_is")), F.lit(False))).drop("_was", "_is")


def high_volubility(segments: DataFrame, metric: str, length: int, count: int, speakers: Sequence[str] = ("FEM", "MAL", "CHI", "OCH"), by: str = REC) -> DataFrame:
    """The ``count`` windows of ``length`` ms of each unit with the most words, turns or vocalizations (metric: words, turns, vocs).

    A segment belongs to the window in which it ends; a window reaches from its segments' first onset to their last offset.
    Ties go by recording and onset.
    """
    rows = segments.withColumn("_chunk", F.floor(F.col("segment_offset") / length) + 1)
    whose = F.col("speaker_type").isin(*speakers)
    if metric == "words":
        score = F.sum(F.when(whose, F.col("words")))
    elif metric == "turns" and "lena_conv_turn_type" in rows.columns:
        score = F.count(F.when(whose & F.col("lena_conv_turn_type").isin("TIFR", "TIMR"), 1))
    elif metric == "turns":
        rows = switches(rows.withColumn("_whose", F.coalesce(whose, F.lit(False))), 1000, (REC, "_whose"))
        score = F.count(F.when(F.col("_whose") & F.col("switch"), 1))
    elif metric == "vocs":
        score = F.sum(F.when(whose, F.col("utterances_count"))) if "utterances_count" in rows.columns else F.count(F.when(whose, 1))
    else:
        raise ValueError("metric is words, turns or vocs")
    unit = list(dict.fromkeys([by, REC]))
    chunks = rows.groupBy(*unit, "_chunk").agg(F.min("segment_onset").alias("segment_onset"), F.max("segment_offset").alias("segment_offset"), score.alias("_score"), F.count(F.when(whose, 1)).alias("_n")).where("_n > 0")
    return _top(chunks, by, count, F.col("_score").desc_nulls_last(), F.col(REC), F.col("segment_onset")).select(REC, *SEGMENT)


def top_conversations(segments: DataFrame, count: int, interval: int = 1000, speakers: Sequence[str] = ("FEM", "MAL", "CHI"), by: str = REC, reset: bool = False) -> DataFrame:
    """The ``count`` chains of each unit with the most switches between the child and others; a chain ends where ``interval`` ms pass.

    The first row of a chain counts as a switch where its speaker's side changes, unless ``reset``.
    """
    rows = segments.where(F.col("speaker_type").isin(*speakers))
    w = Window.partitionBy(REC).orderBy(*SEGMENT, *(["row_no"] if "row_no" in segments.columns else []))
    child = F.col("speaker_type") == "CHI"
    gap = F.col("segment_onset") - F.lag("segment_offset").over(w)
    rows = rows.withColumns({"_break": (gap > interval).cast("int"), "_switch": F.coalesce(F.lag(child).over(w) != child, F.lit(False))})
    if reset:
        rows = rows.withColumn("_switch", F.col("_switch") & (F.coalesce("_break", F.lit(1)) == 0))
    rows = rows.withColumns({"_chain": F.sum(F.coalesce("_break", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_at": F.row_number().over(w)})
    chains = rows.groupBy(*dict.fromkeys([by, REC]), "_chain").agg(F.min_by("segment_onset", "_at").alias("segment_onset"), F.max_by("segment_offset", "_at").alias("segment_offset"), F.count(F.when(F.col("_switch"), 1)).alias("_turns"))
    return _top(chains, by, count, F.col("_turns").desc(), F.col(REC), F.col("segment_onset")).select(REC, *SEGMENT)


def window_energy(signals: DataFrame, rate: int, length: int, spacing: int, offset: int = 0, low: float | None = None, high: float | None = None) -> DataFrame:
    """The energy of each window of ``length`` ms, every ``spacing`` ms, of recordings' samples (recording_filename, channel, samples array).

    Mean square of the samples, or of their spectrum between ``low`` and ``high`` Hz, summed over the channels.
    """
    size, step, start = (int(x * rate / 1000) for x in (length, spacing, offset))
    if size <= 0 or step <= 0:
        raise ValueError("windows and spacing hold at least one sample")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rec, samples in zip(batch[REC], batch["samples"]):
                x = np.asarray(samples if samples is not None else [], np.float64)
                for a in range(start, len(x) - size + 1, step):
                    part = x[a : a + size]
                    if low is not None or high is not None:
                        f = np.fft.rfftfreq(size, 1 / rate)
                        band = (f >= (low or 0)) & (f <= (high if high is not None else rate))
                        energy = float((np.abs(np.fft.rfft(part)[band]) ** 2).sum() / size)
                    else:
                        energy = float((part**2).sum() / size)
                    out.append((rec, round(a * 1000 / rate), round((a + size) * 1000 / rate), energy))
            yield pd.DataFrame(out, columns=[REC, *SEGMENT, "energy"])

    each = signals.select(REC, "samples").mapInPandas(task, f"{REC} string, segment_onset bigint, segment_offset bigint, energy double")
    return each.groupBy(REC, *SEGMENT).agg(F.sum("energy").alias("energy"))


def above_quantile(windows: DataFrame, threshold: float, by: str = REC, value: str = "energy") -> DataFrame:
    """The windows of at least the unit's ``threshold`` quantile (exact, linear between ranks)."""
    least = windows.groupBy(by).agg(F.percentile(value, threshold).alias("_least"))
    return windows.join(least, by).where(F.col(value) >= F.col("_least")).drop("_least")


def energy_detection(windows: DataFrame, count: int, threshold: float = 0.8, by: str = REC, seed: int = 0) -> DataFrame:
    """``count`` windows of each unit, drawn from those of at least its ``threshold`` quantile of energy."""
    return random_vocalizations(above_quantile(windows, threshold, by), count, None, by, seed).distinct()


def chunks(segments: DataFrame, length: int, min_amount: int = 1) -> DataFrame:
    """Pad each segment evenly to whole chunks of ``length`` ms, at least ``min_amount``, and cut it into them; those that begin before 0 are skipped."""
    span = F.col("segment_offset") - F.col("segment_onset")
    target = F.greatest(F.ceil(span / length), F.lit(min_amount)) * length
    pad = (target - span) / 2
    toward_zero = lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("bigint")
    padded = segments.withColumns({"_on": toward_zero(F.col("segment_onset") - pad), "_target": target.cast("bigint")}).where("_on >= 0")
    at = F.explode(F.sequence(F.col("_on"), F.col("_on") + F.col("_target") - length, F.lit(length).cast("bigint")))
    return padded.withColumn("onset", at).withColumn("offset", F.col("onset") + length).drop("_on", "_target")
