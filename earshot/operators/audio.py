"""Operators on tables of samples (see ``sources.audio``): energies, silencing, channels, pitch and loudness."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.operators.interval import RANGE, REC, SEGMENT, range_join
from earshot.sources.audio import SIGNAL

ACOUSTICS = ("mean_pitch_semitone", "median_pitch_semitone", "p5_pitch_semitone", "p95_pitch_semitone", "pitch_range_semitone", "mean_abs_amp", "peak_abs_amp")


def whole(signal: DataFrame) -> DataFrame:
    """Each channel's blocks as one array: for clips, not for day-long recordings."""
    rows = F.array_sort(F.collect_list(F.struct("start_sample", "samples")))
    return signal.groupBy(REC, "channel", "rate").agg(F.flatten(F.transform(rows, lambda r: r["samples"])).alias("samples"))


def vet(signal: DataFrame, ranges: DataFrame) -> DataFrame:
    """The samples with silence inside ``ranges``."""
    at = ranges.groupBy(REC).agg(F.collect_list(F.struct(*RANGE)).alias("_r"))
    both = signal.join(at, REC, "left")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x, start, rate, spans in zip(batch["samples"], batch["start_sample"], batch["rate"], batch["_r"]):
                x = np.array(x, np.float32)
                for s in spans if spans is not None else []:
                    a, b = (int(s[c]) * int(rate) // 1000 - int(start) for c in RANGE)
                    x[max(0, a) : max(0, b)] = 0
                out.append(x)
            yield batch.drop(columns="_r").assign(samples=out)

    return both.select(*signal.columns, "_r").mapInPandas(task, SIGNAL)


def map_channels(signal: DataFrame, matrix: Sequence[Sequence[float]]) -> DataFrame:
    """New channels, each a weighted sum of the old ones: a row of ``matrix`` for each, a weight for each old channel."""
    weights = [[float(w) for w in row] for row in matrix]

    def task(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("channel")
        x = np.stack([np.asarray(s, np.float64) for s in rows["samples"]])
        if any(len(w) != len(x) for w in weights):
            raise ValueError(f"{key[0]} has {len(x)} channels")
        y = (np.array(weights) @ x).astype(np.float32)
        return pd.DataFrame({REC: key[0], "channel": np.arange(len(y), dtype=np.int32), "rate": rows["rate"].iloc[0], "start_sample": key[1], "samples": list(y)})

    return signal.groupBy(REC, "start_sample").applyInPandas(task, SIGNAL)


def pitch(x: np.ndarray, rate: int, low: float = 70.0, high: float = 800.0, window_ms: int = 46, threshold: float = 0.1) -> np.ndarray:
    """The fundamental frequency of each half-overlapping window, by the cumulative mean normalised difference function."""
    n = max(2 * int(rate / low) + 2, int(rate * window_ms / 1000))
    near, far = max(1, int(rate / high)), int(rate / low) + 1
    out = []
    for a in range(0, len(x) - n + 1, n // 2):
        w = x[a : a + n].astype(np.float64)
        half = n - far
        size = 1 << (2 * n - 1).bit_length()
        cross = np.fft.irfft(np.fft.rfft(w, size) * np.conj(np.fft.rfft(w[:half], size)), size)[: far + 1]
        power = np.concatenate([[0.0], np.cumsum(w * w)])
        d = power[half] + (power[half : half + far + 1] - power[: far + 1]) - 2 * cross
        d[0] = 0
        running = np.cumsum(d[1:])
        norm = np.ones(far + 1)
        norm[1:] = np.where(running > 1e-12, d[1:] * np.arange(1, far + 1) / np.maximum(running, 1e-12), 1)
        below = np.flatnonzero(norm[near:far] < threshold)
        if len(below):
            t = near + int(below[0])
            while t + 1 < far and norm[t + 1] < norm[t]:
                t += 1
        else:
            t = near + int(np.argmin(norm[near:far]))
        left, mid, right = norm[t - 1], norm[t], norm[min(t + 1, far)]
        bend = left - 2 * mid + right
        out.append(rate / (t + ((left - right) / (2 * bend) if abs(bend) > 1e-12 else 0.0)))
    return np.array(out)


def acoustics(segments: DataFrame, signal: DataFrame) -> DataFrame:
    """Pitch in semitones above 50 Hz (mean, median, 5th and 95th percentile, range) and amplitude (mean of absolute values, peak) of each segment.

    Channels are averaged. Blocks of samples meet their segments by time, so only what lies in a segment is brought together.
    Null where a segment has no samples; pitch is null where it is too short for a window.
    """
    names = segments.columns
    keyed = segments.withColumn("_key", F.monotonically_increasing_id())
    blocks = signal.withColumns({"_on": F.floor(F.col("start_sample") * 1000 / F.col("rate")), "_off": F.ceil((F.col("start_sample") + F.size("samples")) * 1000 / F.col("rate"))})
    pairs = range_join(keyed.select("_key", REC, *SEGMENT), blocks, [REC], SEGMENT, ("_on", "_off"))

    def task(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rate = int(rows["rate"].iloc[0])
        a, b = (int(rows[c].iloc[0]) * rate // 1000 for c in SEGMENT)
        channels = []
        for _, part in rows.sort_values("start_sample").groupby("channel"):
            channels.append(np.concatenate([np.asarray(s, np.float64)[max(0, a - start) : max(0, b - start)] for s, start in zip(part["samples"], part["start_sample"])]))
        x = np.mean(channels, axis=0)
        f = 12 * np.log2(pitch(x, rate) / 50)
        values = [f.mean(), np.median(f), *np.percentile(f, [5, 95]), np.ptp(np.percentile(f, [5, 95]))] if len(f) else [None] * 5
        return pd.DataFrame([[key[0], *values, np.abs(x).mean() if len(x) else None, x.max() if len(x) else None]], columns=["_key", *ACOUSTICS])

    found = pairs.groupBy("_key").applyInPandas(task, "_key bigint, " + ", ".join(f"{c} double" for c in ACOUSTICS))
    return keyed.join(found, "_key", "left").select(*names, *ACOUSTICS)


def compare(signal: DataFrame, first: str, second: str) -> DataFrame:
    """The mean absolute difference of two recordings' samples, times 1000, and how many were compared: one row."""
    side = lambda who, name: signal.where(F.col(REC) == who).select("channel", "start_sample", F.col("samples").alias(name))
    both = side(first, "a").join(side(second, "b"), ["channel", "start_sample"])
    each = both.select(F.zip_with("a", "b", lambda x, y: F.abs(x.cast("double") - y.cast("double"))).alias("d")).select(F.explode("d").alias("d"))
    return each.agg((F.avg("d") * 1000).alias("difference"), F.count("d").alias("samples"))


def clips(signal: DataFrame, segments: DataFrame) -> DataFrame:
    """A signal for each segment, named <recording>_<onset>_<offset>.wav: what ``write_wav`` writes as a file each."""
    blocks = signal.withColumns({"_on": F.floor(F.col("start_sample") * 1000 / F.col("rate")), "_off": F.ceil((F.col("start_sample") + F.size("samples")) * 1000 / F.col("rate"))})
    both = range_join(segments.select(REC, *SEGMENT).distinct(), blocks, [REC], SEGMENT, ("_on", "_off"))
    low, high = (F.floor(F.col(c) * F.col("rate") / 1000) for c in SEGMENT)
    begin = F.greatest(low - F.col("start_sample"), F.lit(0))
    stop = F.least(high - F.col("start_sample"), F.size("samples").cast("bigint"))
    name = F.concat(F.regexp_replace(REC, r"\.[^./]*$", ""), F.lit("_"), SEGMENT[0], F.lit("_"), SEGMENT[1], F.lit(".wav"))
    part = F.slice("samples", (begin + 1).cast("int"), F.greatest(stop - begin, F.lit(0)).cast("int"))
    return both.select(name.alias(REC), "channel", "rate", (F.col("start_sample") + begin - low).alias("start_sample"), part.alias("samples")).where(F.size("samples") > 0)
