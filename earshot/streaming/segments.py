"""Segments as a stream: hourly counts and conversations with watermarks, written as they close."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(segments: DataFrame, lateness: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Vocalizations and their duration by recording, speaker and clock window of onset_time; rows later than ``lateness`` are dropped."""
    rows = segments.withWatermark("onset_time", lateness).groupBy("recording_filename", "speaker_type", F.window("onset_time", window))
    out = rows.agg(F.count("*").alias("voc"), F.sum(F.col("segment_offset") - F.col("segment_onset")).alias("voc_dur"))
    return out.select("recording_filename", "speaker_type", F.col("window.start").alias("window_start"), "voc", "voc_dur")


def sessions(segments: DataFrame, gap: str = "5 seconds", lateness: str = "1 hour") -> DataFrame:
    """Runs of segments of a recording whose onsets follow within ``gap``, by session windows."""
    rows = segments.withWatermark("onset_time", lateness).groupBy("recording_filename", F.session_window("onset_time", gap))
    out = rows.agg(F.count("*").alias("voc_count"), F.max("segment_offset").alias("segment_offset"))
    return out.select("recording_filename", F.col("session_window.start").alias("session_start"), "voc_count", "segment_offset")
