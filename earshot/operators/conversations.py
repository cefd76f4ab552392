"""Sessionisation of segments into conversations, and their summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.functions.features import IN_PANDAS, STANDARD, build
from earshot.operators.interval import REC, SEGMENT

SPEAKERS = ("CHI", "FEM", "MAL", "OCH")
#: Who may answer whom: everybody everybody, themselves included.
INTERACTIONS: dict[str, tuple[str, ...]] = {s: SPEAKERS for s in SPEAKERS}


def _order(df: DataFrame) -> list[str]:
    return ["row_no"] if "row_no" in df.columns else list(SEGMENT)


def conversation_ids(segments: DataFrame, interactions: Mapping[str, Sequence[str]] = INTERACTIONS, max_interval: int = 5000, min_delay: int = 0, keys: Sequence[str] = (REC,)) -> DataFrame:
    """Segments of the ``interactions``' speakers with iti, prev_speaker_type, delay, is_CT and conv_count.

    In order of row_no (or of time), a row is a turn, is_CT, if the one before is by a partner of its speaker, ended less than
    ``max_interval`` ms ago and began at least ``min_delay`` ms ago. A conversation begins at a row that is no turn and is
    followed by one; conv_count numbers the conversations of each of ``keys``, from 1, and is null outside of them. One window.
    """
    w = Window.partitionBy(*keys).orderBy(*_order(segments))
    mine = segments.where(F.col("speaker_type").isin(*interactions))
    partner = F.lit(False)
    for who, others in interactions.items():
        partner = partner | ((F.col("speaker_type") == who) & F.col("prev_speaker_type").isin(*others))
    out = mine.withColumns({"iti": F.col("segment_onset") - F.lag("segment_offset").over(w), "prev_speaker_type": F.lag("speaker_type").over(w), "delay": F.col("segment_onset") - F.lag("segment_onset").over(w)})
    out = out.withColumn("is_CT", F.coalesce(partner & (F.col("iti") < max_interval) & (F.col("delay") >= min_delay), F.lit(False)))
    starts = ~F.col("is_CT") & F.coalesce(F.lead("is_CT").over(w), F.lit(False))
    out = out.withColumn("_starts", starts).withColumn("_nth", F.sum(F.col("_starts").cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("conv_count", F.when(F.col("is_CT") | F.col("_starts"), F.col("_nth"))).drop("_starts", "_nth")


def summarise(segments: DataFrame, features: Sequence[Mapping[str, object]] = STANDARD, keys: Sequence[str] = (REC,)) -> DataFrame:
    """One row for each conversation: onset, offset, voc_count, interval_last_conv, and the features.

    ``segments`` has conv_count; rows without one are left out. interval_last_conv is the time since the last row of the
    conversation before, null for the first.
    """
    rows = segments.where("conv_count is not null")
    if "row_no" not in rows.columns:
        rows = rows.withColumn("row_no", F.row_number().over(Window.partitionBy(*keys).orderBy(*SEGMENT)))
    rows = rows.withColumn("voc_duration", F.col("segment_offset") - F.col("segment_onset"))
    slow = [f for f in features if f["callable"] in IN_PANDAS]
    named = dict(build(f) for f in features if f["callable"] not in IN_PANDAS)
    names = [str(f.get("name") or f["callable"]) for f in features]
    if len({*names}) != len(features):
        raise ValueError("features of the same name")
    first, last = F.min_by("segment_onset", "row_no"), F.max_by("segment_offset", "row_no")
    grouped = rows.groupBy(*keys, "conv_count").agg(first.alias("conversation_onset"), F.max("segment_offset").alias("conversation_offset"), F.count("speaker_type").alias("voc_count"), last.alias("_last"), *[c.alias(n) for n, c in named.items()])
    gap = F.col("conversation_onset") - F.lag("_last").over(Window.partitionBy(*keys).orderBy("conv_count"))
    out = grouped.withColumn("interval_last_conv", gap)
    for f in slow:
        out = out.join(_in_pandas(rows, f, [*keys, "conv_count"]), [*keys, "conv_count"], "left")
    return out.select(*keys, "conv_count", "conversation_onset", "conversation_offset", "voc_count", "interval_last_conv", *names)


def _in_pandas(rows: DataFrame, spec: Mapping[str, object], keys: list[str]) -> DataFrame:
    """``keys`` and the value of a feature that is a function of a conversation's rows."""
    (apply, kind), name = IN_PANDAS[str(spec["callable"])], str(spec.get("name") or spec["callable"])
    args = {k: v for k, v in spec.items() if k not in ("callable", "name")}

    def task(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, apply(part.sort_values("row_no"), **args)]], columns=[*keys, name])

    shape = T.StructType([*(rows.schema[k] for k in keys), T.StructField(name, T._parse_datatype_string(kind))])
    return rows.groupBy(*keys).applyInPandas(task, shape)


def with_metadata(summary: DataFrame, recordings: DataFrame, children: DataFrame | None = None, rec_cols: Sequence[str] = (), child_cols: Sequence[str] = ()) -> DataFrame:
    """A summary with columns of its recordings and children."""
    out = summary.join(recordings.select(REC, *dict.fromkeys(["child_id", *rec_cols])), REC, "left")
    return out.join(children.select("child_id", *child_cols), "child_id", "left") if children is not None and child_cols else out
