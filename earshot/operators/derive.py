"""Derived annotations, and the registry of derivations."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.operators.conversations import SPEAKERS, conversation_ids
from earshot.operators.interval import RANGE, REC, SEGMENT, clip, subtract_others


def remove_overlaps(segments: DataFrame, speakers: Sequence[str] = SPEAKERS, keys: Sequence[str] = (REC,), id_col: str = "row_no") -> DataFrame:
    """The segments of ``speakers`` without the time in which another of these segments goes on too."""
    return subtract_others(segments.where(F.col("speaker_type").isin(*speakers)), id_col, keys)


def cva(segments: DataFrame, scenario: str = "R", max_interval: int = 5000, keys: Sequence[str] = (REC,)) -> DataFrame:
    """speaker_class (C for the child, O for others) and cva, whether others' speech is addressed to the child: Y, N, or NA on the child's own rows.

    R: Y if the child's speech is next to it, before or after, within ``max_interval`` ms. P: Y next to the child's speech at
    any gap; between others the nearer neighbour within the interval decides (the later one on a tie): Y if of the same type,
    N if not; Y with no neighbour within it.
    """
    if scenario not in ("R", "P"):
        raise ValueError("scenario is R or P")
    w = Window.partitionBy(*keys).orderBy("row_no" if "row_no" in segments.columns else SEGMENT[0])
    prev, following = F.lag("speaker_type").over(w), F.lead("speaker_type").over(w)
    before = F.col("segment_onset") - F.lag("segment_offset").over(w)
    after = F.lead("segment_onset").over(w) - F.col("segment_offset")
    parts = segments.withColumns({"_prev": prev, "_next": following, "_before": before, "_after": after})
    sure = lambda c: F.coalesce(c, F.lit(False))
    same = lambda c: F.when(sure(F.col(c) == F.col("speaker_type")), "Y").otherwise("N")
    child = sure(F.col("speaker_type") == "CHI")
    if scenario == "R":
        near = sure((F.col("_prev") == "CHI") & (F.col("_before") <= max_interval)) | sure((F.col("_next") == "CHI") & (F.col("_after") <= max_interval))
        value = F.when(child, "NA").when(near, "Y").otherwise("N")
    else:
        b, a = sure(F.abs("_before") <= max_interval), sure(F.abs("_after") <= max_interval)
        value = F.when(child, "NA").when(sure(F.col("_prev") == "CHI") | sure(F.col("_next") == "CHI"), "Y").when(b & a, F.when(F.abs("_before") < F.abs("_after"), same("_prev")).otherwise(same("_next"))).when(b, same("_prev")).when(a, same("_next")).otherwise("Y")
    cls = F.when(F.col("speaker_type") == "CHI", "C").when(F.col("speaker_type").isNotNull(), "O")
    return parts.withColumns({"speaker_class": cls, "cva": value}).drop("_prev", "_next", "_before", "_after")


def acoustics(segments: DataFrame, signal: DataFrame) -> DataFrame:
    """Pitch and amplitude of each segment, from the samples of its recording."""
    from earshot.operators.audio import acoustics as measured

    return measured(segments, signal)


DERIVATIONS: dict[str, Callable[..., DataFrame]] = {"conversations": conversation_ids, "remove-overlaps": remove_overlaps, "cva": cva, "acoustics": acoustics}


def register(name: str, derivation: Callable[..., DataFrame]) -> None:
    if name in DERIVATIONS:
        raise ValueError(f"there is a derivation {name}")
    DERIVATIONS[name] = derivation


def derive(segments: DataFrame, index: DataFrame, input_set: str, output_set: str, derivation: str | Callable[..., DataFrame], **options) -> tuple[DataFrame, DataFrame]:
    """Segments and index rows of a new set: the derivation's rows, cut to their ranges, with those without length that lie inside one. ``segments`` carry their range."""
    f = DERIVATIONS[derivation] if isinstance(derivation, str) else derivation
    found = f(segments.where(F.col("set") == input_set), **options)
    if missing := {*SEGMENT} - {*found.columns}:
        raise ValueError(f"the derivation lacks {sorted(missing)}")
    out = clip(found, *RANGE, points=True).withColumn("set", F.lit(output_set))
    return out, index.where(F.col("set") == input_set).withColumn("set", F.lit(output_set))
