"""Features of conversations: aggregates over a conversation's rows in order. ``register`` adds one's own."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

REGISTRY: dict[str, tuple[Callable[..., Column], tuple[str, ...]]] = {}
#: Features that are functions of a conversation's rows as a pandas frame, with the type of their value.
IN_PANDAS: dict[str, tuple[Callable[..., object], str]] = {}


def register_pandas(name: str, apply: Callable[..., object], kind: str = "double") -> None:
    """For what no aggregate expresses: ``apply`` gets a conversation's rows in order and the specification's arguments."""
    if name in REGISTRY or name in IN_PANDAS:
        raise ValueError(f"there is a feature {name}")
    IN_PANDAS[name] = apply, kind


def register(name: str, build: Callable[..., Column], args: Sequence[str] = ()) -> None:
    if name in REGISTRY:
        raise ValueError(f"there is a feature {name}")
    REGISTRY[name] = build, tuple(args)


def _participants() -> Column:
    rows = F.array_sort(F.collect_list(F.struct(F.col("row_no").alias("n"), F.col("speaker_type").alias("s"))))
    return F.array_join(F.array_distinct(F.transform(rows, lambda x: x["s"])), "/")


def _conv_type() -> Column:
    has = {s: F.coalesce(F.bool_or(F.col("speaker_type") == s), F.lit(False)) for s in ("CHI", "FEM", "MAL", "OCH")}
    kinds = {("FEM",): "dyadic_FEM", ("MAL",): "dyadic_MAL", ("OCH",): "peer", ("FEM", "MAL"): "parent", ("FEM", "OCH"): "triadic_FEM", ("MAL", "OCH"): "triadic_MAL", ("FEM", "MAL", "OCH"): "multiparty"}
    out = F.when(~has["CHI"], F.lit("overheard"))
    for who, kind in kinds.items():
        fits = F.lit(True)
        for s in ("FEM", "MAL", "OCH"):
            fits = fits & (has[s] == F.lit(s in who))
        out = out.when(fits, F.lit(kind))
    return out


register("who_initiated", lambda: F.min_by(F.col("speaker_type"), F.col("row_no")))
register("who_finished", lambda: F.max_by(F.col("speaker_type"), F.struct(F.col("segment_offset"), -F.col("row_no"))))
register("participants", _participants)
register("voc_total_dur", lambda: F.sum(F.col("voc_duration")))
register("is_speaker", lambda speaker: F.coalesce(F.bool_or(F.col("speaker_type") == speaker), F.lit(False)), ("speaker",))
register("voc_speaker_count", lambda speaker: F.count(F.when(F.col("speaker_type") == speaker, 1)), ("speaker",))
register("voc_speaker_dur", lambda speaker: F.sum(F.when(F.col("speaker_type") == speaker, F.col("voc_duration"))), ("speaker",))
register("voc_dur_contribution", lambda speaker: F.sum(F.when(F.col("speaker_type") == speaker, F.col("voc_duration"))) / F.nullif(F.sum(F.col("voc_duration")), F.lit(0)), ("speaker",))
register("assign_conv_type", _conv_type)


def build(spec: Mapping[str, object]) -> tuple[str, Column]:
    """Name and aggregate of {callable, name?, arguments...}."""
    call = str(spec["callable"])
    if call not in REGISTRY:
        raise ValueError(f"unknown feature {call}")
    f, args = REGISTRY[call]
    if missing := [a for a in args if spec.get(a) is None]:
        raise ValueError(f"{call} needs {', '.join(missing)}")
    return str(spec.get("name") or call), f(**{a: spec[a] for a in args})


#: The eleven standard features.
STANDARD = [
    {"callable": "who_initiated", "name": "initiator"},
    {"callable": "who_finished", "name": "finisher"},
    {"callable": "voc_total_dur", "name": "total_duration_of_vocalisations"},
    *({"callable": f"voc_speaker_{what}", "name": f"{s}_voc_{what}", "speaker": s} for what in ("count", "dur") for s in ("CHI", "FEM", "MAL", "OCH")),
]
