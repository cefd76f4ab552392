"""The metric registry: each metric is a conditional aggregate over the segments of a unit and set.

A metric builds one aggregate column, so any number of metrics over any number of sets takes one pass. ``register`` adds
metrics of one's own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from earshot.functions.clock import HOUR

RESERVED = ("set", "name", "callable")


class Rows:
    """The rows that a metric is of: those of one set, seen through conditional aggregates."""

    def __init__(self, these: Column, columns: set[str], turn: Column | None = None):
        self.these, self.columns, self._turn = these, columns, turn

    def number(self) -> Column:
        return F.count(F.when(self.these, 1))

    def count(self, where: Column) -> Column:
        return F.count(F.when(self.these & where, 1))

    def total(self, value: Column, where: Column | None = None) -> Column:
        return F.coalesce(F.sum(F.when(self.these if where is None else self.these & where, value)), F.lit(0))

    def mean(self, value: Column, where: Column) -> Column:
        return F.avg(F.when(self.these & where, value))

    def spread(self, value: Column, where: Column) -> Column:
        return F.stddev_samp(F.when(self.these & where, value))

    def turns(self) -> Column:
        return F.count(F.when(self.these & self._turn, 1))


@dataclass(frozen=True)
class Metric:
    """``columns``: alternatives, of which the segments must have one; ``empty``: the value for annotated time without segments.

    ``apply`` is for what no aggregate expresses: a number from a unit's rows of the set as a pandas frame, and the arguments.
    Such a metric takes a pass of its own, in which a unit's rows are held by one task; it has no hourly or peak form.
    """

    name: str
    build: Callable[..., Column]
    args: tuple[str, ...] = ()
    columns: tuple[frozenset[str], ...] = (frozenset(),)
    empty: float | None = 0
    hourly: bool = True
    options: Mapping[str, object] = field(default_factory=dict)
    turns: bool = False
    apply: Callable[..., float | None] | None = None


REGISTRY: dict[str, Metric] = {}


def register(metric: Metric) -> Metric:
    """Add a metric; one with ``hourly`` also gets its ``_ph`` and ``peak_`` variants."""
    if metric.name in REGISTRY:
        raise ValueError(f"there is a metric {metric.name}")
    if metric.apply is not None and metric.hourly:
        raise ValueError("a metric in pandas has no hourly form")
    REGISTRY[metric.name] = metric
    return metric




class _Columns:
    """Columns by name, made when they are used: there may be no session yet."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


_c = _Columns()
_cols = lambda *names: frozenset(names)


def _plain(name: str, build, columns, args=("speaker",), **more) -> None:
    register(Metric(name, build, args, columns if isinstance(columns, tuple) else (columns,), **more))


_plain("voc_speaker", lambda r, speaker: r.count(_c.speaker_type == speaker), _cols("speaker_type"))
_plain("voc_dur_speaker", lambda r, speaker: r.total(_c.duration, _c.speaker_type == speaker), _cols("speaker_type", "duration"))
_plain("avg_voc_dur_speaker", lambda r, speaker: r.mean(_c.duration, _c.speaker_type == speaker), _cols("speaker_type", "duration"), empty=None, hourly=False)
_plain("std_voc_dur_speaker", lambda r, speaker: r.spread(_c.duration, _c.speaker_type == speaker), _cols("speaker_type", "duration"), empty=None, hourly=False)
for _short, _unit in (("wc", "words"), ("sc", "syllables"), ("pc", "phonemes")):
    _plain(f"{_short}_speaker", lambda r, speaker, u=_unit: r.total(F.col(u), _c.speaker_type == speaker), _cols("speaker_type", _unit))
    _plain(f"{_short}_adu", lambda r, u=_unit: r.total(F.col(u)), _cols(_unit), ())
for _kind, _code in (("can", "C"), ("non_can", "N")):
    _one = lambda speaker, c=_code: (_c.speaker_type == speaker) & (_c.vcm_type == c)
    _plain(f"{_kind}_voc_speaker", lambda r, speaker, f=_one: r.count(f(speaker)), _cols("speaker_type", "vcm_type"))
    _plain(f"{_kind}_voc_dur_speaker", lambda r, speaker, f=_one: r.total(_c.duration, f(speaker)), _cols("speaker_type", "vcm_type", "duration"))
    _plain(f"avg_{_kind}_voc_dur_speaker", lambda r, speaker, f=_one: F.when(r.number() > 0, F.coalesce(r.mean(_c.duration, f(speaker)), F.lit(0.0))), _cols("speaker_type", "vcm_type", "duration"), empty=None, hourly=False)
    _plain(f"std_{_kind}_voc_dur_speaker", lambda r, speaker, f=_one: r.spread(_c.duration, f(speaker)), _cols("speaker_type", "vcm_type", "duration"), empty=None, hourly=False)

_size = lambda c: F.greatest(F.size(c), F.lit(0))


def _cry(by_type: Callable[[Rows, Column], Column], by_list: Callable[[Rows, Column], Column]):
    return lambda r, speaker: by_type(r, (_c.speaker_type == speaker) & (_c.vcm_type == "Y")) if "vcm_type" in r.columns else by_list(r, _c.speaker_type == speaker)


def _cry_spread(r: Rows, who: Column) -> Column:
    """The deviation of the cries' lengths, each taken as its row's mean, from sums: no row is repeated for each cry."""
    some = who & (_size("cries") > 0)
    n, x, xx = (F.sum(F.when(r.these & some, v)) for v in (_size("cries").cast("double"), F.col("child_cry_vfx_len").cast("double"), F.pow(F.col("child_cry_vfx_len").cast("double"), F.lit(2)) / _size("cries")))
    return F.when(n > 1, F.sqrt(F.greatest((xx - x * x / n) / (n - 1), F.lit(0.0))))


_either = lambda *more: (_cols("speaker_type", "vcm_type", *more), _cols("speaker_type", "cries", "child_cry_vfx_len"))
_plain("cry_voc_speaker", _cry(lambda r, w: r.count(w), lambda r, w: r.total(_size("cries"), w)), (_cols("speaker_type", "vcm_type"), _cols("speaker_type", "cries")))
_plain("cry_voc_dur_speaker", _cry(lambda r, w: r.total(_c.duration, w), lambda r, w: r.total(F.col("child_cry_vfx_len"), w)), (_cols("speaker_type", "vcm_type", "duration"), _cols("speaker_type", "child_cry_vfx_len")))
_plain("avg_cry_voc_dur_speaker", _cry(lambda r, w: F.when(r.number() > 0, F.coalesce(r.mean(_c.duration, w), F.lit(0.0))), lambda r, w: F.when(r.number() > 0, F.coalesce(r.total(F.col("child_cry_vfx_len"), w & (_size("cries") > 0)) / F.nullif(r.total(_size("cries"), w), F.lit(0)), F.lit(0.0)))), _either("duration"), empty=None, hourly=False)
_plain("std_cry_voc_dur_speaker", _cry(lambda r, w: r.spread(_c.duration, w), _cry_spread), _either("duration"), empty=None, hourly=False)

_chi = lambda: _c.speaker_type == "CHI"
_of = lambda *codes: _chi() & _c.vcm_type.isin(*codes)
_ratio = lambda a, b: a / F.nullif(b, F.lit(0))


def _lp_n(r: Rows) -> Column:
    if {"cries", "vfxs", "utterances_count"} <= r.columns:
        return _ratio(r.total(F.col("utterances_count"), _chi()), r.total(F.coalesce("utterances_count", F.lit(0)) + _size("cries") + _size("vfxs"), _chi()))
    return _ratio(r.count(_of("N", "C")), r.count(_of("N", "C", "Y")))


def _lp_dur(r: Rows) -> Column:
    if {"child_cry_vfx_len", "utterances_length"} <= r.columns:
        speech = r.total(F.col("utterances_length"), _chi())
        return _ratio(speech, speech + r.total(F.col("child_cry_vfx_len"), _chi()))
    return _ratio(r.total(_c.duration, _of("N", "C")), r.total(_c.duration, _of("N", "C", "Y")))


_plain("lp_n", _lp_n, (_cols("speaker_type", "cries", "vfxs", "utterances_count"), _cols("speaker_type", "vcm_type")), (), empty=None, hourly=False)
_plain("cp_n", lambda r: _ratio(r.count(_of("C")), r.count(_of("N", "C"))), _cols("speaker_type", "vcm_type"), (), empty=None, hourly=False)
_plain("lp_dur", _lp_dur, (_cols("speaker_type", "child_cry_vfx_len", "utterances_length"), _cols("speaker_type", "vcm_type", "duration")), (), empty=None, hourly=False)
_plain("cp_dur", lambda r: _ratio(r.total(_c.duration, _of("C")), r.total(_c.duration, _of("N", "C"))), _cols("speaker_type", "vcm_type", "duration"), (), empty=None, hourly=False)
_plain("lena_CVC", lambda r: r.total(F.col("utterances_count")), _cols("utterances_count"), ())
_plain("lena_CTC", lambda r: r.count(F.col("lena_conv_turn_type").isin("TIMR", "TIFR")), _cols("lena_conv_turn_type"), ())
_plain("simple_CTC", lambda r, **_: r.turns(), _cols("speaker_type", "segment_onset", "segment_offset"), (), turns=True, options={"interlocutors_1": ("CHI",), "interlocutors_2": ("FEM", "MAL", "OCH"), "max_interval": 1000, "min_delay": 0})


@dataclass(frozen=True)
class Wanted:
    """A metric with its arguments: ``peak_ms`` is the length of its buckets, for a peak metric."""

    metric: Metric
    set: str
    name: str
    args: Mapping[str, object]
    per_hour: bool
    peak_ms: int | None

    def build(self, rows: Rows) -> Column:
        if not any(need <= rows.columns for need in self.metric.columns):
            raise ValueError(f"{self.name} needs the columns {' or '.join(str(sorted(c)) for c in self.metric.columns)}")
        return self.metric.build(rows, **{k: v for k, v in self.args.items() if k in self.metric.args})


def wanted(spec: Mapping[str, object]) -> Wanted:
    """Resolve {callable, set, name?, arguments...}; the name has its arguments' values put in their place, in lower case."""
    call = str(spec["callable"])
    base, per_hour, peak = call, call.endswith("_ph"), call.startswith("peak_")
    base = base.removesuffix("_ph").removeprefix("peak_") if base not in REGISTRY else base
    if base not in REGISTRY or ((per_hour or peak) and base != call and not REGISTRY[base].hourly):
        raise ValueError(f"unknown metric {call}")
    metric = REGISTRY[base]
    given = {k: v for k, v in spec.items() if k not in RESERVED and v is not None}
    if missing := [a for a in metric.args if a not in given]:
        raise ValueError(f"{call} needs {', '.join(missing)}")
    period = int(given.pop("period_time", HOUR))
    name = str(spec.get("name") or call)
    for k, v in given.items():
        name = re.sub(k, str(v).lower(), name)
    return Wanted(metric, str(spec["set"]), name, {**metric.options, **given}, per_hour and base != call, period if peak and base != call else None)


def resolve(specs: Sequence[Mapping[str, object]]) -> list[Wanted]:
    """All of ``specs``; two results of one name raise ValueError."""
    found = [wanted(s) for s in specs]
    names = [w.name for w in found]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"metrics of the same name: {twice}")
    return found


def lena_bundle(of: str) -> list[dict]:
    """The 19 standard metrics of a set made from LENA's own annotations."""
    by_speaker = [("voc_speaker_ph", s) for s in ("FEM", "MAL", "CHI", "OCH")] + [("voc_dur_speaker_ph", s) for s in ("FEM", "MAL", "CHI", "OCH")] + [("avg_voc_dur_speaker", s) for s in ("FEM", "MAL", "CHI", "OCH")] + [("wc_speaker_ph", s) for s in ("FEM", "MAL")]
    return [{"callable": c, "set": of, "speaker": s} for c, s in by_speaker] + [{"callable": c, "set": of} for c in ("wc_adu_ph", "lp_n", "lp_dur", "lena_CVC_ph", "lena_CTC_ph")]


def aclew_bundle(vtc: str = "vtc", alice: str | None = "alice", vcm: str | None = "vcm", deviations: bool = False) -> list[dict]:
    """The standard metrics of a voice-type set, and of word-count and vocal-maturity sets where there are any."""
    out = [{"callable": c, "set": vtc, "speaker": s} for c in ("voc_speaker_ph", "voc_dur_speaker_ph", "avg_voc_dur_speaker") for s in ("FEM", "MAL", "CHI", "OCH")] + [{"callable": "simple_CTC_ph", "set": vtc}]
    if deviations:
        out += [{"callable": "std_voc_dur_speaker", "set": vtc, "speaker": s} for s in ("FEM", "MAL", "CHI", "OCH")]
    if alice:
        out += [{"callable": f"{u}_speaker_ph", "set": alice, "speaker": s} for u in ("wc", "sc", "pc") for s in ("FEM", "MAL")] + [{"callable": f"{u}_adu_ph", "set": alice} for u in ("wc", "sc", "pc")]
    if vcm:
        out += [{"callable": f"{c}_voc_speaker_ph", "set": vcm, "speaker": "CHI"} for c in ("cry", "can", "non_can")] + [{"callable": f"{c}_voc_dur_speaker_ph", "set": vcm, "speaker": "CHI"} for c in ("cry", "can", "non_can")] + [{"callable": f"avg_{c}_voc_dur_speaker", "set": vcm, "speaker": "CHI"} for c in ("cry", "can", "non_can")] + [{"callable": c, "set": vcm} for c in ("lp_n", "cp_n", "lp_dur", "cp_dur")]
        if deviations:
            out += [{"callable": f"std_{c}_voc_dur_speaker", "set": vcm, "speaker": "CHI"} for c in ("cry", "can", "non_can")]
    return out
