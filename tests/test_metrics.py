from __future__ import annotations

import pytest

from earshot.functions import metrics as fm
from earshot.plans.metrics import extract, extract_spec, turn_flags

SEG = "row_no bigint, set string, recording_filename string, segment_onset bigint, segment_offset bigint, speaker_type string, vcm_type string, words double, syllables double, phonemes double"


@pytest.fixture
def tables(frame):
    rows = [(i * 200, "CHI", "CN"[i % 2], None, None, None) for i in range(20)] + [(i * 500, "FEM", None, 1.0, 2.0, 4.0) for i in range(8)]
    # turns are counted in the order of the file, which is by time here
    rows.sort(key=lambda r: (r[0], r[1]))
    seg = frame(SEG, *[(n, s, "x", on, on + 100, *r) for s in ("vtc", "alice", "vcm") for n, (on, *r) in enumerate(rows)])
    idx = frame("set string, recording_filename string, range_onset bigint, range_offset bigint", *[(s, "x", 0, 4000) for s in ("vtc", "alice", "vcm")], ("vtc", "y", 0, 1000))
    rec = frame("recording_filename string, child_id string, session_id string, experiment string, start_time string, date_iso string", ("x", "1", "s", "e", "09:00", "2020-01-01"), ("y", "1", "s", "e", "10:00", "2020-01-02"), ("z", "2", "t", "e", "10:00", "2020-01-02"))
    return seg, idx, rec


def one(df, **where):
    rows = [r.asDict() for r in df.collect()]
    return next(r for r in rows if all(r[k] == v for k, v in where.items()))


def test_standard_bundle(tables):
    got = one(extract(*tables, fm.aclew_bundle(deviations=True)), recording_filename="x")
    hour = 3_600_000 / 4000
    assert got["duration_vtc"] == got["duration_alice"] == 4000
    want = {"voc_chi_ph": 20 * hour, "voc_fem_ph": 8 * hour, "voc_mal_ph": 0, "voc_dur_chi_ph": 1_800_000, "avg_voc_dur_fem": 100, "avg_voc_dur_mal": None, "std_voc_dur_chi": 0, "wc_adu_ph": 7200, "wc_fem_ph": 7200, "sc_fem_ph": 14_400, "pc_mal_ph": 0, "pc_adu_ph": 28_800}
    want |= {"can_voc_chi_ph": 9000, "non_can_voc_dur_chi_ph": 900_000, "cry_voc_chi_ph": 0, "avg_cry_voc_dur_chi": 0, "avg_can_voc_dur_chi": 100, "lp_n": 1, "cp_n": 0.5, "lp_dur": 1, "cp_dur": 0.5}
    assert {k: got[k] for k in want} == want
    assert len([k for k in got if k not in ("recording_filename", "child_id") and not k.startswith("duration_")]) == 35 + 7


def test_peaks(tables):
    specs = [{"callable": "peak_voc_speaker", "set": "vtc", "speaker": "FEM", "period_time": 1000}, {"callable": "peak_voc_speaker", "set": "vtc", "speaker": "CHI"}, {"callable": "peak_wc_adu", "set": "alice", "period_time": 1000}, {"callable": "simple_CTC", "set": "vtc"}, {"callable": "peak_simple_CTC", "set": "vtc", "period_time": 1000}]
    got = one(extract(*tables, specs), recording_filename="x")
    assert (got["peak_voc_fem"], got["peak_voc_chi"], got["peak_wc_adu"], got["simple_CTC"], got["peak_simple_CTC"]) == (2, None, 2, 16, 4)


def test_no_segments_and_no_annotation(tables):
    got = one(extract(*tables, [{"callable": "voc_speaker", "set": "vtc", "speaker": "CHI"}, {"callable": "avg_voc_dur_speaker", "set": "vtc", "speaker": "CHI"}, {"callable": "wc_adu", "set": "alice"}]), recording_filename="y")
    assert (got["voc_chi"], got["avg_voc_dur_chi"], got["wc_adu"], got["duration_alice"]) == (0, None, None, 0)


def test_units_periods_and_windows(tables):
    spec = [{"callable": "voc_speaker", "set": "vtc", "speaker": "FEM"}]
    by_child = extract(*tables, spec, "child_id", rec_cols=("date_iso", "experiment"))
    got = one(by_child, child_id="1")
    assert by_child.count() == 1 and (got["duration_vtc"], got["voc_fem"], got["date_iso"], got["experiment"]) == (5000, 8, None, "e")
    hours = extract(*tables, spec, "child_id", period_ms=3_600_000)
    assert hours.count() == 24
    got = one(hours, period_start="09:00:00")
    assert (got["period_end"], got["duration_vtc"], got["voc_fem"]) == ("10:00:00", 4000, 8)
    assert one(hours, period_start="23:00:00")["voc_fem"] is None and one(hours, period_start="23:00:00")["period_end"] == "00:00:00"
    late = extract(*tables, spec, "child_id", from_time="09:30", to_time="11:00")
    assert (one(late)["duration_vtc"], one(late)["voc_fem"]) == (1000, 0)


def test_segments_as_units(tables, frame):
    units = frame("recording_filename string, segment_onset bigint, segment_offset bigint", ("x", 0, 1000), ("x", 450, 550), ("y", 5000, 6000))
    df = extract(*tables, [{"callable": "voc_dur_speaker", "set": "vtc", "speaker": "CHI"}], "segments", units=units)
    got = {(r["recording_filename"], r["segment_onset"]): (r["duration_vtc"], r["voc_dur_chi"]) for r in df.collect()}
    assert got == {("x", 0): (1000, 500), ("x", 450): (100, 50), ("y", 5000): (0, None)}


def test_lists_of_cries(frame):
    spans = "array<struct<start double, end double>>"
    seg = frame(f"set string, recording_filename string, segment_onset bigint, segment_offset bigint, speaker_type string, cries {spans}, vfxs {spans}, child_cry_vfx_len double, utterances_count double, utterances_length double", ("l", "x", 0, 1000, "CHI", [(0.0, 0.3), (0.4, 0.5)], [], 400.0, 1.0, 200.0), ("l", "x", 1000, 2000, "CHI", [(1.0, 1.5)], [(1.6, 1.7)], 600.0, 2.0, 100.0), ("l", "x", 2000, 3000, "CHI", [], [], 0.0, 0.0, 0.0))
    idx = frame("set string, recording_filename string, range_onset bigint, range_offset bigint", ("l", "x", 0, 3000))
    rec = frame("recording_filename string, child_id string", ("x", "1"))
    got = one(extract(seg, idx, rec, [{"callable": c, "set": "l", "speaker": "CHI"} for c in ("cry_voc_speaker", "cry_voc_dur_speaker", "avg_cry_voc_dur_speaker", "std_cry_voc_dur_speaker")] + [{"callable": c, "set": "l"} for c in ("lp_n", "lp_dur")]))
    # three cries of mean lengths 200, 200 and 600
    assert (got["cry_voc_chi"], got["cry_voc_dur_chi"]) == (3, 1000)
    assert got["avg_cry_voc_dur_chi"] == pytest.approx(1000 / 3) and got["std_cry_voc_dur_chi"] == pytest.approx(230.94010767)
    assert got["lp_n"] == pytest.approx(3 / 7) and got["lp_dur"] == pytest.approx(300 / 1300)


def test_segments_without_length_count(frame):
    """Inside a range, not at its ends: in counts, means, ratios, turns, periods and windows."""
    row = lambda n, on, off, who, vcm: (n, "a", "x", on, off, who, vcm, None, None, None)
    hour = 3_600_000
    seg = frame(SEG, row(0, 0, 0, "CHI", "C"), row(1, 100, 300, "CHI", "C"), row(2, 400, 400, "FEM", None), row(3, 500, 500, "CHI", "C"), row(4, 600, 700, "CHI", "Y"), row(5, hour + 1000, hour + 1000, "CHI", "N"), row(6, 2 * hour, 2 * hour, "CHI", "N"))
    idx = frame("set string, recording_filename string, range_onset bigint, range_offset bigint", ("a", "x", 0, 2 * hour))
    rec = frame("recording_filename string, child_id string, start_time string", ("x", "1", "09:00"))
    calls = [{"callable": c, "set": "a", "speaker": "CHI"} for c in ("voc_speaker", "avg_voc_dur_speaker", "avg_can_voc_dur_speaker", "non_can_voc_speaker")] + [{"callable": c, "set": "a"} for c in ("lp_n", "cp_n", "simple_CTC")]
    got = one(extract(seg, idx, rec, calls))
    assert (got["voc_chi"], got["avg_voc_dur_chi"], got["avg_can_voc_dur_chi"], got["non_can_voc_chi"]) == (4, 75, 100, 1)
    assert (got["lp_n"], got["cp_n"], got["simple_CTC"]) == (3 / 4, 2 / 3, 2)
    spec = [{"callable": "voc_speaker", "set": "a", "speaker": "CHI"}]
    hours = extract(seg, idx, rec, spec, period_ms=hour)
    assert [one(hours, period_start=f"{h:02}:00:00")["voc_chi"] for h in (9, 10, 11)] == [3, 1, None]
    assert one(extract(seg, idx, rec, spec, from_time="10:00", to_time="12:00"))["voc_chi"] == 1


def test_names_and_refusals(tables):
    assert len([v for m in fm.REGISTRY.values() for v in range(3 if m.hourly else 1)]) == 63
    assert fm.wanted({"callable": "peak_non_can_voc_dur_speaker", "set": "a", "speaker": "CHI"}).name == "peak_non_can_voc_dur_chi"
    assert fm.wanted({"callable": "wc_adu", "set": "a", "name": "words"}).name == "words"
    for bad in ({"callable": "nothing"}, {"callable": "voc_speaker"}, {"callable": "lp_n_ph"}, {"callable": "avg_voc_dur_speaker_ph", "speaker": "CHI"}):
        with pytest.raises(ValueError):
            fm.wanted({"set": "a"} | bad)
    with pytest.raises(ValueError, match="same name"):
        fm.resolve([{"callable": "wc_adu", "set": "a"}] * 2)
    with pytest.raises(ValueError, match="needs the columns"):
        extract(tables[0].drop("vcm_type"), *tables[1:], [{"callable": "cp_n", "set": "vcm"}])
    with pytest.raises(ValueError):
        extract(*tables, [{"callable": "wc_adu", "set": "alice"}], "planet")


def test_specification_and_own_metric(tables):
    fm.register(fm.Metric("longest", lambda r: fm.F.max(fm.F.when(r.these, fm.F.col("duration"))), empty=None, hourly=False))
    try:
        got = extract_spec({"metrics_list": [{"callable": "longest", "set": "vtc"}], "by": "session_id", "rec_cols": "experiment"}, *tables)
        assert got.columns == ["session_id", "child_id", "experiment", "duration_vtc", "longest"] and one(got)["longest"] == 100
    finally:
        fm.REGISTRY.pop("longest")


def test_metric_in_pandas(tables):
    with pytest.raises(ValueError, match="hourly"):
        fm.register(fm.Metric("bad", None, apply=len))
    fm.register(fm.Metric("rhythm", None, ("speaker",), empty=None, hourly=False, apply=lambda df, speaker: df.loc[df["speaker_type"] == speaker, "duration"].max()))
    try:
        specs = [{"callable": "rhythm", "set": "vtc", "speaker": "CHI"}, {"callable": "voc_speaker", "set": "vtc", "speaker": "CHI"}]
        got, plain = one(extract(*tables, specs)), one(extract(*tables, specs[1:]))
        assert got["voc_chi"] == plain["voc_chi"] and got["rhythm"] > 0
    finally:
        fm.REGISTRY.pop("rhythm")


def test_turns_need_partners_in_time(frame):
    df = frame("recording_filename string, segment_onset bigint, segment_offset bigint, speaker_type string", ("x", 0, 100, "CHI"), ("x", 150, 160, "NA"), ("x", 1099, 1200, "FEM"), ("x", 2200, 2300, "CHI"), ("x", 2310, 2400, "CHI"), ("y", 2450, 2500, "FEM"))
    assert [r["segment_onset"] for r in turn_flags(df, ["recording_filename"]).where("is_turn").collect()] == [1099]
