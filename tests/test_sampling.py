from __future__ import annotations

import numpy as np
import pytest
from conftest import values

from earshot.operators import sampling

SEG = "row_no bigint, recording_filename string, segment_onset bigint, segment_offset bigint, speaker_type string"


def test_periodic_by_recording(frame):
    rec = frame("recording_filename string, duration bigint", ("a", 4000), ("b", 4000), ("c", 900), ("d", None))
    got = values(sampling.periodic(rec, 500, 200, 1000))
    slots = [(1000, 1500), (1700, 2200), (2400, 2900), (3100, 3600), (3800, 4000)]
    assert got == [(r, *s) for r in "ab" for s in slots]


def test_periodic_goes_on_over_a_session(frame):
    rec = frame("recording_filename string, session_id string, start_ts bigint, duration bigint", ("a", "s", 0, 1000), ("b", "s", 1250, 1000), ("c", "t", 7, 300))
    # slots of the session: 0-300, 500-800, 1000-1300, 1500-1800, 2000-2300
    got = values(sampling.periodic(rec, 300, 200, 0, "session_id"))
    assert got == [("a", 0, 300), ("a", 500, 800), ("b", 0, 50), ("b", 250, 550), ("b", 750, 1000), ("c", 0, 300)]


def test_random_draws_are_stable_and_whole(frame):
    df = frame(SEG, *[(i, "ab"[i % 2], i * 10, i * 10 + 5, "CHI") for i in range(40)])
    got = values(sampling.random_vocalizations(df, 7, ["CHI"], seed=3))
    assert len(got) == 14 and got == values(sampling.random_vocalizations(df.repartition(5), 7, ["CHI"], seed=3))
    assert got != values(sampling.random_vocalizations(df, 7, ["CHI"], seed=4))
    assert sampling.random_vocalizations(df, 100).count() == 40 and sampling.random_vocalizations(df, 5, ["FEM"]).count() == 0


def test_conversations_with_most_turns(frame):
    rows, n = [], 0
    for onset, vocs in ((0, 5), (60_000, 10), (1_800_000, 15)):
        for i in range(vocs):
            rows.append((n := n + 1, "x", onset + i * 2500, onset + i * 2500 + 2000, ("FEM", "CHI")[i % 2]))
    df = frame(SEG, *rows)
    assert values(sampling.top_conversations(df, 2), "segment_onset", "segment_offset") == [(60_000, 60_000 + 9 * 2500 + 2000), (1_800_000, 1_800_000 + 14 * 2500 + 2000)]


def test_volubility(frame):
    df = frame(SEG + ", words double", (0, "x", 0, 90, "FEM", 3.0), (1, "x", 100, 150, "CHI", 0.0), (2, "x", 160, 190, "FEM", 9.0), (3, "x", 210, 240, "NA", 50.0), (4, "x", 220, 260, "FEM", 1.0))
    assert values(sampling.high_volubility(df, "words", 100, 1, ["FEM"])) == [("x", 100, 190)]
    assert values(sampling.high_volubility(df, "turns", 100, 1)) == [("x", 100, 190)]
    assert values(sampling.high_volubility(df, "vocs", 100, 2)) == [("x", 0, 90), ("x", 100, 190)]
    with pytest.raises(ValueError):
        sampling.high_volubility(df, "loudness", 100, 1)


def test_loud_windows(frame):
    rate, t = 1000, np.arange(2000) / 1000
    loud = np.where((t >= 1.2) & (t < 1.3), np.sin(2 * np.pi * 100 * t), 0.01 * np.sin(2 * np.pi * 10 * t))
    df = frame("recording_filename string, channel int, samples array<double>", ("x", 0, loud.tolist()), ("x", 1, loud.tolist()), ("y", 0, []), ("z", 0, None))
    windows = sampling.window_energy(df, rate, 100, 100, low=50, high=400)
    assert windows.count() == 20
    assert values(sampling.energy_detection(windows, 1, 0.98)) == [("x", 1200, 1300)]


@pytest.mark.parametrize("on, off", [(1000, 1400), (1000, 1500), (1000, 1501), (100, 300)])
def test_chunks(frame, on, off):
    got = [r["onset"] for r in sampling.chunks(frame("segment_onset bigint, segment_offset bigint", (on, off)), 500).orderBy("onset").collect()]
    target = 500 * -(-(off - on) // 500)
    first = int(on - (target - (off - on)) / 2)
    assert got == ([] if first < 0 else list(range(first, first + target, 500)))
