from __future__ import annotations

import numpy as np
import pytest
from conftest import values

from earshot.operators import audio
from earshot.sources import audio as source

RATE = 8000


@pytest.fixture
def wavs(tmp_path):
    t = np.arange(2 * RATE) / RATE
    tone = np.where(t < 1, 0.5 * np.sin(2 * np.pi * 200 * t), 0.25 * np.sin(2 * np.pi * 400 * t))
    (tmp_path / "a.wav").write_bytes(source.encode(np.column_stack([tone, tone]), RATE))
    (tmp_path / "b.wav").write_bytes(source.encode(np.column_stack([tone, -tone]), RATE))
    (tmp_path / "c.wav").write_bytes(b"no sound")
    return str(tmp_path / "*.wav"), tone


def samples(df, rec, channel=0):
    r = audio.whole(df).where(f"recording_filename = '{rec}' and channel = {channel}").first()
    return np.array(r["samples"])


def test_blocks_and_durations(spark, wavs):
    path, tone = wavs
    df = source.read_wav(spark, path, block_ms=300)
    assert df.count() == 2 * 2 * 7 and np.abs(samples(df, "a.wav") - tone).max() < 1e-4
    assert values(source.durations(spark, path)) == [("a.wav", 2000), ("b.wav", 2000), ("c.wav", 0)]


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_sample_widths(width):
    x = np.array([0.0, 0.5, -0.5, -1.0])
    scaled = (x * (1 << (8 * width - 1))).astype(np.int64) + (128 if width == 1 else 0)
    raw = b"".join(int(v).to_bytes(width, "little", signed=width > 1) for v in scaled)
    assert np.allclose(source.decode(raw, width, 2), x.reshape(2, 2), atol=1e-2)


def test_silence_channels_and_comparison(spark, frame, wavs):
    path, tone = wavs
    df = source.read_wav(spark, path, block_ms=300)
    quiet = samples(audio.vet(df, frame("recording_filename string, range_onset bigint, range_offset bigint", ("a.wav", 250, 700))), "a.wav")
    assert not quiet[2000:5600].any() and np.abs(quiet[5600:] - tone[5600:]).max() < 1e-4 and quiet[:2000].any()
    mixed = audio.map_channels(df, [[0.5, 0.5], [1, 0], [0, 0]])
    assert np.abs(samples(mixed, "b.wav")).max() < 1e-4 and np.abs(samples(mixed, "b.wav", 1) - tone).max() < 1e-4
    got = audio.compare(df, "a.wav", "b.wav").first()
    assert got["samples"] == 4 * RATE and got["difference"] == pytest.approx(1000 * np.abs(tone).mean(), rel=1e-2)


def test_acoustics_and_clips(spark, frame, wavs, tmp_path):
    path, tone = wavs
    df = source.read_wav(spark, path, block_ms=300)
    seg = frame("recording_filename string, segment_onset bigint, segment_offset bigint", ("a.wav", 100, 900), ("a.wav", 1100, 1900), ("a.wav", 5000, 6000), ("a.wav", 0, 5))
    got = {r["segment_onset"]: r for r in audio.acoustics(seg, df).collect()}
    assert got[100]["median_pitch_semitone"] == pytest.approx(24, abs=0.05) and got[1100]["mean_pitch_semitone"] == pytest.approx(36, abs=0.05)
    assert got[100]["peak_abs_amp"] == pytest.approx(0.5, abs=1e-3) and got[100]["mean_abs_amp"] == pytest.approx(1 / np.pi, abs=1e-2) and got[100]["pitch_range_semitone"] < 0.1
    assert got[5000]["peak_abs_amp"] is None and got[0]["mean_pitch_semitone"] is None
    cut = audio.clips(df, seg.where("segment_onset = 100"))
    assert np.abs(samples(cut, "a_100_900.wav") - tone[800:7200]).max() < 1e-4
    written = source.write_wav(cut, str(tmp_path / "clips")).collect()
    assert [r["path"].rsplit("/", 1)[1] for r in written] == ["a_100_900.wav"]
    assert values(source.durations(spark, str(tmp_path / "clips"))) == [("a_100_900.wav", 800)]


def test_many_recordings_are_written_and_read(spark, frame, tmp_path):
    """Names with folders, blocks out of order, recordings of one and two channels; none takes a task or a frame of its own."""
    rows = [(f"d{i % 3}/r{i}.wav", c, 10, k * 10, [float(np.float32((i + c + k * 10 + j) % 50 / 64)) for j in range(10 if k < 2 else 3)]) for k in (2, 0, 1) for i in range(60) for c in range(1 + i % 2)]
    signal = frame(source.SIGNAL, *rows)
    written = source.write_wav(signal, str(tmp_path / "w"))
    assert sorted(r["path"] for r in written.collect()) == sorted({f"{tmp_path}/w/{r[0]}" for r in rows})
    assert "FlatMapGroups" not in written._jdf.queryExecution().toString() and not list((tmp_path / "w").glob("*/_*"))
    back = source.read_wav(spark, f"{tmp_path}/w/*", block_ms=1000)
    got = {(r["recording_filename"], r["channel"], r["start_sample"]): (r["rate"], r["samples"]) for r in back.collect()}
    assert len(got) == len(rows) and all(got[n.rpartition("/")[2], c, s][0] == 10 and np.abs(np.array(got[n.rpartition("/")[2], c, s][1]) - x).max() < 1e-4 for n, c, _, s, x in rows)
