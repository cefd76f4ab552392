from __future__ import annotations

import random

import pytest
from conftest import values
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from earshot.operators import derive, interval

SEG = "row_no bigint, recording_filename string, segment_onset bigint, segment_offset bigint, speaker_type string"
IDX = "set string, recording_filename string, range_onset bigint, range_offset bigint"
#: A 4 s clip, in the order of its file, which is not the order of time.
CLIP = [(0, 342, "CHI"), (113, 486, "FEM"), (200, 901, "OCH"), (782, 1421, "MAL"), (203, 1000, "CHI"), (1200, 1656, "OCH"), (1350, 2111, "MAL"), (1821, 2324, "FEM"), (2556, 2890, "CHI"), (2901, 3205, "FEM"), (3056, 3457, "OCH"), (3301, 3654, "MAL"), (3900, 3987, "CHI")]


@pytest.fixture
def clip(frame):
    return frame(SEG, *[(i, "s.wav", a, b, k) for i, (a, b, k) in enumerate(CLIP)])


def test_clip_keeps_what_has_a_length(frame):
    df = frame("segment_onset bigint, segment_offset bigint", (0, 10), (5, 25), (20, 30), (30, 40), (None, 7), (12, 12))
    assert values(interval.clip(df, 8, 22)) == [(8, 10), (8, 22), (20, 22)]
    assert interval.clip(df, F.lit(None).cast("bigint"), 9).count() == 0


def test_overlaps_are_removed(clip):
    got = values(derive.remove_overlaps(clip), "segment_onset", "segment_offset", "speaker_type")
    assert got == [(0, 113, "CHI"), (1000, 1200, "MAL"), (1656, 1821, "MAL"), (2111, 2324, "FEM"), (2556, 2890, "CHI"), (2901, 3056, "FEM"), (3205, 3301, "OCH"), (3457, 3654, "MAL"), (3900, 3987, "CHI")]


def test_equal_segments_annihilate_each_other(frame):
    df = frame(SEG, (1, "a", 0, 10, "CHI"), (2, "a", 0, 10, "FEM"), (3, "b", 0, 10, "CHI"), (4, "a", 10, 20, "MAL"), (5, "a", 12, 15, "NA"))
    assert values(interval.subtract_others(df.where("speaker_type != 'NA'"), "row_no"), "row_no", "segment_onset", "segment_offset") == [(3, 0, 10), (4, 10, 20)]
    assert values(interval.subtract_others(df, "row_no"), "row_no", "segment_onset", "segment_offset") == [(3, 0, 10), (4, 10, 12), (4, 15, 20)]


def test_three_sets_meet(frame):
    idx = frame(IDX, ("a", "x", 0, 10), ("a", "x", 20, 40), ("b", "x", 5, 30), ("c", "x", 8, 25), ("a", "y", 0, 9), ("b", "y", 0, 9))
    two = values(interval.intersect_sets(idx, ["a", "b"]))
    assert two == [("a", "x", 5, 10), ("a", "x", 20, 30), ("a", "y", 0, 9), ("b", "x", 5, 10), ("b", "x", 20, 30), ("b", "y", 0, 9)]
    assert {r[1:] for r in values(interval.intersect_sets(idx, ["a", "b", "c"]))} == {("x", 8, 10), ("x", 20, 25)}


@pytest.mark.parametrize("bucket", [None, 7, 1000])
def test_range_join_against_all_pairs(frame, bucket):
    rng = random.Random(bucket)
    rows = lambda: [(i, rng.choice("ab"), x := rng.randrange(100), x + rng.randrange(30)) for i in range(60)]
    one, two = rows(), rows()
    left = frame("i int, recording_filename string, range_onset bigint, range_offset bigint", *one)
    right = frame("j int, recording_filename string, range_onset bigint, range_offset bigint", *two)
    got = values(interval.range_join(left, right, bucket_ms=bucket), "i", "j", "overlap_onset", "overlap_offset")
    assert got == sorted((i, j, max(a, c), min(b, d)) for i, r, a, b in one for j, s, c, d in two if r == s and max(a, c) < min(b, d))


@pytest.mark.parametrize("bucket", [None, 7, 10])
def test_range_join_with_points(frame, bucket):
    left = frame("i int, recording_filename string, range_onset bigint, range_offset bigint", *[(i, "a", i, i) for i in range(0, 45)], (90, "a", 5, 25), (91, "a", 12, 11))
    right = frame("j int, recording_filename string, range_onset bigint, range_offset bigint", (0, "a", 10, 20), (1, "a", 20, 40))
    got = values(interval.range_join(left, right, bucket_ms=bucket, points=True), "i", "j", "overlap_onset", "overlap_offset")
    assert got == sorted([(i, int(i > 20), i, i) for i in range(11, 40) if i != 20] + [(90, 0, 10, 20), (90, 1, 20, 25)])


def test_clip_with_points(frame):
    df = frame("i int, segment_onset bigint, segment_offset bigint", (0, 5, 5), (1, 10, 10), (2, 15, 15), (3, 20, 20), (4, 0, 12), (5, 2, 8), (6, 21, 30))
    assert values(interval.clip(df, 10, 20, points=True), "i", "segment_onset", "segment_offset") == [(2, 15, 15), (4, 10, 12)]


def test_range_join_refuses_clashing_names(frame):
    df = frame("recording_filename string, range_onset bigint, range_offset bigint, x int", ("a", 0, 1, 2))
    with pytest.raises(ValueError, match="x"):
        interval.range_join(df, df)


def test_coverage_is_demanded(frame):
    idx = frame(IDX, ("a", "x", 0, 10_000), ("a", "y", 0, 5000))
    ranges = frame("recording_filename string, range_onset bigint, range_offset bigint", ("x", 1000, 3000), ("y", 4000, 9000))
    assert values(interval.within_ranges(idx, ranges), "recording_filename", "range_onset", "range_offset") == [("x", 1000, 3000), ("y", 4000, 5000)]
    with pytest.raises(ValueError, match="1.000 s of 5.000 s"):
        interval.within_ranges(idx, ranges, missing_data="raise")


def test_exclusion_and_union(frame):
    S = "recording_filename string, segment_onset bigint, segment_offset bigint"
    wanted = frame(S, ("x", 0, 100), ("x", 0, 100), ("y", 0, 10))
    gone = frame(S, ("x", 10, 20), ("x", 20, 30), ("x", 15, 18), ("x", 90, 120), ("z", 0, 5))
    assert values(interval.exclude(wanted, gone)) == [("x", 0, 10), ("x", 30, 90), ("y", 0, 10)]
    assert values(interval.merge_ranges(gone, cols=interval.SEGMENT)) == [("x", 10, 30), ("x", 90, 120), ("z", 0, 5)]


def test_sets_follow_on_one_timeline(frame):
    idx = frame(IDX, ("a", "x", 100, 200), ("a", "x", 500, 550), ("a", "y", 10, 20), ("b", "y", 0, 7))
    segs = frame(IDX + ", segment_onset bigint, segment_offset bigint", ("a", "x", 500, 550, 510, 520), ("a", "y", 10, 20, 12, 13), ("b", "y", 0, 7, 1, 2))
    assert values(interval.collapse(segs, idx), "set", "segment_onset", "segment_offset") == [("a", 110, 120), ("a", 152, 153), ("b", 1, 2)]


def test_merge_fills_with_na(frame):
    K = "recording_filename string, range_onset bigint, range_offset bigint, segment_onset bigint, segment_offset bigint, "
    left = frame(K + "speaker_type string, raw_filename string", ("x", 0, 9, 1, 2, "CHI", "l"), ("x", 0, 9, 3, 4, "FEM", "l"))
    right = frame(K + "words double, raw_filename string", ("x", 0, 9, 3, 4, 5.0, "r"), ("x", 0, 9, 6, 7, 1.0, "r"))
    got = values(interval.merge_sets(left, right, ["speaker_type"], ["words"]), "segment_onset", "speaker_type", "words", "raw_filename")
    assert got == [(1, "CHI", "NA", "l"), (3, "FEM", "5.0", "l,r"), (6, "NA", "1.0", "r")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 40), st.integers(1, 12)), min_size=1, max_size=25))
def test_sweeps_against_single_milliseconds(frame, rows):
    segs = [(i, r, a, a + n, "CHI") for i, (r, a, n) in enumerate(rows)]
    df = frame(SEG, *segs)
    owners = {}
    for i, r, a, b, _ in segs:
        for t in range(a, b):
            owners.setdefault((r, t), []).append(i)
    got = {(r, t): i for i, r, a, b in values(interval.subtract_others(df, "row_no"), "row_no", "recording_filename", "segment_onset", "segment_offset") for t in range(a, b)}
    assert got == {k: v[0] for k, v in owners.items() if len(v) == 1}
    flags = dict(values(interval.overlap_flags(df), "row_no", "overlaps"))
    assert flags == {i: any(len(owners[r, t]) > 1 for t in range(a, b)) for i, r, a, b, _ in segs}


def test_empty_tables(frame):
    none = frame(SEG, (0, "x", 0, 1, "CHI")).where("false")
    assert interval.overlap_flags(none).count() == interval.subtract_others(none, "row_no").count() == interval.exclude(none, none).count() == 0
