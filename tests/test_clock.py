from __future__ import annotations

import pytest
from conftest import values
from pyspark.sql import functions as F

from earshot.functions import clock as fc
from earshot.operators import clock

H = fc.HOUR


def test_times_are_parsed(frame):
    df = frame("t string", "3:12", "04:14", "12:19:21", "32:07", "10:77", None, "", "x")
    got = [r[0] for r in df.select(fc.parse_time("t")).collect()]
    assert got == [3 * H + 12 * 60_000, 4 * H + 14 * 60_000, 12 * H + 19 * 60_000 + 21_000, None, None, None, None, None]
    assert fc.time_ms("12:19:21") == got[2]
    with pytest.raises(ValueError):
        fc.time_ms("24:00")


@pytest.mark.parametrize(
    "a, b, shared",
    [
        (("8:57", "21:04"), ("10:36", "22:01"), [("10:36", "21:04")]),
        (("8:57", "22:01"), ("21:04", "10:36"), [("8:57", "10:36"), ("21:04", "22:01")]),
        (("8:57", "3:01"), ("21:04", "7:36"), [("21:04", "3:01")]),
        (("8:00", "9:00"), ("9:00", "10:00"), []),
        (("0:00", "0:00"), ("22:00", "3:00"), [("22:00", "3:00")]),
    ],
)
def test_circular_intersection(a, b, shared):
    ms = lambda p: tuple(map(fc.time_ms, p))
    assert sorted(fc.circular_intersect(ms(a), ms(b))) == sorted(map(ms, shared))
    assert sorted(fc.circular_intersect(ms(b), ms(a))) == sorted(map(ms, shared))


def test_daily_window_over_two_days(frame):
    idx = frame("recording_filename string, set string, range_onset bigint, range_offset bigint", ("1", "auto", 0, 24 * H), ("1", "manual", H, 2 * H), ("2", "auto", 0, 48 * H), ("2", "manual", 25 * H, 26 * H))
    rec = frame("recording_filename string, start_time string", ("1", "08:00"), ("2", "09:30"), ("3", "junk"))
    got = values(clock.within_time_range(idx, rec, 9 * H, 20 * H))
    half = H // 2
    assert got == [
        ("1", "auto", H, 12 * H, "09:00", "20:00"),
        ("1", "manual", H, 2 * H, "09:00", "10:00"),
        ("2", "auto", 0, 10 * H + half, "09:30", "20:00"),
        ("2", "auto", 23 * H + half, 34 * H + half, "09:00", "20:00"),
        ("2", "auto", 47 * H + half, 48 * H, "09:00", "09:30"),
        ("2", "manual", 25 * H, 26 * H, "10:30", "11:30"),
    ]


def test_window_over_midnight(frame):
    idx = frame("recording_filename string, set string, range_onset bigint, range_offset bigint", ("1", "a", 0, 4 * H))
    rec = frame("recording_filename string, start_time string", ("1", "00:30"))
    assert values(clock.within_time_range(idx, rec, 22 * H, 3 * H), "range_onset", "range_offset") == [(0, 2 * H + H // 2)]


def test_timestamps(frame):
    seg = frame("recording_filename string, segment_onset bigint, segment_offset bigint", ("1", 500, 61_000), ("2", 0, 1))
    rec = frame("recording_filename string, start_time string, date_iso string", ("1", "23:59:30", "2020-12-31"), ("2", "9:00", "soon"))
    show = lambda df: [tuple(str(x) if x else None for x in r) for r in df.orderBy("recording_filename").select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS") for c in ("onset_time", "offset_time")]).collect()]
    assert show(clock.segment_timestamps(seg, rec)) == [("2020-12-31 23:59:30.500", "2021-01-01 00:00:31.000"), (None, None)]
    assert show(clock.segment_timestamps(seg, rec, ignore_date=True))[1] == ("1900-01-01 09:00:00.000", "1900-01-01 09:00:00.001")
