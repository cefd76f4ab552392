from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from conftest import values

from earshot.operators import reliability
from earshot.plans.queries import QUERIES

SEG = "set string, recording_filename string, segment_onset bigint, segment_offset bigint, speaker_type string"


def ranges(frame, a, b):
    return frame("recording_filename string, range_onset bigint, range_offset bigint", ("x", a, b))


@pytest.fixture
def grid_rows(frame):
    return frame(SEG, ("a", "x", 0, 2, "CHI"), ("a", "x", 2, 4, "FEM"), ("a", "x", 6, 8, "CHI"), ("a", "x", 6, 9, "FEM"))


def test_frames_and_labels(frame, grid_rows):
    grid = reliability.frames(grid_rows, ranges(frame, 0, 10), 1, ["CHI", "FEM"], overlap=True)
    active = {}
    for f, c in values(reliability.each_frame(grid), "frame", "category"):
        active.setdefault(f, set()).add(c)
    assert active == {0: {"CHI"}, 1: {"CHI"}, 2: {"FEM"}, 3: {"FEM"}, 4: {"none"}, 5: {"none"}, 6: {"CHI", "FEM", "overlap"}, 7: {"CHI", "FEM", "overlap"}, 8: {"FEM"}, 9: {"none"}}
    got = [r[1] for r in values(reliability.each_frame(reliability.labels(grid, ["CHI", "FEM", "overlap", "none"])), "frame", "label")]
    assert got == ["CHI", "CHI", "FEM", "FEM", "none", "none", "overlap", "overlap", "FEM", "none"]
    rest = reliability.each_frame(reliability.labels(grid, ["CHI", "FEM"], rest=True))
    assert values(rest.where("frame = 4"), "label") == [("FEM",)] and rest.count() == 10
    assert values(reliability.segments_of(grid, 10).where("category = 'FEM'"), *reliability.SEGMENT) == [(20, 40), (60, 90)]
    assert reliability.frames(grid_rows.where("false"), ranges(frame, 0, 10), 1, ["CHI"]).count() == 0


def test_frames_stay_in_the_range(frame):
    seg = frame(SEG, ("a", "x", -50, 25, "CHI"), ("a", "x", 25, 29, "FEM"), ("a", "x", 95, 300, "FEM"))
    grid = reliability.each_frame(reliability.frames(seg, ranges(frame, 0, 100), 10, ["CHI", "FEM"], none=False))
    assert values(grid, "frame", "category") == [(0, "CHI"), (1, "CHI"), (9, "FEM")]


def test_confusion(frame):
    seg = frame(SEG, ("Alice", "x", 0, 5, "CHI"), ("Alice", "x", 5, 12, "FEM"), ("Bob", "x", 0, 10, "CHI"), ("Bob", "x", 10, 15, "FEM"))
    grid = reliability.frames(seg, ranges(frame, 0, 20), 1, ["CHI", "FEM"], overlap=True)
    assert values(reliability.confusion(grid, "Bob", "Alice")) == [("CHI", "CHI", 5), ("CHI", "FEM", 5), ("FEM", "FEM", 2), ("FEM", "none", 3), ("none", "none", 5)]
    r = reliability.error_rates(grid, "Alice", "Bob").first()
    assert (r["reference"], r["missed"], r["false_alarm"], r["confused"]) == (12, 0, 3, 5) and r["identification_error_rate"] == pytest.approx(8 / 12)


#: Four annotators, twelve items, some of them missing.
RATINGS = {"A": "1 2 3 3 2 1 4 1 2 . . .", "B": "1 2 3 3 2 2 4 1 2 5 . 3", "C": ". 3 3 3 2 3 4 2 2 5 1 .", "D": "1 2 3 3 2 4 4 1 2 5 1 ."}


def test_alpha(frame):
    rows = [("x", i, who, v) for who, text in RATINGS.items() for i, v in enumerate(text.split()) if v != "."]
    df = frame("recording_filename string, frame int, coder string, label string", *rows)
    r = reliability.krippendorff_alpha(df).first()
    assert r["alpha"] == pytest.approx(0.743421052632) and r["n_pairable"] == 40
    assert reliability.krippendorff_alpha(df.where("coder = 'A'")).first()["alpha"] is None


def test_kappa_of_two(frame):
    # agreement 0.7, chance 0.5: kappa 0.4
    pairs = [("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15
    df = frame("recording_filename string, frame int, coder string, label string", *[("x", i, c, p[j]) for i, p in enumerate(pairs) for j, c in enumerate("ab")])
    assert reliability.multi_kappa(df, ["a", "b"]).first()["kappa"] == pytest.approx(0.4)


def test_whole_recordings_by_brute_force(spark, tmp_path):
    """All days count, and what is counted by runs is what a grid of frames gives."""
    rng, kinds = random.Random(4), {"click": "CHI", "view": "FEM", "purchase": "MAL", "signup": "OCH", "error": "NA"}
    begin, day = datetime(2024, 1, 1), 1440
    rows = [(i, i % 2, begin + timedelta(minutes=rng.randrange(5 * day)), rng.choice([*kinds]), float(rng.randrange(1, 40))) for i in range(60)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp_ntz, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    order = ["CHI", "FEM", "MAL", "OCH", "none"]
    segs = [(f"rec{u}", int((ts - begin).total_seconds()) * 1000, int((ts - begin).total_seconds()) * 1000 + round(v * 100) * 1000, kinds[e], i) for i, u, ts, e, v in rows]
    grid = {}
    for rec in ("rec0", "rec1"):
        n = -(-max(s[2] for s in segs if s[0] == rec) // 60_000)
        grid |= {(rec, c, f): set() for c in "ab" for f in range(n)}
    for rec, on, off, kind, i in segs:
        for coder, start, label in (("a", on, kind), ("b", on + 30_000, "FEM" if i % 5 == 0 else kind)):
            for f in range(start // 60_000, off // 60_000) if label != "NA" else ():
                grid[rec, coder, f].add(label)
    active = {k: v or {"none"} for k, v in grid.items()}
    label = {k: max(v, key=order.index) for k, v in active.items()}
    run = lambda name: values(QUERIES[name](spark, str(tmp_path)))
    assert run("frame_grid") == sorted((r, c, x, n) for (r, c, x), n in Counter((r, c, x) for (r, c, _), v in active.items() for x in v).items())
    assert run("frame_labels") == sorted((r, c, x, n) for (r, c, x), n in Counter((r, c, x) for (r, c, _), x in label.items()).items())
    at = [(r, f) for r, c, f in active if c == "a"]
    assert run("confusion_matrix") == sorted((x, y, n) for (x, y), n in Counter((x, y) for r, f in at for x in active[r, "a", f] for y in active[r, "b", f]).items())
    n, counts = len(at), Counter(label.values())
    observed = sum(label[r, "a", f] != label[r, "b", f] for r, f in at) / n
    expected = (4 * n * n - sum(c * c for c in counts.values())) / (2 * n * (2 * n - 1))
    assert run("krippendorff_alpha")[0] == pytest.approx((1 - observed / expected, 2 * n, observed, expected), abs=1e-6)
    one, two = (Counter(x for (_, c, _), x in label.items() if c == who) for who in "ab")
    chance = sum(one[x] * two[x] for x in order) / n / n
    assert run("multi_kappa")[0] == pytest.approx((1 - observed / (1 - chance), 1 - observed, chance), abs=1e-6)
    pairs = [(grid[r, "a", f], grid[r, "b", f]) for r, f in at]
    reference, missed, alarm, confused = (sum(x) for x in zip(*((len(r), max(len(r) - len(h), 0), max(len(h) - len(r), 0), min(len(r), len(h)) - len(r & h)) for r, h in pairs)))
    assert run("error_rates")[0] == pytest.approx((reference, missed, alarm, confused, (missed + alarm) / reference, (missed + alarm + confused) / reference), abs=1e-6)
