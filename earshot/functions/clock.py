"""Times of day in integer milliseconds, and their circular intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000
HOUR = 3_600_000
_TIME = r"^\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\s*$"


def parse_time(col: Column | str) -> Column:
    """Milliseconds since midnight of an H:MM or H:MM:SS string; null where it is neither."""
    c = F.col(col) if isinstance(col, str) else col
    part = lambda i: F.regexp_extract(c, _TIME, i)
    h, m = part(1).try_cast("int"), part(2).try_cast("int")
    s = F.coalesce(part(3).try_cast("int"), F.lit(0))
    return F.when(c.rlike(_TIME) & (h < 24) & (m < 60) & (s < 60), ((h * 60 + m) * 60 + s).cast("bigint") * 1000)


def time_ms(text: str) -> int:
    """``parse_time`` for a constant; raises ValueError where it would be null."""
    parts = text.strip().split(":")
    if len(parts) not in (2, 3) or not all(p.isdigit() for p in parts):
        raise ValueError(f"{text!r} is no time of day")
    h, m, s = (*map(int, parts), 0)[:3]
    if h > 23 or m > 59 or s > 59:
        raise ValueError(f"{text!r} is no time of day")
    return ((h * 60 + m) * 60 + s) * 1000


def format_time(ms: Column, seconds: bool = False) -> Column:
    """HH:MM or HH:MM:SS of milliseconds, modulo a day."""
    day = F.pmod(ms, F.lit(DAY))
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    parts = [two(day / HOUR), two(F.pmod(day, F.lit(HOUR)) / 60_000)]
    return F.concat_ws(":", *parts, *([two(F.pmod(day, F.lit(60_000)) / 1000)] if seconds else []))


def circular_intersect(a: tuple[int, int], b: tuple[int, int]) -> list[tuple[int, int]]:
    """The times that two daily intervals share: none, one or two intervals. start > stop wraps midnight; start == stop is the whole day."""
    pieces = lambda x: [(x[0], x[1])] if x[0] < x[1] else [p for p in ((x[0], DAY), (0, x[1])) if p[0] < p[1]]
    found = sorted((max(p[0], q[0]), min(p[1], q[1])) for p in pieces(a) for q in pieces(b) if max(p[0], q[0]) < min(p[1], q[1]))
    joined: list[tuple[int, int]] = []
    for p in found:
        if joined and joined[-1][1] == p[0]:
            joined[-1] = (joined[-1][0], p[1])
        else:
            joined.append(p)
    if len(joined) > 1 and joined[0][0] == 0 and joined[-1][1] == DAY:
        joined = [(joined[-1][0], joined[0][1]), *joined[1:-1]]
    return [(0, 0) if p == (0, DAY) else (p[0], p[1] % DAY) for p in joined]
