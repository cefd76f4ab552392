from __future__ import annotations

import random

import pytest
from conftest import values

from earshot.llm import linededup


def brute(rows):
    first, out = {}, []
    order = lambda d: (d is None, d or 0)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if line and (line not in first or order(d) < order(first[line])):
                first[line] = d
    for d, t in rows:
        if t is None:
            out.append((d, None, 0))
            continue
        keep, have = [], set()
        lines = t.split("\n")
        for line in lines:
            if not line or (first[line] == d and line not in have):
                keep.append(line)
            have.add(line)
        out.append((d, "\n".join(keep), len(lines) - len(keep)))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


@pytest.mark.parametrize("seed, most_bits", [(1, 1 << 29), (2, 1 << 16)])
def test_against_brute_force(docs, seed, most_bits):
    rng = random.Random(seed)
    pool = [f"line {i}" + "é" * (i % 3) for i in range(60)] + [""]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"own {rng.random()}" for _ in range(rng.randint(0, 12)))) for i in range(150)]
    got = values(linededup.dedup_lines(docs(*rows).repartition(6), most_bits=most_bits))
    assert got == brute(rows)


def test_odd_rows(odd, none):
    got = linededup.dedup_lines(odd)
    assert got.columns == ["doc_id", "text", "lines_removed"]
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)
    assert linededup.dedup_lines(none).count() == 0


def test_first_is_the_least_id(docs):
    rows = [(9, "a\nb"), (3, "b\nc\nb"), (None, "c\nz"), (5, "a")]
    assert values(linededup.dedup_lines(docs(*rows))) == [(3, "b\nc", 1), (5, "a", 0), (9, "", 2), (None, "z", 1)]
