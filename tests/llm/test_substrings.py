from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from conftest import values
from llm.conftest import prose, words
from pyspark.sql import functions as F

from earshot.llm import substrings


def order(x):
    return x is None, x or 0


def brute(rows, n):
    """Every run of n words with its first place; each document's runs joined where they follow on both here and there."""
    runs = defaultdict(list)
    for d, t in set(rows):
        w = (t or "").split()
        for i in range(len(w) - n + 1):
            runs[tuple(w[i : i + n])].append((d, i))
    at = {}
    for places in runs.values():
        first = min(places, key=lambda p: (order(p[0]), p[1]))
        for d, i in places:
            before = [j for e, j in places if e == d and j < i]
            if before or (d, i) != first:
                at[d, i] = (d, max(before)) if before else first
    out = []
    for d, i in at:
        if (d, i - 1) in at and at[d, i - 1] == (at[d, i][0], at[d, i][1] - 1):
            continue
        j = i
        while (d, j + 1) in at and at[d, j + 1] == (at[d, j][0], at[d, j][1] + 1):
            j += 1
        out.append((d, i, j + n, j - i + n, *at[d, i]))
    out += {(f, p, p + size, size, f, p) for _, _, _, size, f, p in out}
    return sorted(out, key=lambda r: (order(r[0]), r[1], r[2], order(r[4]), r[5]))


def spans(df, **k):
    return sorted(values(substrings.repeated_spans(df, **k)), key=lambda r: (order(r[0]), r[1], r[2], order(r[4]), r[5]))


@pytest.mark.parametrize("n, seed, most_bits", [(2, 1, 1 << 30), (5, 2, 1 << 30), (8, 3, 1 << 16), (9, 4, 1 << 30), (50, 5, 1 << 30)])
def test_against_brute_force(docs, n, seed, most_bits):
    rng = random.Random(seed)
    shared = [words(rng, rng.randint(n - 1, 3 * n)) for _ in range(5)]
    rows = []
    for i in range(50):
        w = words(rng, rng.randint(0, 40))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            s = rng.choice(shared)
            w[at:at] = s[rng.randint(0, 2) : len(s) - rng.randint(0, 2)]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    got = spans(docs(*rows).repartition(5), min_words=n, most_bits=most_bits)
    assert got == brute(rows, n) and got


def test_hot_passages_and_repeats_within_one(docs):
    rng = random.Random(9)
    passage = prose(rng, 60)
    rows = [(i, f"{prose(rng, i % 7)} {passage} {prose(rng, 5)}") for i in range(300)] + [(1000, f"{passage} x {passage}")]
    assert spans(docs(*rows)) == brute(rows, 50)
    twice = [(1, " ".join(["la"] * 120))]
    assert spans(docs(*twice)) == brute(twice, 50) and spans(docs(*twice)) == [(1, 0, 119, 119, 1, 0), (1, 1, 120, 119, 1, 0)]
    line = [(1, " ".join(f"w{i % 12}" for i in range(200)))]
    assert spans(docs(*line)) == brute(line, 50)


def test_texts_are_equal_over_each_span(docs):
    """A passage of which one half is in one document and one in another is two spans, not one."""
    rng = random.Random(2)
    one, two = words(rng, 70), words(rng, 70)
    rows = [(1, " ".join(one)), (2, " ".join(two)), (3, " ".join(one + two)), (4, " ".join(one[10:] + two[:60]))]
    text = {d: t.split() for d, t in rows}
    got = spans(docs(*rows))
    assert got == brute(rows, 50)
    assert all(text[d][a:b] == text[f][p : p + n] for d, a, b, n, f, p in got)
    assert [r for r in got if r[0] == 3 and r[4] != 3] == [(3, 0, 70, 70, 1, 0), (3, 70, 140, 70, 2, 0)]
    # what crosses the seam is first in 3 itself
    assert any(r[0] == 4 and r[4] == 3 for r in got)


def test_odd_rows(odd, none):
    got = spans(odd)
    assert got == [(5, 0, 60_000, 60_000, 5, 0), (6, 0, 60_000, 60_000, 5, 0)]
    assert substrings.repeated_spans(none).count() == 0
    with pytest.raises(ValueError):
        substrings.repeated_spans(odd, min_words=1)


def test_rows_of_one_id(docs):
    t, u = prose(random.Random(1), 55), prose(random.Random(2), 55)
    assert spans(docs((1, t), (1, t), (None, t))) == [(1, 0, 55, 55, 1, 0), (None, 0, 55, 55, 1, 0)]
    assert spans(docs((1, t), (1, t))) == []
    # two texts of one id are apart: the halves of a passage in both are no repeat of the whole
    got = spans(docs((1, t), (1, u), (2, f"{t} {u}")))
    assert [r for r in got if r[0] == 2] == [(2, 0, 55, 55, 1, 0), (2, 55, 110, 55, 1, 0)]


@pytest.mark.parametrize("at_once", [1, 40])
def test_many_small_portions(docs, monkeypatch, at_once):
    rng = random.Random(4)
    passage = words(rng, 30)
    rows = [(i, " ".join(words(rng, 3) + passage[i % 5 : 20 + i % 9] + words(rng, 2))) for i in range(30)]
    rows += [(30, None), (None, rows[3][1])]
    table = docs(*rows).coalesce(1)
    have = bits_of(table, 6)
    parts = list(substrings._candidates(*have, 6, 3)(iter(pa_batches(table))))
    whole = pa.Table.from_batches(parts)
    assert whole.num_rows
    monkeypatch.setattr(substrings, "AT_ONCE", at_once)
    apart = pa.Table.from_batches(substrings._candidates(*have, 6, 3)(iter(pa_batches(table))))
    assert apart.num_rows == whole.num_rows
    rows_of = lambda t: sorted(map(str, pa.Table.from_batches(list(substrings._resolve(iter(t.filter(pc.is_valid(t.column("hs"))).sort_by("m").to_batches(max_chunksize=3))))).to_pylist()))
    assert set(rows_of(apart)) == set(rows_of(whole))


def bits_of(table, min_words):
    """Filters that hold everything, so that all runs are candidates."""
    ones = np.full(1 << 13, 255, np.uint8)
    return {"once": ones, "twice": ones}, 16


def pa_batches(table):
    return table.select("doc_id", "text", F.xxhash64("text").alias("version")).toArrow().combine_chunks().to_batches()
