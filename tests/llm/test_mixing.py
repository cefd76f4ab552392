from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import values
from hypothesis import given, settings
from hypothesis import strategies as st

from earshot.llm import mixing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=0, max_size=40), st.integers(0, 1000))
def test_rounding_keeps_the_sum(p, seed):
    got, at = mixing.pivotal(np.array(p), np.arange(len(p)), seed)
    whole = np.delete(got, at) if at >= 0 else got
    assert set(whole.tolist()) <= {0.0, 1.0} and abs(got.sum() - sum(p)) < 1e-6
    assert at < 0 or 0 < got[at] < 1


def test_rounding_keeps_expectations():
    p = np.array([0.1, 0.5, 0.9, 0.3, 0.7, 0.25, 0.25])
    total = sum(mixing.pivotal(p, np.arange(7) * 77 + 5, s)[0] for s in range(6000)) / 6000
    assert np.abs(total - p).max() < 0.03


@pytest.mark.parametrize("leaf_rows", [4096, 16, 2])
def test_targets_are_met_to_within_one(docs, leaf_rows):
    rng = random.Random(leaf_rows)
    rows = [(i, "t", "en", rng.choice("aaaaaabbc")) for i in range(2000)]
    n = Counter(r[3] for r in rows)
    got = values(mixing.copies(docs(*rows).repartition(5), {"a": 1.0, "b": 3.0, "c": 2.0}, 3000, leaf_rows=leaf_rows))
    assert len(got) == 2000
    sums, expected = defaultdict(int), {"a": 500, "b": 1500, "c": 1000}
    for _, s, _, e, c in got:
        sums[s] += c
        assert abs(e - expected[s] / n[s]) < 1e-9 and c in (math.floor(e), math.floor(e) + 1)
    assert all(abs(sums[s] - expected[s]) < 1 + 1e-6 for s in expected)
    again = values(mixing.copies(docs(*rows).repartition(3), {"a": 1.0, "b": 3.0, "c": 2.0}, 3000, leaf_rows=leaf_rows))
    assert again == got


def test_each_document_gets_its_expectation_over_seeds(docs):
    df = docs(*[(i, "t", "en", "ab"[i % 3 == 0]) for i in range(60)]).cache()
    total = Counter()
    for seed in range(12):
        for d, _, _, _, c in values(mixing.copies(df, {"a": 1.0, "b": 1.0}, 45, seed=seed, leaf_rows=8)):
            total[d] += c
    a = [total[i] / 12 for i in range(60) if i % 3]
    assert abs(np.mean(a) - 22.5 / 40) < 0.05 and 0.08 < np.std(a) < 0.22


def test_default_shares(docs):
    rows = [(i, "t", "en", "big" if i < 900 else "small") for i in range(1000)]
    got = Counter()
    for _, s, _, _, c in values(mixing.copies(docs(*rows))):
        got[s] += c
    share = 900**0.7 / (900**0.7 + 100**0.7)
    assert abs(got["big"] - 1000 * share) < 1.001 and sum(got.values()) in (999, 1000, 1001)


def test_odd_rows(odd, none, docs):
    got = values(mixing.copies(odd))
    assert len(got) == odd.count() and [r[2] for r in got if r[0] == 7] == [0, 1]
    mixed = mixing.mix_sources(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r[4] for r in got)
    assert mixing.copies(none).count() == mixing.mix_sources(none).count() == 0
    twice = values(mixing.mix_sources(docs((1, "a"), (1, "a"), (1, "b"), (None, None, None, None)), total=8.0, weights={"s": 3.0, None: 1.0}), "doc_id", "text")
    assert len(twice) == 8 and twice.count((None, None)) == 2
    assert sum(r[4] for r in values(mixing.copies(odd, {"nowhere": 1.0}))) == 0
    for bad in ({"s": -1.0}, {"s": float("inf")}):
        with pytest.raises(ValueError):
            mixing.copies(odd, bad)


def serial(rows, expected, leaf_rows, seed):
    """The two trees one pair at a time: rows are (source, id, key, hash of source); gives copies by (source, id)."""
    unsigned = lambda x: x & ((1 << 64) - 1)
    deep = lambda n: max(0, math.ceil(math.log2(max(1, n) / leaf_rows)))
    p = {r[:2]: expected[r[0]] % 1.0 for r in rows}

    def reduce(members, level):
        left = None
        for r in sorted(members, key=lambda r: (r[2], r[3])):
            u = float(mixing.uniform(np.array([r[2]], np.int64), seed * 64 + level)[0])
            x = r[:2]
            if min(p[x], 1 - p[x]) < mixing.WHOLE:
                p[x] = round(p[x])
            elif left is None:
                left = r
            else:
                y = left[:2]
                a, b = p[y], p[x]
                if a + b < 1:
                    stays, p[y], p[x] = (left, a + b, 0) if u < a / (a + b) else (r, 0, a + b)
                else:
                    stays, p[y], p[x] = (r, 1, a + b - 1) if u < (1 - b) / (2 - a - b) else (left, a + b - 1, 1)
                if min(p[stays[:2]], 1 - p[stays[:2]]) < mixing.WHOLE:
                    p[stays[:2]], stays = round(p[stays[:2]]), None
                left = stays
        return left

    def level_of(members, level, by):
        groups = defaultdict(list)
        for r in members:
            groups[by(r)].append(r)
        return [r for g in groups.values() if (r := reduce(g, level)) is not None]

    bits = deep(max(Counter(r[0] for r in rows).values()))
    leaf = lambda h, n: unsigned(h) >> (64 - n) if n else 0
    now, n = level_of(rows, 0, lambda r: (r[0], leaf(r[2], bits))), 0
    while bits > 0:
        bits, n = max(0, bits - mixing.FAN_IN_BITS), n + 1
        now = level_of(now, n, lambda r: (r[0], leaf(r[2], bits)))
    bits = deep(len(expected)) + mixing.FAN_IN_BITS
    while bits > 0:
        bits, n = max(0, bits - mixing.FAN_IN_BITS), n + 1
        now = level_of(now, n, lambda r: leaf(r[3], bits))
    return {r[:2]: math.floor(expected[r[0]]) + p[r[:2]] for r in rows}, {r[:2] for r in now}


@pytest.mark.parametrize("leaf_rows, sources", [(4096, 3), (2, 40)])
def test_against_a_serial_tree(docs, leaf_rows, sources):
    rng = random.Random(leaf_rows)
    df = docs(*[(i, "t", "en", f"s{int(rng.random() ** 3 * sources)}") for i in range(500)]).repartition(4)
    hashes = df.selectExpr("source", "doc_id", "xxhash64(source, doc_id, 0)", "xxhash64(source)")
    got = values(mixing.copies(df, total=333.25, leaf_rows=leaf_rows, seed=5))
    want, open_ = serial([tuple(r) for r in hashes.collect()], {r[1]: r[3] for r in got}, leaf_rows, 5)
    assert len(open_) <= 1 and all(c == want[s, d] for d, s, _, _, c in got if (s, d) not in open_)
    assert abs(sum(r[4] for r in got) - 333.25) < 1 + 1e-6


def test_columns_of_any_name_come_back_as_they_were(spark):
    names = "doc_id bigint, text string, source string, `_mix_id` string, `_mix_at` string, `_mix_copy` string, place_file string, copies string, n string, c0 string"
    df = spark.createDataFrame([(i, f"t{i}", "s", *[f"x{i}{j}" for j in range(7)]) for i in range(5)], names)
    got = mixing.mix_sources(df, total=10.0)
    assert got.columns == df.columns and values(got) == sorted([tuple(r) for r in df.collect()] * 2)


def test_many_rows_without_an_id(docs):
    rows = [(None, f"t{i}", "en", "s") for i in range(50)] + [(1, "u", "en", "s")] * 3
    assert Counter(r[0] for r in values(mixing.mix_sources(docs(*rows), total=53.0), "text")) == Counter([f"t{i}" for i in range(50)] + ["u"] * 3)
