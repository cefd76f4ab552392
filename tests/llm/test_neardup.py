from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import values
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import prose, words
from llm.test_decontaminate import grams

from earshot.llm import components, neardup


def unite(pairs, nodes=()):
    root = {n: n for n in nodes}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in root}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(50, 99)], [(i, i * 7919 % 100) for i in range(100)], [(3, 2), (2, 3), (3, 2), (None, 1), (2, None)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    want = unite([e for e in edges if None not in e and e[0] != e[1]])
    assert dict(values(components.components(df))) == want


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10_000))
def test_forest_joins_what_all_pairs_join(seed):
    rng = np.random.default_rng(seed)
    sig = rng.integers(0, 3, (rng.integers(1, 14), 10)).astype(np.uint32)
    n = len(sig)
    pairs = [(i, j) for i in range(n) for j in range(i) if (sig[i] == sig[j]).sum() >= 6]
    got = neardup.join_similar(sig, 6)
    assert unite(got, range(n)) == unite(pairs, range(n)) and len(got) < n


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[1000:]
    assert abs((neardup.signature(a, 1000) == neardup.signature(b, 1000)).mean() - 1 / 3) < 0.06


def corpus(rng, bases=60):
    rows = []
    for _ in range(bases):
        w = words(rng, rng.choice([6, 40, 200, 2000]))
        for _ in range(rng.choice([1, 1, 2, 4])):
            copy = ["zz" + str(rng.random())[2:5] if rng.random() < rng.choice([0, 0.02, 0.08]) else x for x in w]
            rows.append((len(rows), rng.choice([" ", "\n", ". "]).join(copy)))
    return rows


def test_recall_against_brute_force(docs):
    rows = corpus(random.Random(4))
    sets = [grams(t) for _, t in rows]
    jaccard = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a | b}
    got = {r[0]: r[1] for r in values(neardup.near_duplicates(docs(*rows).repartition(5)))}
    same = lambda i, j: i in got and got[i] == got.get(j)
    close = [p for p, s in jaccard.items() if s >= 0.55]
    assert len(close) > 40 and np.mean([same(*p) for p in close]) >= 0.97
    # a group may chain over several copies, but only by pairs that are alike
    loose = unite([p for p, s in jaccard.items() if s >= 0.33], range(len(rows)))
    assert all(loose[d] == loose[g] for d, g in got.items())
    assert all(g == min(d for d in got if got[d] == g) for g in got.values())
    sizes = {r[0]: r[2] for r in values(neardup.near_duplicates(docs(*rows)))}
    assert all(sizes[d] == list(got.values()).count(g) > 1 for d, g in got.items())
    kept = {r[0] for r in values(neardup.keep_one(docs(*rows)), "doc_id")}
    assert kept == {d for d, _ in rows} - {d for d, g in got.items() if d != g}


def test_hot_groups(docs):
    rng = random.Random(7)
    base = words(rng, 100)
    rows = [(i, " ".join(base[:50] + [f"x{i % 40}"] + base[50:])) for i in range(1500)] + [(2000, prose(rng, 100))]
    got = values(neardup.near_duplicates(docs(*rows)))
    assert len(got) == 1500 and {r[1:] for r in got} == {(0, 1500)}


def test_odd_rows(odd, none, docs):
    got = values(neardup.near_duplicates(odd))
    assert got == [(5, 5, 2), (6, 5, 2)]
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    # 6 is a copy of 5; the rows of id 7 are equal, those of 8 unlike; both rows without an id stay
    assert [r[0] for r in values(kept, "doc_id")] == [1, 2, 3, 4, 5, 7, 8, 8, 9, 10, 11, 12, None, None]
    assert neardup.near_duplicates(none).count() == neardup.keep_one(none).count() == 0
    ties = docs((3, "a b c d"), (2, "A, b. c d"), (9, "x"), (8, "x"), (7, None), (6, None))
    assert values(neardup.near_duplicates(ties)) == [(2, 2, 2), (3, 2, 2), (8, 8, 2), (9, 8, 2)]
    with pytest.raises(ValueError):
        neardup.near_duplicates(ties, bands=1000, rows=9)


def test_rows_of_one_id_are_lost_only_as_copies(docs):
    rows = [(7, "one text of its own kind"), (7, "quite another thing here"), (7, "one text of its own kind"), (9, "one text, of its own kind!")]
    assert sorted(r[1] for r in values(neardup.keep_one(docs(*rows)), "doc_id", "text")) == ["one text of its own kind", "quite another thing here"]


def test_columns_of_any_name_come_back_as_they_were(spark):
    names = "doc_id bigint, text string, `_nd_node` string, `_nd_nth` string, `node` string, place_file string, place_row string, place_part string, c0 string, _metadata string, `a.b` string"
    extra = [f"x{i}" for i in range(9)]
    df = spark.createDataFrame([(1, "a b c d e", *extra), (2, "a b c d e", *extra), (3, "z y x", *extra)], names)
    got = neardup.keep_one(df)
    assert got.columns == df.columns and values(got) == [(1, "a b c d e", *extra), (3, "z y x", *extra)]


@pytest.mark.parametrize("block", [4, 16, 2048])
def test_buckets_of_unlike_members(docs, spark, block):
    """Texts that share many bands and few words: all links that the bands allow are found, whatever the size of the blocks."""
    rng = random.Random(11)
    base, rows = words(rng, 60), []
    for i in range(120):
        keep = rng.choice([0.35, 0.6, 0.9])
        rows.append((i, " ".join(base[: int(60 * keep)] + [f"u{i}w{j}" for j in range(60 - int(60 * keep))])))
    k = neardup.BANDS * neardup.ROWS
    sets = {i: np.unique(next(neardup.shingles(pa.array([t]), neardup.SHINGLE))[1]) for i, t in rows}
    sig = {i: neardup.signature(x, k) for i, x in sets.items()}
    bands = {i: s.reshape(neardup.BANDS, neardup.ROWS) for i, s in sig.items()}
    pairs = [(i, j) for i in sig for j in sig if i < j and (bands[i] == bands[j]).all(axis=1).any() and (sig[i] == sig[j]).sum() >= k / 2]
    shared = sum((bands[i] == bands[j]).all(axis=1).any() for i in sig for j in sig if i < j)
    assert shared > 2 * len(pairs) > 0
    want = unite(pairs)
    assert {r[0]: r[1] for r in values(neardup.near_duplicates(docs(*rows).repartition(3), block=block))} == want


def test_a_bucket_of_unlike_signatures_is_shared_by_several_tasks(spark):
    """One band's key for all rows and nothing else in common: units of at most two blocks, none with a bucket as a whole."""
    n, k = 4000, neardup.BANDS * neardup.ROWS
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 1 << 32, (n, k), dtype=np.uint64).astype(np.uint32)
    sig[:, : neardup.ROWS] = 5
    sig[n - 1], sig[n - 1, -1] = sig[7], 1
    df = spark.createDataFrame([(i, i, i, sig[i].tobytes()) for i in range(n)], "node bigint, s1 bigint, s2 bigint, sig binary").repartition(4)
    assert values(neardup.similar_groups(neardup.cut(df), 0.5, neardup.BANDS, neardup.ROWS, block=512)) == [(7, 7), (n - 1, 7)]
