from __future__ import annotations

import random

import numpy as np
from conftest import values
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import prose, words
from pyspark.sql import functions as F

from earshot.llm import fingerprint as fp


def brute(text, k, size, sketches):
    """k-mers with their occurrence numbers, the least of each order by hash, kept in text order."""
    t = text.lower()
    h = fp.numbered(text, k)
    grams = [t[i : i + k] for i in range(max(1, len(t) - k + 1))] if t else []
    seen, names = {}, []
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
        names.append((g, seen[g]))
    assert len(names) == len(h) and len(set(zip(names, h.tolist()))) == len(set(names)) == len(set(h.tolist()))
    out = []
    for j in range(sketches):
        key = [((int(x) ^ int(fp._SALT[j])) * int(fp._ODD[j])) & ((1 << 64) - 1) for x in h]
        out.append(tuple(names[i] for i in sorted(sorted(range(len(h)), key=lambda i: key[i])[:size])))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abé", min_size=1, max_size=60), min_size=2, max_size=5), st.integers(1, 6), st.integers(1, 4))
def test_signatures_against_brute_force(texts, k, size):
    rows = [(brute(t, k, size, 4), fp.order_minhash(fp.numbered(t, k), size, 4).tolist()) for t in texts]
    for a, x in rows:
        for b, y in rows:
            assert [p == q for p, q in zip(a, b)] == [p == q for p, q in zip(x, y)]


def agree(a, b):
    s = [fp.order_minhash(fp.numbered(t, 8), 3, 256) for t in (a, b)]
    return float(np.mean(s[0] == s[1]))


def test_falls_with_edits_and_sees_order():
    rng = random.Random(1)
    w = words(rng, 200)
    base = " ".join(w)
    few, more, other = agree(base, base.replace(w[50], "zzz")), agree(base, " ".join(w[:150] + words(rng, 50))), agree(base, prose(rng, 200))
    assert agree(base, base) == 1 and 1 > few > more > other == 0
    # the same k-mers in another order: plain sketches of the set would hardly tell
    moved = agree(base, " ".join(w[100:] + w[:100]))
    assert moved < 0.5 < few


def test_odd_rows(odd, none, docs):
    got = fp.fingerprints(odd)
    assert got.columns == ["doc_id", "n_kmers", "signature", "fingerprint"] and got.count() == odd.count()
    assert values(got.where("signature is null"), "doc_id", "n_kmers", "fingerprint") == [(2, 0, None), (3, 0, None), (None, 0, None)]
    assert got.where("doc_id in (5, 6)").select("fingerprint").distinct().count() == 1
    assert values(got.where("doc_id = 7"), "n_kmers") == [(1,), (1,)] and got.where("signature is not null and size(signature) != 16").count() == 0
    assert fp.fingerprints(none).count() == 0


def test_agreement(docs):
    df = fp.fingerprints(docs((1, "the same text of words"), (2, "the same text of words"), (3, "quite another story there")))
    a, b = df.select(F.col("doc_id").alias("i"), F.col("signature").alias("a")), df.select(F.col("doc_id").alias("j"), F.col("signature").alias("b"))
    assert values(a.crossJoin(b).where("i < j"), "i", "j", fp.agreement("a", "b")) == [(1, 2, 1.0), (1, 3, 0.0), (2, 3, 0.0)]


def test_numbers_of_occurrences_by_brute_force():
    """Equal values where k-mer and number of occurrence are equal, in and between texts, and nowhere else."""
    rng = random.Random(21)
    seen = {}
    for _ in range(60):
        t = "".join(rng.choice("abé") for _ in range(rng.randint(0, 60)))
        k = 3
        count, want = {}, []
        for i in range(max(1, len(t) - k + 1) if t else 0):
            g = t[i : i + k]
            want.append((g, count.get(g, 0)))
            count[g] = count.get(g, 0) + 1
        got = fp.numbered(t, k).tolist()
        assert len(got) == len(want)
        for name, value in zip(want, got):
            assert seen.setdefault(name, value) == value
    assert len(set(seen.values())) == len(seen)
