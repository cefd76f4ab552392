from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from earshot.llm import bits, textkit


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té.X1", max_size=30)), max_size=8), st.integers(1, 5))
def test_tokens_against_split(texts, n):
    column = pa.array(texts, pa.string())
    for parts, table, split in ((textkit.SPACES, textkit.EXACT, lambda t: [w for w in re.split(r"[ \t\n\v\f\r]+", t) if w]), (textkit.NOT_WORD, textkit.FOLDED, lambda t: [w for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w]), (textkit.NEWLINE, textkit.EXACT, lambda t: [w for w in t.split("\n") if w])):
        data, at = textkit.buffers(column)
        h, starts, ends, rows = textkit.tokens(data, at, parts, table)
        want = [split(t or "") for t in texts]
        assert np.diff(rows).tolist() == [len(w) for w in want]
        flat = [w for ws in want for w in ws]
        assert len(set(h.tolist())) == len(set(flat)) and len(set(zip(flat, h.tolist()))) == len(set(flat))
        for ws, a, b in zip(want, rows, rows[1:]):
            runs = textkit.rolling(h[a:b], n)
            assert len(runs) == max(0, len(ws) - n + 1)
            grams = [tuple(ws[i : i + n]) for i in range(len(runs))]
            assert len(set(zip(grams, runs.tolist()))) == len(set(grams)) == len(set(runs.tolist()))


def test_slices_and_chunks():
    column = pa.array(["aa bb", None, "cc", "dd ee ff", ""])
    data, at = textkit.buffers(column.slice(2, 3))
    assert textkit.tokens(data, at)[3].tolist() == [0, 1, 4, 4]
    assert list(textkit.chunks(np.array([0, 5, 100, 101, 102]), 10)) == [(0, 1), (1, 2), (2, 4)]
    assert list(textkit.chunks(np.array([0]))) == []


def test_filters_have_no_false_negatives(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 300, 2000)
    df = spark.createDataFrame([(int(k),) for k in keys], "k long").repartition(5)
    mixed = lambda b: textkit.mix(np.asarray(b.column(0)).astype(np.uint64))
    got = bits.build(df, mixed, 16, 3)
    values, counts = np.unique(keys, return_counts=True)
    h = textkit.mix(values.astype(np.uint64))
    assert bits.holds(got["once"], h, 16, 3).all() and bits.holds(got["twice"], h[counts > 1], 16, 3).all()
    others = textkit.mix(np.arange(10_000, 20_000, dtype=np.uint64))
    assert bits.holds(got["once"], others, 16, 3).mean() < 0.01
