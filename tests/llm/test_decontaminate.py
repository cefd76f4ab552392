from __future__ import annotations

import random
import re

import pytest
from conftest import values
from llm.conftest import prose, words

from earshot.llm import decontaminate


def grams(text, n=3):
    w = [x for x in re.split(r"[\x00-/:-@\[-`{-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def runs(text, most=3):
    return {g for n in range(1, most + 1) for g in grams(text, n) if len(g) == n}


def brute(docs, items, threshold=0.7):
    out = set()
    for d, t in docs:
        have = runs(t)
        for i, x in items:
            q = grams(x)
            if q and len(q & have) >= threshold * len(q) - 1e-9:
                out.add((d, i, len(q & have), len(q), round(len(q & have) / len(q), 6)))
    return sorted(out, key=lambda r: ((r[0] is None, r[0] or 0), (r[1] is None, r[1] or 0)))


@pytest.fixture
def bench(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "item_id bigint, text string")


def test_recall_against_brute_force(docs, bench):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.choice([1, 2, 5, 12, 30, 90, 300]))) for i in range(60)]
    rows = []
    for d in range(120):
        w = words(rng, rng.choice([0, 3, 40, 400, 4000]))
        for _ in range(rng.randint(0, 3)):
            q = rng.choice(items)[1].split()
            for k in range(len(q)):
                if rng.random() < 0.05:
                    q[k] = "zz"
            at = rng.randint(0, len(w))
            w[at:at] = q
        rows.append((d, rng.choice([" ", ", ", "\n"]).join(w).title()))
    got, want = values(decontaminate.contained_items(docs(*rows).repartition(4), bench(*items))), brute(rows, items)
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want) > 50
    exact = [r for r in want if r[4] == 1]
    assert len([r for r in got if r[4] == 1]) >= 0.99 * len(exact)
    sliced = values(decontaminate.contained_items(docs(*rows), bench(*items), slice_bytes=3000))
    assert sliced == got
    left = {r[0] for r in values(decontaminate.decontaminate(docs(*rows), bench(*items)), "doc_id")}
    assert left == {d for d, _ in rows} - {r[0] for r in got}


def test_short_item_at_any_place_of_a_long_text(docs, bench):
    rng = random.Random(3)
    item = prose(rng, 25)
    body = words(rng, 30_000)
    for at in (0, 1, 15_000, 29_999, 30_000):
        text = " ".join(body[:at] + item.split() + body[at:])
        assert values(decontaminate.contained_items(docs((1, text)), bench((5, item))), "doc_id", "item_id", "containment") == [(1, 5, 1.0)]


def test_odd_rows(odd, none, bench, docs):
    items = bench((1, "one"), (2, None), (3, " ... "), (4, "two words"), (None, "two lines"), (4, "two words"))
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    want = brute(rows, [(1, "one"), (4, "two words"), (None, "two lines")])
    assert set(values(decontaminate.contained_items(odd, items))) == set(want) and want
    clean = decontaminate.decontaminate(odd, items)
    assert clean.columns == odd.columns and clean.count() == odd.where("doc_id is null or doc_id not in (7, 8)").count()
    nothing = bench((1, "x")).where("false")
    assert decontaminate.contained_items(odd, nothing).count() == 0 and decontaminate.decontaminate(odd, nothing).count() == odd.count()
    assert decontaminate.contained_items(none, items).count() == decontaminate.decontaminate(none, items).count() == 0


def test_bands_keep_the_recall():
    for low in (1, 3, 9, 20, 100, 1000):
        size = max(8, 1 << (low - 1).bit_length())
        b, r = decontaminate.bands(low, 2 * size, 0.7, 0.995)
        j = 0.7 * low / (2 * size + 0.3 * low)
        assert 1 - (1 - j**r) ** b >= 0.995 - 1e-12
    with pytest.raises(ValueError):
        decontaminate.bands(1, 1000, 0.1, 0.9999)


def test_items_of_one_and_two_words_in_long_texts(docs, bench):
    long = prose(random.Random(4), 2000)
    rows = [(1, long + " needle " + long), (2, long + " Two, words " + long), (3, "two"), (4, "words two"), (5, "two words")]
    got = values(decontaminate.contained_items(docs(*rows), bench((1, "needle"), (2, "two words"), (3, "two words"))), "doc_id", "item_id")
    assert got == [(1, 1), (2, 2), (2, 3), (5, 2), (5, 3)]
