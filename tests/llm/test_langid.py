from __future__ import annotations

import base64
import random

import numpy as np
import pytest
from conftest import values
from pyspark.sql import functions as F

from earshot.llm import langid

STEMS = {"xx": "ba do mi ra ke lo".split(), "yy": "szt prz dwo krz cze wny".split(), "zz": "üß öch eist ung schl ander".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture
def corpus(docs):
    rng = random.Random(2)
    rows = [(i, text(rng, lang, rng.randint(20, 200)), lang) for i, lang in enumerate(rng.choice(list(STEMS)) for _ in range(240))]
    return docs(*rows), {r[0]: r[2] for r in rows}


def test_held_out_accuracy(corpus):
    df, truth = corpus
    model = langid.train(langid.sample(df.where("doc_id < 120"), 30, "doc_id", "text", "lang"), 24)
    got = values(langid.identify(df.where("doc_id >= 120"), model), "doc_id", "lang_pred", "accepted")
    assert len(got) == 120 and np.mean([truth[d] == p for d, p, _ in got]) > 0.97 and all(a for *_, a in got)


def test_scores_are_kernel_sums(corpus):
    """A row's score is the sum over the landmarks of the kernel by the dual weights, computed the long way."""
    df, _ = corpus
    rows = langid.sample(df, 10, "doc_id", "text", "lang")
    flags = np.zeros(langid.N_FEATURES, bool)
    model = langid.train(rows, 1000, 1e-3)  # every row is a landmark: exact kernel ridge regression
    sets = [set(langid.spectrum(t, flags).tolist()) for t, _ in rows]
    k = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    y = np.array([[1.0 if c == label else -1.0 for c in model.classes] for _, label in rows])
    exact = k @ np.linalg.solve(k + 1e-3 * len(rows) * np.eye(len(rows)), y)
    assert np.abs(langid.scores([t for t, _ in rows], model, flags) - exact).max() < 0.02


def test_spectrum_by_brute_force():
    flags = np.zeros(langid.N_FEATURES, bool)
    for t in ("", "a", "ab", "Abracadabra é", "x" * 5000):
        b = t.lower().encode()
        grams = {b[i : i + p] for p in (1, 2, 3, 4) for i in range(len(b) - p + 1)}
        got = langid.spectrum(t, flags)
        assert len(set(got.tolist())) == len(got) <= len(grams) and len(got) >= 0.99 * len(grams) and not flags.any()
    tail = langid.spectrum("a " * 50_000 + "qqqq", flags)
    assert set(langid.spectrum("qqqq", flags).tolist()) <= set(tail.tolist())


def test_odd_rows(odd, none, docs):
    got = langid.identify(odd)
    assert got.columns == ["doc_id", "lang_pred", "lang_score", "lang_margin", "accepted"] and got.count() == odd.count()
    rejected = got.where("lang_pred is null")
    assert values(rejected, "doc_id", "accepted") == [(2, False), (3, False), (4, False), (11, False), (None, False)]
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and kept.where("text is null or trim(text) = ''").count() == 0
    wide = langid.identify(odd.withColumn("accepted", F.lit("old")), keep_columns=True)
    assert wide.columns.count("accepted") == 1 and wide.schema["accepted"].dataType.simpleString() == "boolean"
    assert langid.identify(none).count() == langid.keep_identified(none).count() == 0
    unlabelled = langid.identify(docs((1, "text", None)))
    assert values(unlabelled) == [(1, None, None, None, False)]


def test_ties_are_rejected(docs):
    same = docs((1, "same words here", "aa"), (2, "same words here", "bb"))
    got = langid.identify(same)
    assert values(got, "doc_id", "lang_pred", "accepted") == [(1, "aa", False), (2, "aa", False)]


def test_unknown_languages_code_and_noise_are_rejected(sf, spark):
    rng = random.Random(6)
    model = langid.train(langid.sample(spark.read.parquet(f"{sf}/documents.parquet"), langid.PER_CLASS, "doc_id", "text", "lang"), langid.LANDMARKS, langid.RIDGE)
    unknown = [
        "Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί και τρέχει στο δάσος. " * 5,
        "Nopea ruskea kettu hyppää laiskan koiran yli ja juoksee metsään, jossa se asuu perheensä kanssa. " * 5,
        "Szybki brązowy lis przeskakuje nad leniwym psem i biegnie do lasu, gdzie mieszka z rodziną. " * 5,
        'int main(int argc, char **argv) { for (int i = 0; i < argc; i++) printf("%s\\n", argv[i]); return 0; }\n' * 5,
        " ".join(f"{rng.getrandbits(32):08x}" for _ in range(200)),
        base64.b64encode(rng.randbytes(2000)).decode(),
        " ".join(str(rng.randrange(10**6)) for _ in range(300)),
        "x",
    ]
    df = spark.createDataFrame(list(enumerate(unknown)), "doc_id bigint, text string")
    assert values(langid.identify(df, model), "doc_id", "accepted") == [(i, False) for i in range(len(unknown))]
    assert langid.keep_identified(df, model).count() == 0
    held = langid.identify(spark.read.parquet(f"{sf}/documents.parquet").where("text is not null and trim(text) != ''"), model)
    assert held.where("accepted").count() >= 0.98 * held.count()


def test_a_hundred_languages_and_noise():
    """Each has words of its own from common letters: all get landmarks, and noise is in none of them."""
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    stems = {f"l{n:03}": ["".join(rng.choice(letters) for _ in range(rng.randint(2, 4))) for _ in range(30)] for n in range(100)}
    write = lambda name, n: " ".join("".join(rng.choice(stems[name]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    model = langid.train([(write(name, 60), name) for _ in range(20) for name in stems])
    flags = np.zeros(langid.N_FEATURES, bool)
    truth = [name for name in stems for _ in range(10)]
    s = langid.scores([write(name, 60) for name in truth], model, flags)
    right = np.array([model.classes[b] for b in s.argmax(axis=1)]) == np.array(truth)
    assert right.reshape(100, 10).mean(axis=1).min() >= 0.97
    accepted = lambda s: (s.max(axis=1) >= model.min_score) & (s.max(axis=1) - np.partition(s, -2, axis=1)[:, -2] >= model.min_margin)
    assert accepted(s).mean() >= 0.98
    noise = ["".join(chr(rng.randint(33, 126)) for _ in range(rng.randint(20, 600))) for _ in range(100)] + ["".join(rng.choice("0123456789") for _ in range(200)) for _ in range(50)]
    assert accepted(langid.scores(noise, model, flags)).mean() < 0.05


def test_landmarks_are_held_out_with_their_fold(corpus):
    df, _ = corpus
    rows = langid.sample(df, 20, "doc_id", "text", "lang")
    model = langid.train(rows, 6)
    assert model.min_margin > langid.MIN_MARGIN and set(model.classes) == set(STEMS)


def test_blank_texts_take_no_place_in_the_sample(docs):
    rows = [(i, " " if i < 300 else f"some words {i} of it", "aa") for i in range(310)]
    assert len(langid.sample(docs(*rows), 5, "doc_id", "text", "lang")) == 5


def test_too_many_labels(docs):
    with pytest.raises(ValueError):
        langid.identify(docs(*[(i, "t", str(i)) for i in range(langid.MOST_CLASSES + 2)]))
