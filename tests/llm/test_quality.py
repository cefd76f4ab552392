from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import values
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.llm import quality


def graded(rng, n):
    """Grade 0 has words of its own, grade 1 no full stops, grade 2 neither."""
    out = []
    for i in range(n):
        g = rng.choice([0, 1, 1, 2, 2, 2])
        w = [rng.choice("river stone cloud tree light".split()) for _ in range(rng.randint(20, 60))]
        if g == 0:
            w[rng.randrange(len(w))] = rng.choice(["vile", "foul"])
        out.append((i, " ".join(w) if g == 1 else ". ".join(w) + ".", g))
    return out


@pytest.fixture
def rated(spark, docs):
    rows = graded(random.Random(6), 600)
    labels = spark.createDataFrame([(i, int(g == 2), int(g == 0)) for i, _, g in rows], "doc_id bigint, quality int, toxic int")
    return docs(*[r[:2] for r in rows]), labels, {r[0]: r[2] for r in rows}


def test_held_out_grades(rated):
    df, labels, truth = rated
    got = values(quality.grade_documents(df.where("doc_id >= 300"), None, quality.train(*quality.sample(df, labels.where("doc_id < 300").select(F.col("doc_id").alias("id"), quality.rating().alias("grade")), 8000, "doc_id", "text"))))
    assert len(got) == 300
    assert np.mean([round(e) == truth[d] for d, _, e, _, _ in got]) > 0.9
    kept = [truth[d] for d, *_, s in got if s]
    assert kept.count(0) <= 0.02 * len(kept) and kept.count(2) >= 0.9 * sum(truth[d] == 2 for d, *_ in got)


def test_probabilities(rated):
    df, labels, _ = rated
    for _, score, expected, top, chosen in values(quality.grade_documents(df, labels)):
        assert 0 <= top <= 1 and 0 <= expected <= 2 and expected >= 2 * top - 1e-9 and chosen == (top >= quality.MIN_TAIL) and np.isfinite(score)


def test_gradient_reaches_the_optimum():
    """One feature and three grades: the fit is as likely as the best of a fine grid."""
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, 400)
    y = np.clip(np.round(x + rng.normal(0, 0.8, 400)), 0, 2).astype(int)
    model = quality.train(pa.array(["hot thing" if a else "thing" for a in x]), y, rounds=600, penalty=0.0)
    sums = np.concatenate([quality._sums(model.weights, ids, at) for ids, at in quality.features(pa.array(["hot thing" if a else "thing" for a in x]))])

    def likely(s, cuts):
        p = np.column_stack([np.ones(len(s)), 1 / (1 + np.exp(cuts[0] - s)), 1 / (1 + np.exp(cuts[1] - s)), np.zeros(len(s))])
        return np.log(np.maximum(p[np.arange(len(s)), y] - p[np.arange(len(s)), y + 1], 1e-12)).sum()

    best = max(likely(w * x, (a, a + g)) for w in np.arange(0.5, 4, 0.1) for a in np.arange(-2, 2, 0.1) for g in np.arange(0.3, 4, 0.1))
    assert likely(sums, model.cuts) > best - 0.5 and model.cuts[0] < model.cuts[1]


def test_features_cover_the_whole_text():
    [(ids, at)] = list(quality.features(pa.array(["a " * 30_000 + "needle", "needle", None, ""])))
    rows = [set(ids[i:j].tolist()) for i, j in zip(at, at[1:])]
    assert rows[1] and rows[1] <= rows[0] and rows[2] == rows[3] == set()


def test_odd_rows(odd, none, spark, rated):
    _, labels, _ = rated
    got = quality.grade_documents(odd, labels.withColumn("text", F.lit("clash")))
    assert got.columns == ["doc_id", "score", "expected_grade", "p_top", "selected"] and got.count() == odd.count()
    assert values(got.where("score is null"), "doc_id", "selected") == [(2, False), (3, False), (4, False), (11, False), (None, False)]
    assert quality.grade_documents(none, labels).count() == 0
    unrated = quality.grade_documents(odd, labels.where("false"))
    assert unrated.where("score is not null or selected").count() == 0
    one = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (5, None, None), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    assert set(values(quality.grade_documents(odd, one).where("score is not null"), "expected_grade", "p_top")) == {(2.0, 1.0)}
    with pytest.raises(ValueError):
        quality.grade_documents(odd)


def test_ratings(spark):
    S = T.StructType([T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 1), (None, 1), (None, 0), (1, None)], S)
    assert [r[0] for r in df.select(quality.rating()).collect()] == [2, 1, 0, 0, None, None]


def test_query_has_a_row_for_each_document(spark, sf):
    from earshot.llm import queries

    got, docs = queries.op8_quality(spark, sf), spark.read.parquet(f"{sf}/documents.parquet")
    assert values(got, "doc_id") == values(docs, "doc_id") and 0 < got.where("selected").count() < docs.count()


def test_fit_against_a_dense_optimiser():
    """Plain gradient ascent on dense presence vectors comes to the same likelihood and the same predictions."""
    rows = graded(random.Random(8), 80)
    texts, y = pa.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    model = quality.train(texts, y, rounds=800, penalty=3e-3)
    [(ids, at)] = list(quality.features(texts))
    used = np.unique(ids)
    x = np.zeros((len(rows), len(used)))
    for i in range(len(rows)):
        x[i, np.searchsorted(used, ids[at[i] : at[i + 1]])] = 1
    hold = 3e-3 * (1 + quality.RARE / x.sum(axis=0))

    def value(theta):
        w, cuts = theta[:-2], np.array([theta[-2], theta[-2] + np.exp(theta[-1])])
        p = np.column_stack([np.ones(len(y)), 1 / (1 + np.exp(cuts[None, :] - (x @ w)[:, None])), np.zeros(len(y))])
        q = np.maximum(p[np.arange(len(y)), y] - p[np.arange(len(y)), y + 1], 1e-12)
        slope = p * (1 - p)
        by_score = (slope[np.arange(len(y)), y] - slope[np.arange(len(y)), y + 1]) / q
        by_cut = [(np.where(y == k, 1, 0) * slope[:, k + 1] / q - np.where(y == k + 1, 1, 0) * slope[:, k + 1] / q).sum() for k in (0, 1)]
        grad = np.concatenate([x.T @ by_score / len(y) - hold * w, [sum(by_cut) / len(y), by_cut[1] * np.exp(theta[-1]) / len(y)]])
        return np.log(q).mean() - (hold * w * w).sum() / 2, grad

    theta, step = np.zeros(len(used) + 2), 1.0
    v, g = value(theta)
    for _ in range(4000):
        while step > 1e-9 and (now := value(theta + step * g))[0] < v:
            step /= 2
        theta, (v, g), step = theta + step * g, now, step * 1.3
    mine = np.concatenate([model.weights[used], [model.cuts[0], np.log(model.cuts[1] - model.cuts[0])]])
    assert value(mine)[0] > v - 0.01
    dense, fitted = quality._sigmoid(x @ theta[:-2] - theta[-2]), quality._sigmoid(quality._sums(model.weights, ids, at) - model.cuts[0])
    assert np.abs(dense - fitted).max() < 0.15


def test_blank_texts_take_no_place_in_the_sample(docs, spark):
    rows = [(i, " " if i < 200 else f"text {i}") for i in range(210)]
    ratings = spark.createDataFrame([(i, i % 3) for i in range(210)], "id bigint, grade int")
    assert len(quality.sample(docs(*rows), ratings, 10, "doc_id", "text")[0]) == 10
