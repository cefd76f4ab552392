"""Quality classification by ordinal cumulative-link regression on graded ratings over hashed text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.llm.textkit import EXACT, FOLDED, NOT_WORD, U64, buffers, chunks, mix, tokens

#: log2 of the number of weights, and the bound of the training sample (rows).
BITS, SAMPLE = 18, 8000
#: The least probability of the top grade for selection.
MIN_TAIL = 0.3
#: Bytes of the runs inside words that are features, and how much harder a weight is held back that few texts inform (RARE of them: twice as hard).
GRAM, RARE = 4, 20.0


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade > k) = sigmoid(score - cuts[k]); ``cuts`` ascend, ``weights`` are shared by all grades."""

    grades: tuple[int, ...]
    weights: np.ndarray
    cuts: np.ndarray


#: Runs of punctuation are tokens as words are.
_PUNCTUATION = NOT_WORD & (np.arange(256) > 32) & (np.arange(256) < 127)


_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(U64)


def _grams(data: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each run of GRAM bytes inside a word, ASCII letters in lower case."""
    low, high = int(part[0]), int(part[-1])
    a = _LOWER[data[low:high]]
    if len(a) < GRAM:
        return np.zeros(0, U64), np.zeros(0, U64)
    code = np.zeros(len(a) - GRAM + 1, U64)
    for k in range(GRAM):
        code |= a[k : k + len(code)] << U64(8 * k)
    breaks = np.concatenate([[0], np.cumsum(NOT_WORD[data[low:high]])])
    at = np.flatnonzero(breaks[GRAM:] == breaks[:-GRAM])
    row = np.searchsorted(part - low, at, "right") - 1
    inside = at + GRAM <= (part - low)[row + 1]
    return row[inside].astype(U64), mix(code[at[inside]] | U64(1 << 63))


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each chunk of rows, the distinct hashed features of each row, one after another, and where each row's begin (n + 1).

    Features are the presence of each word (a run of letters and digits, ASCII letters in lower case), of each run of
    punctuation, and of each run of GRAM bytes inside a word, so that inflected forms share weights. They cover the whole text.
    """
    data, at = buffers(column)
    for i, j in chunks(at):
        part = at[i : j + 1]
        (w, _, _, words), (q, _, _, marks) = tokens(data, part, NOT_WORD, FOLDED), tokens(data, part, ~_PUNCTUATION, EXACT)
        whose, gram = _grams(data, part)
        row = np.concatenate([*(np.repeat(np.arange(j - i), np.diff(x)).astype(U64) for x in (words, marks)), whose])
        both = np.unique(row << U64(BITS) | np.concatenate([w, mix(q + U64(1)), gram]) >> U64(64 - BITS))
        yield (both & U64((1 << BITS) - 1)).astype(np.int64), np.searchsorted(both >> U64(BITS), np.arange(j - i + 1, dtype=U64))


def _sums(weights: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(weights[ids], dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(texts: pa.Array, grades: np.ndarray, rounds: int = 150, penalty: float = 3e-4, rate: float = 0.15) -> OrdinalModel:
    """Maximum likelihood with an L2 penalty by full-batch adaptive gradient steps (Adam); cuts are kept in order by logs of their gaps.

    A feature of df texts is penalised by 1 + RARE / df times as much, lest those of a few texts learn them by heart.
    """
    levels = tuple(int(g) for g in np.unique(grades))
    if len(levels) < 2:
        return OrdinalModel(levels, np.zeros(1 << BITS, np.float32), np.zeros(0))
    parts, at = [], [np.zeros(1, np.int64)]
    for ids, cut in features(texts):
        at.append(cut[1:] + at[-1][-1])
        parts.append(ids)
    ids, at = np.concatenate(parts), np.concatenate(at)
    n, row = len(at) - 1, np.repeat(np.arange(len(at) - 1), np.diff(at))
    used, ids, df = np.unique(ids, return_inverse=True, return_counts=True)
    y = np.searchsorted(levels, grades)
    above = np.array([(y > k).mean() for k in range(len(levels) - 1)])
    start = -np.log(above / (1 - above))
    theta = np.concatenate([np.zeros(len(used)), [start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    w_n = len(used)
    best = theta
    for step in range(1, rounds + 1):
        w = theta[:w_n]
        gaps = np.exp(theta[w_n + 1 :])
        cuts = theta[w_n] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = _sums(w, ids, at)
        p = np.column_stack([np.ones(n), _sigmoid(score[:, None] - cuts[None, :]), np.zeros(n)])
        likely = np.maximum(p[np.arange(n), y] - p[np.arange(n), y + 1], 1e-9)
        slope = p * (1 - p)
        d_score = (slope[np.arange(n), y] - slope[np.arange(n), y + 1]) / likely
        d_cuts = np.zeros(len(cuts))
        for k in range(len(cuts)):
            d_cuts[k] = (-slope[y == k + 1, k + 1] / likely[y == k + 1]).sum() + (slope[y == k, k + 1] / likely[y == k]).sum()
        g = np.concatenate([np.bincount(ids, d_score[row], minlength=w_n) - penalty * n * w * (1 + RARE / df), [d_cuts.sum()], np.cumsum(d_cuts[::-1])[::-1][1:] * gaps]) / n
        m, v = 0.9 * m + 0.1 * g, 0.98 * v + 0.02 * g * g
        theta = theta + rate * (1 - 0.9 * step / rounds) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-6)
        best = theta
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = best[:w_n]
    return OrdinalModel(levels, weights, best[w_n] + np.concatenate([[0.0], np.cumsum(np.exp(best[w_n + 1 :]))]))


def predict(model: OrdinalModel, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade and probability of the top grade."""
    if len(model.grades) < 2:
        return np.full(len(scores), float(model.grades[0]) if model.grades else np.nan), np.full(len(scores), 1.0 if model.grades else np.nan)
    tails = _sigmoid(scores[:, None] - model.cuts[None, :])
    return model.grades[0] + tails @ np.diff(model.grades), tails[:, -1]


def rating(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Grades from the two labels: 0 for toxic, 1 for clean but of low quality, 2 for clean and good; null where a label that decides is null."""
    return F.when(F.col(toxic) > 0, 0).when(F.col(toxic) <= 0, F.when(F.col(quality) < 1, 1).when(F.col(quality) >= 1, 2))


def sample(docs: DataFrame, ratings: DataFrame, rows: int, id_col: str, text_col: str) -> tuple[pa.Array, np.ndarray]:
    """At most ``rows`` rated documents with a text, those of the least hash. ``ratings`` has id and grade; an id's least grade counts."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null and trim(text) != ''")
    rated = ratings.where("id is not null and grade is not null").groupBy("id").agg(F.min("grade").cast("int").alias("grade"))
    ids = rated.join(texts.select("id"), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(rows)
    # cut again: an id may have any number of rows
    picked = texts.join(F.broadcast(ids), "id").orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(rows).select("text", "grade").toArrow().combine_chunks()
    text = picked.column("text").combine_chunks()
    return text, picked.column("grade").to_numpy()


def grade_documents(docs: DataFrame, labels: DataFrame | None = None, model: OrdinalModel | None = None, *, rows: int = SAMPLE, min_tail: float = MIN_TAIL, id_col: str = "doc_id", text_col: str = "text", grade: Column | None = None) -> DataFrame:
    """Score, expected grade, probability of the top grade, and selection, for each document.

    A cumulative-link (proportional-odds) model is trained on at most ``rows`` rated documents, the documented bound of the
    sample; ``grade`` makes the rating from the columns of ``labels`` (by default from quality and toxic). One pass over the
    whole texts scores all documents with hashed weights; nothing is shuffled but ids and ratings.

    Result: ``id_col``, score, expected_grade, p_top, selected (p_top is at least ``min_tail``); a row for each row of the
    input. Null, empty and blank texts have null numbers and aren't selected. Without any rating all numbers are null and
    nothing is selected; with ratings of one grade only, that grade is expected with probability 1. An id rated more than
    once counts with its least grade. Null ids are kept but don't train. Other columns are left out. An empty input gives an
    empty result.
    """
    if model is None:
        if labels is None:
            raise ValueError("labels or a model are needed")
        ratings = labels.select(F.col(id_col).alias("id"), (rating() if grade is None else grade).alias("grade"))
        model = train(*sample(docs, ratings, rows, id_col, text_col))
    source = docs.select(id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["score", "expected_grade", "p_top"]
    shape = T.StructType([source.schema[id_col], *(T.StructField(n, T.DoubleType()) for n in names), T.StructField("selected", T.BooleanType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [(_sums(m.weights, ids, at), np.diff(at) > 0) for ids, at in features(batch.column(1))]
            score = np.concatenate([f[0] for f in found]) if found else np.zeros(0)
            some = np.concatenate([f[1] for f in found]) if found else np.zeros(0, bool)
            some &= bool(m.grades)
            expected, top = predict(m, score)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.astype(np.float64), mask=~some) for x in (score, expected, top)), pa.array(some & (top >= min_tail))], names=shape.names)

    return source.mapInArrow(task, shape)
