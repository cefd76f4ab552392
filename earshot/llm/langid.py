"""Language identification with blended-spectrum n-gram presence kernels, Nyström landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Presence features: all single bytes, all pairs of bytes, and hashed buckets for the longer ones.
WIDTHS = {1: 8, 2: 16, 3: 17, 4: 17}
_LOW = {p: sum(1 << b for q, b in WIDTHS.items() if q < p) for p in WIDTHS}
N_FEATURES = sum(1 << b for b in WIDTHS.values())
_SPREAD = np.uint32(2654435761)

#: Production parameters; PER_CLASS bounds the training sample. MIN_SCORE and MIN_MARGIN are the floor of the thresholds that are set from held-out rows.
PER_CLASS, LANDMARKS, RIDGE, MIN_SCORE, MIN_MARGIN = 200, 64, 1e-3, -0.9, 0.01
#: The least landmarks of a class, and the most classes: the sample and the table that all workers get grow with these only.
EACH, MOST_CLASSES = 16, 500
#: Held-out rows come from FOLDS folds; SHARE of their quantile LOW counts; with fewer than LEAST_HELD_OUT of them the floor stays.
FOLDS, LOW, SHARE, LEAST_HELD_OUT = 4, 0.05, 0.25, 20


@dataclass(frozen=True)
class LanguageModel:
    """``table`` has for each feature the sum of its landmarks' dual weights, a column for each class; a text with less than the thresholds is in none of them."""

    classes: tuple[str, ...]
    table: np.ndarray
    min_score: float = MIN_SCORE
    min_margin: float = MIN_MARGIN


def spectrum(text: str, flags: np.ndarray) -> np.ndarray:
    """The sorted ids of the n-grams of 1 to 4 bytes that are in the whole lower-cased text. ``flags`` is scratch space."""
    a = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
    if not len(a):
        return np.zeros(0, np.int64)
    flags[a] = True
    gram = a
    for p in (2, 3, 4):
        if len(a) < p:
            break
        gram = (gram[:-1] << np.uint32(8)) | a[p - 1 :]
        if p == 2:
            flags[gram + np.uint32(_LOW[2])] = True
        else:
            flags[((gram * _SPREAD) >> np.uint32(32 - WIDTHS[p])) + np.uint32(_LOW[p])] = True
    ids = np.flatnonzero(flags)
    flags[ids] = False
    return ids


def _kernel(xs: list[np.ndarray], ys: list[np.ndarray], width: int = 64) -> np.ndarray:
    """|x and y| / sqrt(|x| |y|) for all pairs, by a sparse-dense product for each ``width`` of the ys."""
    out = np.zeros((len(xs), len(ys)), np.float32)
    for low in range(0, len(ys), width):
        part = ys[low : low + width]
        dense = np.zeros((N_FEATURES, len(part)), np.float32)
        for j, y in enumerate(part):
            dense[y, j] = 1 / np.sqrt(max(1, len(y)))
        for i, x in enumerate(xs):
            out[i, low : low + width] = dense[x].sum(axis=0) / np.sqrt(max(1, len(x)))
    return out


def _turns(labels: list[str]) -> np.ndarray:
    """The number of each row among those of its label."""
    seen: Counter[str] = Counter()
    out = np.zeros(len(labels), np.int64)
    for i, label in enumerate(labels):
        out[i] = seen[label]
        seen[label] += 1
    return out


def _solve(k: np.ndarray, between: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """The landmarks' dual weights, from the kernel of the rows with them and of them with one another."""
    values, vectors = np.linalg.eigh(between)
    keep = values > 1e-6 * values.max()
    white = vectors[:, keep] / np.sqrt(values[keep])
    phi = k @ white
    return white @ np.linalg.solve(phi.T @ phi + ridge * len(k) * np.eye(phi.shape[1]), phi.T @ y)


def _thresholds(k: np.ndarray, chosen: np.ndarray, own: np.ndarray, y: np.ndarray, nth: np.ndarray, ridge: float) -> tuple[float, float]:
    """A quarter of what nearly all held-out rows have as score and margin of their own class.

    A text in none of the languages has a score and a margin of about 0; the quarter lies between those and the known ones, with
    room for short texts. The quantile isn't the least, lest rows with a wrong label or in two languages open the gate.
    Neither the rows of a fold nor the landmarks among them take part in its fit.
    """
    found = []
    for fold in range(FOLDS):
        rest = nth % FOLDS != fold
        marks = np.flatnonzero(rest[chosen])
        held = np.flatnonzero(~rest & np.isin(own, own[rest]))
        if not len(held) or not len(marks):
            continue
        dual = _solve(k[np.ix_(rest, marks)].astype(np.float64), k[np.ix_(chosen[marks], marks)].astype(np.float64), y[rest], ridge)
        s = k[np.ix_(held, marks)] @ dual
        mine = s[np.arange(len(held)), own[held]]
        s[np.arange(len(held)), own[held]] = -np.inf
        found.append(np.column_stack([mine, mine - s.max(axis=1) if y.shape[1] > 1 else 2 * mine]))
    held_out = np.concatenate(found) if found else np.zeros((0, 2))
    if len(held_out) < LEAST_HELD_OUT:
        return MIN_SCORE, MIN_MARGIN
    score, margin = np.quantile(held_out, LOW, axis=0)
    return float(max(MIN_SCORE, min(score, SHARE * score))), float(max(MIN_MARGIN, SHARE * margin))


def train(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE, each: int = EACH) -> LanguageModel:
    """Kernel ridge regression on targets -1 and 1 in the Nyström space of landmark texts; thresholds by cross-validation.

    There are ``landmarks`` of them, and more where the classes are many: each class has ``each``, or all its rows if it has
    fewer. They are taken from the classes in turn.
    """
    classes = tuple(sorted({y for _, y in rows}))
    if not rows:
        return LanguageModel((), np.zeros((N_FEATURES, 0), np.float32))
    flags = np.zeros(N_FEATURES, bool)
    xs, labels = [spectrum(t, flags) for t, _ in rows], [label for _, label in rows]
    nth, at = _turns(labels), {c: i for i, c in enumerate(classes)}
    own = np.array([at[label] for label in labels])
    turn = np.lexsort((own, nth))
    chosen = turn[: max(landmarks, int((nth < each).sum()))]
    k = _kernel(xs, [xs[i] for i in chosen])
    y = np.where(own[:, None] == np.arange(len(classes))[None, :], 1.0, -1.0)
    dual = _solve(k.astype(np.float64), k[chosen].astype(np.float64), y, ridge)
    table = np.zeros((N_FEATURES, len(classes)), np.float32)
    for i, w in zip(chosen, dual):
        table[xs[i]] += (w / np.sqrt(max(1, len(xs[i])))).astype(np.float32)
    return LanguageModel(classes, table, *_thresholds(k, chosen, own, y, nth, ridge))


def sample(docs: DataFrame, per_class: int, id_col: str, text_col: str, label_col: str) -> list[tuple[str, str]]:
    """At most ``per_class`` labelled rows of each class, those with a text of the least hash; only ids and labels are shuffled.

    Of more than MOST_CLASSES labels, which would be a table of another kind, no model is made: ValueError.
    """
    classes = docs.select(F.col(label_col).alias("label")).where("label is not null").distinct().limit(MOST_CLASSES + 1).count()
    if classes > MOST_CLASSES:
        raise ValueError(f"{label_col} has more than {MOST_CLASSES} labels")
    order = F.xxhash64(F.col("id").cast("string"))
    ranked = Window.partitionBy("label").orderBy("h", "id")
    ids = (
        docs.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text"))
        .where("id is not null and label is not null and text is not null and trim(text) != ''")
        .select("id", "label")
        .withColumn("h", order)
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= per_class)
        .select("id", "label")
        .distinct()
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text")).where("text is not null and trim(text) != ''")
    picked = texts.join(F.broadcast(ids), ["id", "label"], "left_semi").withColumn("h", order)
    again = Window.partitionBy("label").orderBy("h", "id", "text")
    rows = picked.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= per_class).select("text", "label", "h").collect()
    return [(r["text"], r["label"]) for r in sorted(rows, key=lambda r: (r["h"], r["text"]))]


def scores(texts: list[str], model: LanguageModel, flags: np.ndarray) -> np.ndarray:
    """The decision values of a batch: its presence matrix times the model's table, each row over its norm."""
    out = np.zeros((len(texts), len(model.classes)), np.float32)
    found = [spectrum(t, flags) for t in texts]
    full = [i for i, x in enumerate(found) if len(x)]
    if full:
        sizes = np.array([len(found[i]) for i in full])
        sums = np.add.reduceat(model.table[np.concatenate([found[i] for i in full])], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        out[full] = sums / np.sqrt(sizes)[:, None]
    return out


def identify(
    docs: DataFrame,
    model: LanguageModel | None = None,
    *,
    per_class: int = PER_CLASS,
    landmarks: int = LANDMARKS,
    ridge: float = RIDGE,
    min_score: float | None = None,
    min_margin: float | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    keep_columns: bool = False,
) -> DataFrame:
    """The language of each document, with its score, its margin over the next language, and whether it is accepted.

    Without a ``model`` one is trained on at most ``per_class`` labelled rows a language (the documented bound of the sample).
    Each text is used as a whole; (X L') c, the kernel with the landmarks times their weights, is computed as X (L' c) by one
    sparse-dense matrix product a batch. One pass over the documents without any shuffle. A document is rejected if its best
    score is below ``min_score`` or leads by less than ``min_margin``: then it looks like no language or like two at once.
    A text of fewer bytes than the longest n-gram is rejected, too: it can't be told from one in no language.
    Without thresholds the model's own are used, which ``train`` sets from rows that it holds out in turn.

    Result: ``id_col``, lang_pred, lang_score, lang_margin, accepted; or, with ``keep_columns``, all input columns with these
    four added, which replace input columns of the same names. Null, empty and blank texts are rejected, with null in the
    first three; so is each document when there is no labelled row at all. With one class the margin is the distance to its
    negative. Equal scores go to the alphabetically first language and, having no margin, are rejected. Each row counts by
    itself, repeated or not; null ids are kept but never train. An empty input gives an empty result.
    """
    model = model or train(sample(docs, per_class, id_col, text_col, label_col), landmarks, ridge)
    decide = _decider(docs, model, min_score, min_margin, text_col)
    added = [("lang_pred", T.StringType()), ("lang_score", T.DoubleType()), ("lang_margin", T.DoubleType()), ("accepted", T.BooleanType())]
    names = {n for n, _ in added}
    source = docs.select(*[c for c in docs.columns if c.lower() not in names]) if keep_columns else docs.select(id_col, text_col)
    passed = source.columns if keep_columns else [id_col]
    schema = T.StructType([source.schema[c] for c in passed] + [T.StructField(n, t) for n, t in added])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in decide(batches):
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in passed] + found, names=[*passed, *(n for n, _ in added)])

    return source.mapInArrow(task, schema)


def _decider(docs: DataFrame, model: LanguageModel, min_score: float | None, min_margin: float | None, text_col: str):
    min_score = model.min_score if min_score is None else min_score
    min_margin = model.min_margin if min_margin is None else min_margin
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        m, flags = shared.value, np.zeros(N_FEATURES, bool)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = [t or "" for t in part.column(part.schema.get_field_index(text_col)).to_pylist()]
                some = np.array([bool(t.strip()) for t in texts], bool) & bool(m.classes)
                s = scores(texts, m, flags) if m.classes else np.zeros((len(texts), 1), np.float32)
                best = s.argmax(axis=1)
                top = s[np.arange(len(texts)), best]
                margin = top - np.partition(s, -2, axis=1)[:, -2] if s.shape[1] > 1 else 2 * top
                wide = np.array([len(t.strip().encode()) >= max(WIDTHS) if len(t) < 64 else f for t, f in zip(texts, some)], bool)
                ok = some & wide & (top >= min_score) & (margin >= min_margin)
                label = pa.array([m.classes[b] if f else None for b, f in zip(best, some)], pa.string())
                numbers = [pa.array(x.astype(np.float64), mask=~some) for x in (top, margin)]
                yield part, [label, *numbers, pa.array(ok)]

    return decide


def keep_identified(docs: DataFrame, model: LanguageModel | None = None, *, per_class: int = PER_CLASS, landmarks: int = LANDMARKS, ridge: float = RIDGE, min_score: float | None = None, min_margin: float | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """The documents that ``identify`` accepts, with exactly the columns of the input, whatever their names.

    Null, empty and blank texts go, and all documents where no row has a label; equal rows stay or go together, null ids stay
    or go by their texts. An empty input gives an empty result.
    """
    model = model or train(sample(docs, per_class, id_col, text_col, label_col), landmarks, ridge)
    decide = _decider(docs, model, min_score, min_margin, text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in decide(batches):
            yield part.filter(found[3])

    return docs.mapInArrow(task, docs.schema)
