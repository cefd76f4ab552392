"""Benchmark decontamination: size-partitioned MinHash containment search for short items inside long documents, verified exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.llm.textkit import FOLDED, NOT_WORD, U64, buffers, chunks, mix, rolling, tokens

SHINGLE, THRESHOLD, RECALL, PERMUTATIONS = 3, 0.7, 0.995, 64
SMALLEST = 8  # shingles in the windows' finest grain
#: Low thresholds and single shingles need more hashes for the recall that is asked for; beyond so many they are refused.
MOST_PERMUTATIONS = 1000
_A = mix(np.arange(1, MOST_PERMUTATIONS + 1, dtype=U64)) | U64(1)
_B = mix(np.arange(1001, MOST_PERMUTATIONS + 1001, dtype=U64))


def bands(low: int, window: int, threshold: float, recall: float, permutations: int = PERMUTATIONS) -> tuple[int, int]:
    """Bands and rows for items of at least ``low`` shingles in windows of ``window``: the most selective pair that keeps the recall.

    An item of q shingles of which a share t is in a window of w has Jaccard similarity of at least t q / (w + (1 - t) q).
    Single rows take as many hashes as the recall needs; a recall that MOST_PERMUTATIONS don't give raises ValueError.
    """
    j = threshold * low / (window + (1 - threshold) * low)
    for r in (4, 3, 2):
        if (b := math.ceil(math.log(1 - recall) / math.log(1 - j**r))) * r <= permutations:
            return b, r
    if (b := math.ceil(math.log(1 - recall) / math.log(1 - j))) > MOST_PERMUTATIONS:
        raise ValueError(f"a recall of {recall} at a containment of {threshold} takes {b} hashes")
    return b, 1


@dataclass
class Partition:
    """Items of more than ``size`` / 2 and up to ``size`` shingles; documents are cut in windows of twice the size, at each size."""

    size: int
    bands: int
    rows: int
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    owners: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sieve: np.ndarray = field(default_factory=lambda: np.zeros(1, bool))


@dataclass
class Index:
    ids: pa.Array
    shingles: list[np.ndarray]
    partitions: list[Partition]
    threshold: float
    #: Items of fewer words than a shingle: by their number of words, the sorted hashes and the items that have them.
    short: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)


def word_rows(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Number of each row and the hashes of its words, in order."""
    data, at = buffers(column)
    for i, j in chunks(at):
        h, _, _, rows = tokens(data, at[i : j + 1], NOT_WORD, FOLDED)
        for r in range(j - i):
            yield i + r, h[rows[r] : rows[r + 1]]


def shingles(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Number of each row and the hashes of its runs of ``n`` words, in order; a text of fewer words is one run."""
    for r, words in word_rows(column):
        yield r, rolling(words, min(n, max(1, len(words))))


def _band_keys(minima: np.ndarray, part: Partition) -> np.ndarray:
    """A key for each row of ``minima`` and band."""
    out = np.zeros((len(minima), part.bands), U64)
    with np.errstate(over="ignore"):
        for r in range(part.rows):
            out = mix(out + minima[:, r : part.bands * part.rows : part.rows])
        return out ^ (mix(np.arange(part.bands, dtype=U64) + U64(part.size << 8))[None, :])


def _permuted(x: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (x[:, None] * _A[:k] + _B[:k]) >> U64(32)


def index_of(ids: pa.Array, texts: pa.Array, shingle: int, threshold: float, recall: float) -> Index:
    sets: list[np.ndarray] = []
    parts: dict[int, list[int]] = {}
    few: dict[int, list[int]] = {}
    for i, words in word_rows(texts):
        sets.append(np.unique(rolling(words, min(shingle, max(1, len(words))))))
        if 0 < len(words) < shingle:
            few.setdefault(len(words), []).append(i)
        elif len(words):
            parts.setdefault(max(SMALLEST, 1 << (len(sets[-1]) - 1).bit_length()), []).append(i)
    short = {}
    for n, members in few.items():
        h = np.concatenate([sets[i] for i in members])
        order = np.argsort(h, kind="stable")
        short[n] = h[order], np.array(members)[order]
    out = []
    for size, members in sorted(parts.items()):
        low = min(len(sets[i]) for i in members)
        part = Partition(size, *bands(low, 2 * size, threshold, recall))
        minima = np.stack([_permuted(sets[i], part.bands * part.rows).min(axis=0) for i in members])
        keys = _band_keys(minima, part)
        owners = np.repeat(np.array(members), part.bands)
        order = np.argsort(keys.ravel(), kind="stable")
        part.keys, part.owners = keys.ravel()[order], owners[order]
        sieve_bits = max(16, (8 * len(order) - 1).bit_length())
        part.sieve = np.zeros(1 << sieve_bits, bool)
        part.sieve[part.keys >> U64(64 - sieve_bits)] = True
        out.append(part)
    return Index(ids, sets, out, threshold, short)


def _found(words: np.ndarray, index: Index, shingle: int) -> list[tuple[int, int]]:
    """Items (by number) that a document of these words holds, with the count of shared shingles: short ones by their runs of words, others by colliding windows, verified."""
    out: list[tuple[int, int]] = []
    for n, (have, owners) in index.short.items():
        runs = np.unique(rolling(words, n))
        low, high = np.searchsorted(have, runs, "left"), np.searchsorted(have, runs, "right")
        out += [(int(i), 1) for a, b in zip(low[low < high], high[low < high]) for i in owners[a:b]]
    x = rolling(words, shingle)
    if not len(x) or not index.partitions:
        return sorted(out)
    most = max(p.bands * p.rows for p in index.partitions)
    grain = SMALLEST
    cuts = np.arange(0, len(x), grain)
    level = np.concatenate([np.minimum.reduceat(_permuted(x[i : i + 4096], most), np.arange(0, min(4096, len(x) - i), grain), axis=0) for i in range(0, len(x), 4096)]) if len(cuts) else np.zeros((0, most), U64)
    candidates: set[int] = set()
    for part in index.partitions:
        while grain < part.size:
            if len(level) % 2:
                level = np.concatenate([level, level[-1:]])
            level, grain = np.minimum(level[::2], level[1::2]), grain * 2
        windows = np.minimum(level[:-1], level[1:]) if len(level) > 1 else level
        keys = _band_keys(windows, part).ravel()
        shift = U64(64 - (len(part.sieve).bit_length() - 1))
        keys = keys[part.sieve[keys >> shift]]
        if len(keys):
            low, high = np.searchsorted(part.keys, keys, "left"), np.searchsorted(part.keys, keys, "right")
            for a, b in set(zip(low[low < high].tolist(), high[low < high].tolist())):
                candidates.update(part.owners[a:b].tolist())
    if not candidates:
        return sorted(out)
    whole = np.unique(x)
    for i in sorted(candidates):
        item = index.shingles[i]
        shared = int((whole[np.minimum(np.searchsorted(whole, item), len(whole) - 1)] == item).sum())
        if shared >= index.threshold * len(item) - 1e-9:
            out.append((i, shared))
    return sorted(out)


def _search(source: DataFrame, index: Index, shingle: int, text_col: str, item_type: T.DataType, pass_through: bool) -> DataFrame:
    shared = source.sparkSession.sparkContext.broadcast(index)
    text_at = source.columns.index(text_col)
    shape = source.schema if pass_through else T.StructType([source.schema["_dc_id"], T.StructField("item", item_type), T.StructField("shared", T.LongType()), T.StructField("item_shingles", T.LongType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = shared.value
        for batch in batches:
            found = [(r, *pair) for r, words in word_rows(batch.column(text_at)) for pair in _found(words, have, shingle)]
            if pass_through:
                clean = np.ones(batch.num_rows, bool)
                clean[[f[0] for f in found]] = False
                yield batch.filter(pa.array(clean))
            elif found:
                row, item, n = (pa.array(c, pa.int64()) for c in zip(*found))
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("_dc_id")).take(row), have.ids.take(item), n, pa.array([len(have.shingles[f[1]]) for f in found], pa.int64())], names=shape.names)

    return source.mapInArrow(task, shape)


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, shingle: int, threshold: float, recall: float, slice_bytes: int) -> Iterator[Index]:
    """The benchmark's index, in slices that each fit what may be sent to every worker."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, math.ceil(size / slice_bytes))
    for n in range(slices):
        part = items if slices == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == n)
        table = part.toArrow().combine_chunks()
        ids, texts = (table.column(i).combine_chunks() for i in (0, 1))
        yield index_of(ids, texts, shingle, threshold, recall)


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slice_bytes: int = 32 << 20) -> DataFrame:
    """All pairs of a document and a benchmark item of whose word shingles the document holds at least ``threshold``.

    Items are partitioned by size, in powers of two. For each partition documents are cut, over their whole length, in windows
    of twice its size that overlap by half, so that an item lies whole in one of them and the two sets are of like size; the
    minima of a partition's windows come from pairs of the next finer ones. Bands and rows are set for each partition so that an
    item with the least size and containment collides with the ``recall`` given; verification counts its shingles in the whole
    document, exactly. Every document is a query. The index of the items is sent to the workers in slices of at most
    ``slice_bytes`` of text, and with more than one slice the documents are searched once for each; nothing is shuffled.

    Result: ``id_col``, ``item_col``, shared, item_shingles (distinct shingles), containment, distinct rows. Words are runs of
    letters and digits, ASCII letters in lower case; an item of fewer words than a shingle is one shingle of all its words,
    which every document is searched for exactly, whatever its length. Items and texts that are null or without words match nothing. Null ids
    are kept. Repeated documents or items give the same pair once. Other columns are left out. Empty tables give an empty result.
    """
    source = docs.select(F.col(id_col).alias("_dc_id"), F.col(text_col).alias("_dc_text"))
    out = None
    for index in _indexes(benchmark, item_col, item_text_col, shingle, threshold, recall, slice_bytes):
        part = _search(source, index, shingle, "_dc_text", benchmark.schema[item_col].dataType, False)
        out = part if out is None else out.union(part)
    containment = F.round(F.col("shared") / F.col("item_shingles"), 6)
    return out.distinct().select(F.col("_dc_id").alias(id_col), F.col("item").alias(item_col), "shared", "item_shingles", containment.alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slice_bytes: int = 32 << 20) -> DataFrame:
    """The documents that hold no benchmark item, by ``contained_items``' rule, with the columns of the input, in one pass without a shuffle."""
    out = docs
    for index in _indexes(benchmark, item_col, item_text_col, shingle, threshold, recall, slice_bytes):
        out = _search(out, index, shingle, text_col, benchmark.schema[item_col].dataType, True)
    return out


def oracle(threshold: float = THRESHOLD, shingle: int = SHINGLE) -> str:
    """Exact containment of all pairs in DuckDB SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"list_filter(regexp_split_to_array(translate(text, '{upper}', '{lower}'), '[\\x00-/:-@\\[-`{{-\\x7F]+'), lambda x: x != '')"
    grams = f"list_distinct(list_transform(range(1, greatest(2, len(w) - {shingle - 2})), lambda i: array_to_string(w[i:i + {shingle - 1}], ' ')))"
    runs = f"list_distinct(list_transform(range(1, len(w) - {shingle - 2}), lambda i: array_to_string(w[i:i + {shingle - 1}], ' ')))"
    runs_n = "list_distinct(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')))"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT item_id, {words} AS w FROM benchmark),
few AS (SELECT DISTINCT len(w) AS n FROM b WHERE len(w) BETWEEN 1 AND {shingle - 1}),
ds AS (SELECT DISTINCT doc_id, unnest({runs}) AS s FROM d WHERE len(w) >= {shingle} UNION
  SELECT doc_id, unnest({runs_n}) AS s FROM d, few WHERE len(w) >= n),
bs AS (SELECT DISTINCT item_id, unnest({grams}) AS s FROM b WHERE len(w) > 0),
size AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, item_shingles, round(count(*) / item_shingles, 6) AS containment
FROM ds JOIN bs USING (s) JOIN size USING (item_id) GROUP BY doc_id, item_id, item_shingles HAVING count(*) >= {threshold} * item_shingles - 1e-9"""
