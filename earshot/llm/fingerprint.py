"""Document fingerprints by order MinHash: minimal occurrence-numbered k-mers, kept in text order, hashed as tuples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.llm.textkit import U64, mix, rolling, salted, signed

K, TUPLE, SKETCHES = 8, 3, 16


def numbered(text: str, k: int) -> np.ndarray:
    """A hash of each k-mer of the lower-cased text (characters) together with the number of its occurrence so far; a shorter text is one k-mer."""
    code = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    if not len(code):
        return np.zeros(0, U64)
    h = rolling(mix(code.astype(U64) + U64(1)), min(k, len(code)))
    # the index breaks ties in the low bits, so that a plain sort is stable; the rest of the hash tells k-mers apart
    bits = max(1, int(len(h) - 1).bit_length())
    low = U64((1 << bits) - 1)
    order = np.sort((h & ~low) | np.arange(len(h), dtype=U64))
    same = np.zeros(len(h), bool)
    same[1:] = (order[1:] & ~low) == (order[:-1] & ~low)
    if not same.any():
        return mix(h)
    runs = np.arange(len(h)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
    count = np.zeros(len(h), U64)
    count[(order & low).astype(np.int64)] = runs.astype(U64)
    with np.errstate(over="ignore"):
        return mix(h + count * U64(0x9E3779B97F4A7C15))


def order_minhash(x: np.ndarray, size: int, sketches: int) -> np.ndarray:
    """For each of ``sketches`` orders, the hash of the ``size`` least values of ``x`` in their order of occurrence; all of them if there are fewer."""
    n = len(x)
    take = min(size, n)
    bound = U64(min((1 << 64) - 1, int((1 << 64) * min(1.0, (4 * size + 12) / max(1, n)))))
    chosen = np.empty((sketches, take), np.int64)
    with np.errstate(over="ignore"):
        for j in range(sketches):
            # one odd product is a permutation of 64-bit values; x is mixed already
            key = (x ^ _SALT[j]) * _ODD[j]
            near = np.flatnonzero(key <= bound)
            if len(near) < take:
                near = np.arange(n)
            chosen[j] = near[np.argsort(key[near], kind="stable")[:take]] if len(near) > take else near
        chosen.sort(axis=1)
        h = np.full(sketches, take, U64)
        for i in range(take):
            h = mix(h * U64(0xA0761D6478BD642F) + x[chosen[:, i]])
    return h


_SALT = mix(np.arange(5001, 5001 + 256, dtype=U64))
_ODD = mix(np.arange(7001, 7001 + 256, dtype=U64)) | U64(1)


def fingerprints(docs: DataFrame, k: int = K, size: int = TUPLE, sketches: int = SKETCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The order-MinHash signature of each document: ``id_col``, n_kmers, signature (``sketches`` 64-bit hashes), fingerprint.

    Two documents agree at a place of the signature if the same ``size`` occurrence-numbered k-mers are least in both and come
    in the same order, so the share of agreeing places falls with the edit distance, moved passages included. fingerprint is
    a hash of the signature. One pass over the whole texts, no shuffle.

    Null and empty texts have 0 k-mers and a null signature and fingerprint; a text of less than ``k`` characters is one
    k-mer, and one of fewer than ``size`` k-mers gives tuples of all of them. Equal least values keep the first occurrence.
    Equal rows have equal signatures, each its own row; null ids are kept. Other columns are left out. An empty input gives
    an empty result.
    """
    if not (k > 0 and size > 0 and 0 < sketches <= 256):
        raise ValueError("k and size are positive and sketches at most 256")
    source = docs.select(id_col, text_col)
    shape = T.StructType([source.schema[id_col], T.StructField("n_kmers", T.LongType()), T.StructField("signature", T.ArrayType(T.LongType())), T.StructField("fingerprint", T.LongType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                count, rows, one = [], [], []
                for text in part.column(1).to_pylist():
                    x = numbered(text or "", k)
                    count.append(len(x))
                    s = order_minhash(x, size, sketches) if len(x) else None
                    rows.append(None if s is None else signed(s))
                    one.append(None if s is None else int(signed(salted(rolling(s, len(s)), 9))[0]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count, pa.int64()), pa.array(rows, pa.list_(pa.int64())), pa.array(one, pa.int64())], names=shape.names)

    return source.mapInArrow(task, shape)


def agreement(a: str, b: str):
    """The share of places at which two signature columns agree: from 0 to 1, null where either signature is null (a null or empty text)."""
    pairs = F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x) / F.size(a)
