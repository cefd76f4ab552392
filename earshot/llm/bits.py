"""Bit filters built by all tasks and joined by a shuffle of sparse positions, for seen-once and seen-twice tests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.textkit import U64

SEGMENT = 16  # log2 of the bits of a segment, so that a position within it takes two bytes
PARTIAL = "seg int, once binary, twice binary"
WHOLE = "seg int, once binary, twice binary"


def width(expected: float, bits_each: int, most_bits: int) -> int:
    """log2 of the bits of a filter: a power of two of at least ``bits_each`` for each expected key, and at most ``most_bits`` in all.

    Beyond that the filter fills up and lets more keys pass, which costs a larger exact shuffle and changes no result.
    """
    return max(SEGMENT, min(most_bits.bit_length() - 1, int(np.ceil(np.log2(max(2.0, expected * bits_each))))))


def positions(h: np.ndarray, log2: int, k: int) -> list[np.ndarray]:
    mask = U64((1 << log2) - 1)
    with np.errstate(over="ignore"):
        step = (h >> U64(32)) | U64(1)
        return [((h + U64(i) * step * U64(0x9E3779B97F4A7C15)) >> U64(64 - log2)) & mask for i in range(k)]


def partial(h: np.ndarray, log2: int, k: int) -> Iterator[pa.RecordBatch]:
    """The set positions of a task's keys: once for all keys, twice for keys that it has at least twice."""
    keys, counts = np.unique(h, return_counts=True)
    once = np.unique(np.concatenate(positions(keys, log2, k))) if len(keys) else np.zeros(0, U64)
    again = keys[counts > 1]
    twice = np.unique(np.concatenate(positions(again, log2, k))) if len(again) else np.zeros(0, U64)
    seg = np.unique(once >> U64(SEGMENT))
    if not len(seg):
        return
    cut = lambda x: np.split(x.astype(np.uint16), np.searchsorted(x, seg[1:] << U64(SEGMENT)))
    yield pa.RecordBatch.from_arrays(
        [pa.array(seg.astype(np.int32)), pa.array([x.tobytes() for x in cut(once)], pa.binary()), pa.array([x.tobytes() for x in cut(twice)], pa.binary())],
        names=["seg", "once", "twice"],
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bit that two tasks set is set twice: a key of both has all of its bits among these."""
    have: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for seg, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
            if seg not in have:
                have[seg] = np.zeros(1 << SEGMENT, bool), np.zeros(1 << SEGMENT, bool)
            one, two = have[seg]
            x = np.frombuffer(once, np.uint16)
            two[x[one[x]]] = True
            one[x] = True
            two[np.frombuffer(twice, np.uint16)] = True
    for seg, (one, two) in have.items():
        yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int32()), pa.array([np.packbits(one, bitorder="little").tobytes()]), pa.array([np.packbits(two, bitorder="little").tobytes()])], names=["seg", "once", "twice"])


def build(source: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], log2: int, k: int, which: tuple[str, ...] = ("once", "twice")) -> dict[str, np.ndarray]:
    """The packed bits of the filters over ``hashes`` of all batches of ``source``. Their size is bounded by ``log2``, whatever the input."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [hashes(b) for b in batches]
        yield from partial(np.concatenate(parts) if parts else np.zeros(0, U64), log2, k)

    merged = source.mapInArrow(task, PARTIAL).repartition(F.col("seg")).mapInArrow(_merge, WHOLE).select("seg", *which)
    out = {w: np.zeros((1 << log2) // 8, np.uint8) for w in which}
    size = (1 << SEGMENT) // 8
    for row in merged.collect():
        for w in which:
            out[w][row["seg"] * size : (row["seg"] + 1) * size] = np.frombuffer(row[w], np.uint8)
    return out


def holds(bits: np.ndarray, h: np.ndarray, log2: int, k: int) -> np.ndarray:
    """Whether the filter may hold each key; never False for a key that it holds."""
    found = np.ones(len(h), bool)
    for p in positions(h, log2, k):
        found &= (bits[(p >> U64(3)).astype(np.intp)] >> (p & U64(7)).astype(np.uint8)) & np.uint8(1) != 0
    return found
