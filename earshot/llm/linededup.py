"""Line deduplication with two bit filters, for lines seen once and lines seen twice; only suspected repeats are shuffled."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.llm import bits
from earshot.llm.places import PLACE, Placed
from earshot.llm.textkit import NEWLINE, buffers, chunks, tokens
from earshot.storage import cut

HASHES = 2
PART_BYTES = 128 << 20  # of text, whose lists of dropped lines lie together


def _lines(column: pa.Array) -> Iterator[tuple]:
    data, at = buffers(column)
    for i, j in chunks(at):
        yield i, at, data, *tokens(data, at[i : j + 1], NEWLINE)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_line: int = 8, bytes_per_line: int = 64, most_bits: int = 1 << 29) -> DataFrame:
    """Each document without the lines that occurred before it or higher up in it.

    The first occurrence of a line is that of the least ``id_col``, and within a document the topmost. Two Bloom filters are
    filled by all tasks, one with the lines seen once and one with those seen twice; a line goes to the exact step only if the
    second holds it. The exact step groups these suspects by the whole line. The filters take ``bits_per_line`` for each
    ``bytes_per_line`` of text, at most ``most_bits`` (64 MB to each worker); when that is too little they let more lines pass
    to the exact step, and the result is the same. What is to be dropped is written as lists of line numbers by the place of
    each document in its file, which the tasks that scan the files read again: no document is shuffled.

    Result: ``id_col``, text, lines_removed (bigint), a row for each row of the input. A null text gives a null text and 0.
    Lines are compared byte by byte; empty lines are no repeats and stay. Rows of one id count as one document: they don't
    make one another's lines repeats, and equal rows come out equal. Null ids come after all others and count as one
    document. Other columns are left out. An empty input gives an empty result.
    """
    placed = Placed(docs)
    source = placed.df.select(placed.col(id_col).alias("id"), placed.col(text_col).alias("text"), *PLACE)
    kind = source.schema["id"].dataType
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    log2 = bits.width(size / bytes_per_line, bits_per_line, most_bits)

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        # a line counts once a document: repeats within one are found when it is at hand
        parts = []
        for _, _, _, h, _, _, rows in _lines(batch.column(0)):
            row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            parts.append(h[fresh])
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    twice = bits.build(source.select("text"), hashes, log2, HASHES, ("twice",))["twice"]
    shared = source.sparkSession.sparkContext.broadcast(twice)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lines that the filter holds, and repeats within a document (with no line: they need no other step)."""
        seen = shared.value
        for batch in batches:
            whose, which, text = [], [], []
            for i, at, data, h, starts, ends, rows in _lines(batch.column(1)):
                maybe = bits.holds(seen, h, log2, HASHES)
                for r in range(len(rows) - 1):
                    low, high = rows[r], rows[r + 1]
                    inner = np.unique(h[low:high]).size < high - low
                    if not inner and not maybe[low:high].any():
                        continue
                    breaks = None
                    have: set[bytes] = set()
                    for n in range(low, high):
                        if not inner and not maybe[n]:
                            continue
                        line = data[starts[n] : ends[n]].tobytes()
                        again = line in have
                        have.add(line)
                        if again or maybe[n]:
                            if breaks is None:
                                base = int(at[i + r])
                                breaks = np.flatnonzero(data[base : ends[high - 1]] == 10) + base
                            whose.append(i + r)
                            which.append(int(np.searchsorted(breaks, starts[n])))
                            text.append(None if again else line.decode())
            take = pa.array(whose, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in (0, 2, 3)), pa.array(which, pa.int32()), pa.array(text, pa.string())], names=["id", *PLACE, "line_no", "line"])

    shape = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in PLACE), T.StructField("line_no", T.IntegerType()), T.StructField("line", T.StringType())])
    found = cut(source.mapInArrow(suspects, shape))
    # A null id is after all others: the least id of a line is null only where no other document has it.
    lines = found.where("line is not null")
    first = lines.groupBy("line").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"), F.count("id").alias("named"))
    first = first.where("first is not null and (first != last or named < n)").select("line", "first")
    later = lines.join(first, "line").where("id is null or id != first").select(*PLACE, "line_no")
    drops = found.where("line is null").select(*PLACE, "line_no").union(later).groupBy(*PLACE).agg(F.sort_array(F.collect_set("line_no")).alias("drop"))
    names = [c.lower() for c in placed.columns]
    id_at, text_at = names.index(id_col.lower()), names.index(text_col.lower())

    def without(batch: pa.RecordBatch, at: np.ndarray, lists: pa.Array | None) -> pa.RecordBatch:
        text, removed = batch.column(text_at), np.zeros(batch.num_rows, np.int64)
        if len(at):
            kept = []
            for t, drop in zip(text.take(pa.array(at)).to_pylist(), lists.to_pylist()):
                gone = set(drop)
                kept.append("\n".join(line for n, line in enumerate(t.split("\n")) if n not in gone))
            removed[at] = pa.compute.list_value_length(lists).to_numpy()
            text = pa.compute.replace_with_mask(text, pa.array(removed > 0), pa.array(kept, text.type))
        return pa.RecordBatch.from_arrays([batch.column(id_at), text, pa.array(removed)], names=[id_col, "text", "lines_removed"])

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("text", T.StringType()), T.StructField("lines_removed", T.LongType())])
    return placed.apply(drops, math.ceil(size / PART_BYTES), without, schema)


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, u.line AS line, u.n AS n
  FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n) u
), marked AS (
  SELECT *, line != '' AND row_number() OVER (PARTITION BY line ORDER BY doc_id, n) > 1 AS repeat FROM lines
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT repeat), '') AS text, count(*) FILTER (repeat) AS lines_removed
FROM marked GROUP BY doc_id
"""
