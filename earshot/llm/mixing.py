"""Mixing sources to target weights by pivotal dependent rounding over a distributed reduction tree."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.llm.places import PLACE, Placed
from earshot.llm.textkit import U64, salted
from earshot.storage import cut

#: Production weights: the share of a source is in proportion to its size to this power, and the mix has as many documents as came in.
TEMPERATURE = 0.7
LEAF_ROWS, FAN_IN_BITS, LIST_ROWS = 4096, 6, 200_000
#: Up to so many sources their table is sent to all workers; beyond, it is joined as it comes.
BROADCAST_SOURCES = 100_000
WHOLE = 1e-9


def uniform(key: np.ndarray, seed: int) -> np.ndarray:
    """A number in (0, 1) for each row key, fixed by the seed."""
    return ((salted(key.view(U64), seed) >> U64(11)).astype(np.float64) + 0.5) / (1 << 53)


def pivotal(p: np.ndarray, key: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Round probabilities so that their sum keeps up: in turn, pair the one left over with the next and move mass until one is 0 or 1.

    Gives the rounded values and the position of the one that is still fractional (-1 for none), whose value is its remainder.
    The expectation of each is its probability, and the sum never changes.
    """
    p, open_, draws = p.astype(np.float64).tolist(), -1, uniform(key, seed).tolist()
    for j in range(len(p)):
        if p[j] < WHOLE or p[j] > 1 - WHOLE:
            p[j] = round(p[j])
            continue
        if open_ < 0:
            open_ = j
            continue
        a, b, u = p[open_], p[j], draws[j]
        if a + b < 1:
            keep, lose = (open_, j) if u < a / (a + b) else (j, open_)
            p[keep], p[lose] = a + b, 0.0
        else:
            one, rest = (open_, j) if u < (1 - b) / (2 - a - b) else (j, open_)
            p[one], p[rest] = 1.0, a + b - 1
            keep = rest
        if WHOLE < p[keep] < 1 - WHOLE:
            open_ = keep
        else:
            p[keep], open_ = round(p[keep]), -1
    return np.array(p, np.float64), open_


def expectations(docs: DataFrame, weights: Mapping[str | None, float] | None, total: float | None, temperature: float, source_col: str) -> tuple[DataFrame, int, int, float]:
    """A row for each source with the expected copies of each of its documents; the number of sources, of the largest one's documents, and of all.

    The table stays distributed; one row of sums comes to the driver. Weights are summed as decimals, so no order matters.
    """
    if weights is not None and any(not math.isfinite(w) or w < 0 for w in weights.values()):
        raise ValueError("weights are finite and not negative")
    counts = cut(docs.groupBy(F.col(source_col).alias("s")).agg(F.count("*").alias("n")))
    if weights is None:
        weighted = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        shape = T.StructType([T.StructField("given", docs.schema[source_col].dataType), T.StructField("w", T.DoubleType())])
        table = docs.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], shape)
        weighted = counts.join(table, F.expr("s <=> given"), "left").select("s", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    sums = weighted.agg(F.count("*"), F.max("n"), F.sum("n"), F.sum(F.col("w").cast("decimal(38,9)")).cast("double")).first()
    sources, largest, n, all_of = sums[0], sums[1] or 0, float(sums[2] or 0), sums[3] or 0.0
    each = F.lit(n if total is None else float(total)) * F.col("w") / F.lit(all_of or 1.0) / F.col("n")
    return weighted.select("s", (each if all_of > 0 else F.lit(0.0)).alias("expected")), sources, largest, n


def copies(docs: DataFrame, weights: Mapping[str | None, float] | None = None, total: float | None = None, *, temperature: float = TEMPERATURE, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """How often each document is in the mix: a row of ``id_col``, ``source_col``, ordinal, expected, copies for each row.

    A source's share of ``total`` (as many as there are documents, if not given) is its part of the weights; by default that
    is its size to the power ``temperature``. Each of its documents expects the same number of copies; the whole part is
    given and the fraction is rounded by the pivotal method, so a source gets its share to within one document, the mix its
    total to within one, and every document its expectation on average.

    Rows fall into leaves by a hash of source, id and ordinal, as many leaves as give each about ``leaf_rows``; each leaf
    pairs its rows in hash order and passes on at most one remainder, and a tree of fan-in 64 pairs these, up to one a source.
    A second tree of the same kind pairs the remainders of all sources, up to a last one, which is drawn by its own value.
    Draws are fixed by the seed and the rows, so neither partitions nor a lost executor change the result. Only ids and
    sources are shuffled, no texts.

    Rows of equal id and source are told apart by ordinal, 0 for the first. Null ids and null sources count as values of
    their own. A source without weight gets no copies; with no weight at all no document does. Negative or non-finite
    weights raise ValueError. Other columns are left out. An empty input gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.lit(0).cast("bigint").alias(PLACE[0]), F.lit(0).cast("bigint").alias(PLACE[1]))
    given, _ = _copies(source, weights, total, temperature, seed, leaf_rows)
    return given.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "ordinal", "expected", "copies")


def _copies(source: DataFrame, weights: Mapping[str | None, float] | None, total: float | None, temperature: float, seed: int, leaf_rows: int) -> tuple[DataFrame, float]:
    """id, source, ordinal, n (rows of equal id and source), a place (that of the row, where n is 1), expected and copies; and the number of rows."""
    table, sources, largest, rows_in = expectations(source, weights, total, temperature, "source")
    base = source.groupBy("id", "source").agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in PLACE))
    rows = base.select("id", "source", "n", *PLACE, F.explode(F.expr("sequence(0, cast(n - 1 as int))")).alias("ordinal")).withColumn("key", F.xxhash64("source", "id", "ordinal"))
    table = F.broadcast(table) if sources <= BROADCAST_SOURCES else table
    deep = lambda n: max(0, math.ceil(math.log2(max(1, n) / leaf_rows)))
    top = lambda c, bits: F.shiftrightunsigned(c, 64 - bits) if bits else F.lit(0).cast("bigint")
    depth = deep(largest)
    shaped = rows.join(table, F.expr("source <=> s")).select("id", "source", "n", *PLACE, "ordinal", "key", "expected", F.xxhash64("source").alias("tree"), top("key", depth).alias("leaf"), (F.col("expected") % 1.0).alias("p"))
    bare = ["tree", "leaf", "source", "key", "p"]

    def pair(level: int):
        def group(batch: pd.DataFrame) -> pd.DataFrame:
            batch = batch.sort_values(["key", "tree"], kind="stable", ignore_index=True)
            p, at = pivotal(batch["p"].to_numpy(), batch["key"].to_numpy(), seed * 64 + level)
            return batch.assign(p=p, open=np.arange(len(batch)) == at)

        return group

    def paired(df: DataFrame, level: int, by: list[str]) -> DataFrame:
        shape = T.StructType([*df.schema.fields, T.StructField("open", T.BooleanType())])
        return cut(df.groupBy(*by).applyInPandas(pair(level), shape))

    leaves = paired(shaped, 0, ["source", "leaf"])
    level, settled, n = leaves.where("open").select(*bare), None, 0
    for depth, by in ((depth, ["source", "leaf"]), (deep(sources) + FAN_IN_BITS, ["leaf"])):
        if by == ["leaf"]:
            # one remainder a source is left: sources fall into leaves by their own hash
            level = level.withColumn("leaf", top("tree", depth))
        while depth > 0:
            depth, n = max(0, depth - FAN_IN_BITS), n + 1
            up = paired(level.withColumn("leaf", F.shiftright("leaf", FAN_IN_BITS) if depth else F.lit(0).cast("bigint")), n, by)
            done = up.where("not open").select("source", "key", "p")
            settled = done if settled is None else settled.union(done)
            level = up.where("open").select(*bare)
    # one remainder is left in all: it is drawn by its own probability
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "source", "key"), 11).cast("double") + 0.5) / float(1 << 53)
    last = level.select("source", "key", F.when(u < F.col("p"), 1.0).otherwise(0.0).alias("p"))
    settled = settled.union(last).select(F.col("source").alias("_source"), F.col("key").alias("_key"), F.col("p").alias("late"))
    given = F.floor("expected") + F.when(F.col("open"), F.col("late")).otherwise(F.col("p")).cast("bigint")
    out = leaves.join(settled, F.expr("key = _key and source <=> _source"), "left")
    return out.select("id", "source", "ordinal", "n", *PLACE, "expected", given.cast("bigint").alias("copies")), rows_in


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float] | None = None, total: float | None = None, *, temperature: float = TEMPERATURE, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``copies`` says, with the columns of the input, whatever their names.

    No text is shuffled: the tasks that scan the documents read how often each of their rows is wanted. Rows of equal id and
    source have their ordinals by their places in the files; those of one id and source are numbered in some 256 parts, so
    that no task holds all rows without an id. Null ids, null sources, repeated rows, weights and empty inputs are as for
    ``copies``.
    """
    placed = Placed(docs)
    source = placed.df.select(placed.col(id_col).alias("id"), placed.col(source_col).alias("source"), *PLACE)
    given, rows_in = _copies(source, weights, total, temperature, seed, leaf_rows)
    given = cut(given.where("copies != 1"))
    once = given.where("n = 1").select(*PLACE, "copies")
    again = given.where("n > 1").select(F.col("id").alias("g_id"), F.col("source").alias("g_source"), "ordinal", "copies")
    pairs = again.select("g_id", "g_source").distinct()
    same = F.expr("id <=> g_id and source <=> g_source")
    twice = source.join(pairs, same, "left_semi").withColumn("salt", F.pmod(F.xxhash64(*PLACE), F.lit(256)))
    sizes = twice.groupBy("id", "source", "salt").count()
    before = F.sum("count").over(Window.partitionBy("id", "source").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col("id").alias("g_id"), F.col("source").alias("g_source"), F.col("salt").alias("g_salt"), F.coalesce(before, F.lit(0)).alias("offset"))
    nth = F.row_number().over(Window.partitionBy("id", "source", "salt").orderBy(*PLACE)) - 1
    numbered = twice.withColumn("nth", nth).join(offsets, same & (F.col("salt") == F.col("g_salt"))).select("id", "source", *PLACE, (F.col("nth") + F.col("offset")).alias("at"))
    late = numbered.join(again, same & (F.col("at") == F.col("ordinal"))).select(*PLACE, "copies")

    def change(batch: pa.RecordBatch, at: np.ndarray, wanted: pa.Array | None) -> pa.RecordBatch:
        times = np.ones(batch.num_rows, np.int64)
        if len(at):
            times[at] = wanted.to_numpy()
        return batch.take(pa.array(np.repeat(np.arange(batch.num_rows), times)))

    return placed.apply(once.union(late), rows_in / LIST_ROWS, change, docs.schema)
