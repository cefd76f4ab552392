"""MinHash near-deduplication: universal hash minima, banding, signature verification, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.llm.components import components
from earshot.llm.decontaminate import shingles
from earshot.llm.places import PLACE, Placed
from earshot.llm.textkit import U64, mix, rolling, salted, signed
from earshot.storage import cut, forget

SHINGLE, THRESHOLD, BANDS, ROWS = 3, 0.5, 40, 3
BLOCK, LIST_ROWS = 2048, 200_000  # rows of a block of a bucket, and of the signature table for each part of the lists
_A = mix(np.arange(90001, 90001 + 1024, dtype=U64)) | U64(1)
_B = mix(np.arange(70001, 70001 + 1024, dtype=U64))


def signature(x: np.ndarray, k: int) -> np.ndarray:
    """The minima of ``k`` multiply-add-shift hashes, a universal family, over all shingles."""
    out = np.full(k, np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 1024):
            part = ((x[i : i + 1024, None] * _A[:k] + _B[:k]) >> U64(32)).astype(np.uint32)
            out = np.minimum(out, part.min(axis=0))
    return out


def signatures(source: DataFrame, shingle: int, k: int) -> DataFrame:
    """``source`` has id, text and any columns to carry. Of each row that has a word and an id: these but for the text, a 128-bit hash of the set of shingles (s1, s2), and the signature."""
    source = source.where("id is not null and text is not null")
    carried = [i for i, c in enumerate(source.columns) if c != "text"]
    text_at = source.columns.index("text")
    shape = T.StructType([*(source.schema[i] for i in carried), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("sig", T.BinaryType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whose, one, two, sig = [], [], [], []
            for r, x in shingles(batch.column(text_at), shingle):
                if not len(x):
                    continue
                x = np.unique(x)
                whose.append(r)
                one.append(rolling(x, len(x), 1)[0])
                two.append(rolling(x, len(x), 2)[0])
                sig.append(signature(x, k).tobytes())
            longs = lambda v: pa.array(signed(np.array(v, U64)))
            take = pa.array(whose, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in carried), longs(one), longs(two), pa.array(sig, pa.binary())], names=shape.names)

    return source.mapInArrow(task, shape)


def band_keys(sigs: DataFrame, bands: int, rows: int) -> DataFrame:
    """key, node: for each signature a key for each band."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                m = _matrix(part.column(1)).reshape(part.num_rows, bands, rows).astype(U64)
                key = np.zeros((part.num_rows, bands), U64)
                with np.errstate(over="ignore"):
                    for i in range(rows):
                        key = mix(key * U64(0xA0761D6478BD642F) + m[:, :, i] + U64(1))
                    key = salted(key + np.arange(bands, dtype=U64) * U64(0x9E3779B97F4A7C15), 3)
                yield pa.RecordBatch.from_arrays([pa.array(signed(key.ravel())), pa.array(np.repeat(np.asarray(part.column(0)), bands))], names=["key", "node"])

    return sigs.select("node", "sig").mapInArrow(task, "key bigint, node bigint")


def _matrix(column: pa.Array) -> np.ndarray:
    """Binary signatures as rows of minima."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


def join_similar(sig: np.ndarray, least: int, label: np.ndarray | None = None, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of rows of ``sig`` that agree at ``least`` places or more.

    Rows of equal ``label`` are connected already, and only rows of different ``side`` are compared, where these are given.
    Only pairs of rows that aren't connected yet are compared, so n like rows take n comparisons, and the forest has the same
    components as all pairs.
    """
    n, out = len(sig), []
    label = np.arange(n) if label is None else np.unique(label, return_inverse=True)[1]
    for i in range(n):
        apart = label != label[i]
        if side is not None:
            apart &= side != side[i]
        others = np.flatnonzero(apart[i + 1 :]) + i + 1
        if len(others):
            like = others[(sig[others] == sig[i]).sum(axis=1) >= least]
            if len(like):
                # one edge to each component that is new to i
                names, first = np.unique(label[like], return_index=True)
                out += [(i, int(j)) for j in like[first]]
                label[np.isin(label, names)] = label[i]
    return out


def _agree(least: int):
    """node, head and whether their signatures agree at ``least`` places."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                alike = (_matrix(batch.column(2)) == _matrix(batch.column(3))).sum(axis=1) >= least
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike)], names=["node", "head", "alike"])

    return task


def _verify(least: int):
    """Edges between the labels of the rows of each unit. Rows (key, i, j, side, label, sig) come sorted by unit, which may go on in the next batch."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []

        def close() -> pa.RecordBatch:
            side, label, sig = (np.concatenate(x) for x in zip(*rows))
            pairs = np.array(join_similar(sig, least, label, side if unit[1] != unit[2] else None), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(label[pairs[:, 0]]), pa.array(label[pairs[:, 1]])], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            name = np.stack([np.asarray(batch.column(i)) for i in range(3)])
            side, label, sig = np.asarray(batch.column(3)), np.asarray(batch.column(4)), _matrix(batch.column(5))
            cuts = [0, *(np.flatnonzero((name[:, 1:] != name[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if (now := tuple(name[:, a].tolist())) != unit:
                    if rows:
                        yield close()
                    unit, rows = now, []
                rows.append((side[a:b], label[a:b], sig[a:b]))
        if rows:
            yield close()

    return task


def _only(listed: bool):
    """For Placed.apply: the rows that are listed, or those that aren't."""

    def change(batch: pa.RecordBatch, at: np.ndarray, _: pa.Array | None) -> pa.RecordBatch:
        keep = np.full(batch.num_rows, not listed)
        keep[at] = listed
        return batch.filter(pa.array(keep))

    return change


def similar_groups(table: DataFrame, threshold: float, bands: int, rows: int, same: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """node, component: the components, of two nodes or more, of all verified pairs of rows of a written ``table`` (node, s1, s2, sig).

    Rows of one set of shingles are linked to the least of them and stand back. Of the rest those that share a band's key are
    a bucket. First each member is verified against the bucket's least node, its head: a pair for each (member, head), with no
    row for a bucket as a whole, so that a group of like documents, however large, is linked by one comparison a member.
    Only buckets with a member unlike its head go on, and only if they hold several components by then. In these each member
    of another component than the head's (a stray) is compared with all others: members are cut in blocks of some ``block``
    rows, and each pair of blocks with strays is a unit of work of its own, so no bucket is held by one task. Buckets of the
    same members count once. No pair that shares a band is left out. ``same`` has further edges (u, v).
    """
    least = int(np.ceil(threshold * bands * rows - 1e-9))
    stored = Placed(table)
    parts = table.count() / LIST_ROWS
    c = lambda name: stored.col(name).alias(name)
    lead = table.groupBy("s1", "s2").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1")
    copies = cut(stored.df.select(c("node"), c("s1"), c("s2"), *PLACE).join(lead, ["s1", "s2"]).where("node != lead").select(F.col("node").alias("u"), F.col("lead").alias("v"), *PLACE))
    front = cut(stored.apply(copies.select(*PLACE), parts, _only(False), table.schema).select("node", "sig"))
    keyed = band_keys(front, bands, rows)
    heads = keyed.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("tail")).where("head != tail").select("key", "head")
    member = cut(keyed.join(heads, "key").where("node != head"))
    pairs = member.select("node", "head").distinct()
    involved = pairs.select("node").union(pairs.select("head")).distinct()
    fronts = Placed(front)
    wanted = fronts.df.select(fronts.col("node").alias("node"), *PLACE).join(involved, "node").select(*PLACE)
    sigs = cut(fronts.apply(wanted, parts, _only(True), front.schema))
    forget(front)
    both = pairs.join(sigs, "node").join(sigs.select(F.col("node").alias("head"), F.col("sig").alias("head_sig")), "head")
    checked = cut(both.select("node", "head", "sig", "head_sig").mapInArrow(_agree(least), "node bigint, head bigint, alike boolean"))
    star = checked.where("alike").select(F.col("node").alias("u"), F.col("head").alias("v")).union(copies.select("u", "v"))
    found = cut(components(star if same is None else star.union(same)))
    unlike = checked.where("not alike").select("node", "head")
    if unlike.isEmpty():
        return found
    open_keys = member.join(unlike, ["node", "head"], "left_semi").select("key").distinct()
    inside = member.join(open_keys, "key", "left_semi")
    inside = inside.select("key", "node").union(inside.select("key", F.col("head").alias("node")).distinct())
    named = cut(inside.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label")))
    both_hashes = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by("label", "node").alias("home"), F.count("*").alias("n"), *both_hashes).where("lo != hi")
    chosen = mixed.groupBy("home", "n", "x1", "x2").agg(F.min("key").alias("key")).select("key", "home")
    rows_of = cut(named.join(chosen, "key").select("key", "node", "label", (F.col("label") != F.col("home")).alias("stray")))
    blocks = rows_of.groupBy("key").agg(*(F.ceil(F.count_if(F.col("stray") == s) / block).alias(g) for s, g in ((True, "gs"), (False, "gh"))))
    at = lambda g: F.pmod(F.xxhash64("node"), F.col(g))
    sided = rows_of.join(blocks, "key").withColumn("side", F.when(F.col("stray"), at("gs")).otherwise(F.col("gs") + at("gh")))
    others = F.sequence(F.lit(0).cast("bigint"), F.when(F.col("stray"), F.col("gs") + F.col("gh")).otherwise(F.col("gs")) - 1)
    units = sided.join(sigs, "node").select("key", "label", "side", "sig", F.explode(others).alias("other")).select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "label", "sig")
    units = units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = cut(components(units.mapInArrow(_verify(least), "u bigint, v bigint")))
    joined = found.join(more.select(F.col("node").alias("label"), F.col("component").alias("whole")), F.col("component") == F.col("label"), "full_outer")
    return joined.select(F.coalesce("node", "label").alias("node"), F.coalesce("whole", "component").alias("component"))


def _signed_table(source: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    if bands * rows > len(_A):
        raise ValueError("too many hashes")
    return cut(signatures(source, shingle, bands * rows).withColumn("node", F.monotonically_increasing_id()))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The groups of near-duplicates: a row of ``id_col``, group_id, group_size for each document of a group of two or more.

    Texts are sets of runs of ``shingle`` words (letters and digits, ASCII letters in lower case; a shorter text is one run).
    Two documents are a pair if they share a band of ``rows`` of the ``bands`` x ``rows`` minima and agree in at least
    ``threshold`` of all minima; groups are the connected components of the pairs, named by their least id.

    Equal texts always fall in one group. Rows of one id are one document, with each of its texts. Null and empty texts,
    texts without a word, and rows without an id match nothing. Other columns are left out. An empty input gives an empty
    result.
    """
    table = _signed_table(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), shingle, bands, rows)
    lead = table.groupBy("id").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1")
    same = table.select("id", "node").join(lead, "id").where("node != lead").select(F.col("node").alias("u"), F.col("lead").alias("v"))
    groups = similar_groups(table, threshold, bands, rows, same, block)
    ids = cut(groups.join(table.select("node", "id"), "node").select("component", "id").distinct())
    named = ids.groupBy("component").agg(F.min("id").alias("group_id"), F.count("*").alias("group_size")).where("group_size > 1")
    return ids.join(named, "component").select(F.col("id").alias(id_col), "group_id", "group_size")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows without all but one of each group of near-duplicates, with the columns of the input, whatever their names.

    Groups are as in ``near_duplicates``, but of rows: the row of the least id stays, and of rows of that id the one of the
    least hash of its text. Rows of one id with unlike texts are no duplicates and all stay, as do rows without an id, null
    and blank texts. Rows that are equal in id and text are copies, of which one stays. No text is shuffled: the tasks that
    scan the documents read which of their rows go. An empty input gives an empty result.
    """
    placed = Placed(docs)
    table = _signed_table(placed.df.select(placed.col(id_col).alias("id"), placed.col(text_col).alias("text"), *PLACE), shingle, bands, rows)
    groups = cut(similar_groups(table.select("node", "s1", "s2", "sig"), threshold, bands, rows, None, block).join(table.select("node", "id", "s1", "s2", *PLACE), "node"))
    stays = groups.groupBy("component").agg(F.min(F.struct("id", "s1", "s2", "node"))["node"].alias("stays"))
    losers = groups.join(stays, "component").where("node != stays").select(*PLACE)
    return placed.apply(losers, table.count() / LIST_ROWS, _only(False), docs.schema)

