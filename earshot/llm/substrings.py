"""Substring deduplication with fixed-block anchors: blocks of words are indexed, every rolling window probes them, hits grow to maximal repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.llm import bits
from earshot.llm.textkit import SPACES, U64, buffers, chunks, mix, rolling, signed, tokens
from earshot.storage import cut

HASHES = 4
MIN_WORDS = 50
AT_ONCE = 1 << 20  # runs of words that a task holds before it hands them on, or resolves at once


def _rows(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Number and word hashes of each row."""
    data, at = buffers(column)
    for i, j in chunks(at):
        h, _, _, rows = tokens(data, at[i : j + 1], SPACES)
        for r in range(j - i):
            yield i + r, h[rows[r] : rows[r + 1]]


def _least_of(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` values that follow on one another."""
    width = 1
    while 2 * width <= n:
        x, width = np.minimum(x[:-width], x[width:]), 2 * width
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def _candidates(have: dict[str, np.ndarray], log2: int, min_words: int, block: int):
    """Rows (m, c1, c2, id, version, at, n, hs, length, back): stretches of runs around hits, and pieces whose runs were in the document before.

    Of like stretches (c1, c2) the least place has their number and the runs' hashes. A piece has its length in runs, and
    where it was ``back``; it needs no other task.
    """

    def stretches(h: np.ndarray) -> tuple[np.ndarray, ...] | None:
        n = len(h) - min_words + 1
        probe = rolling(h, block)
        hit = bits.holds(have["once"], probe, log2, HASHES)
        hit[::block] = bits.holds(have["twice"], probe[::block], log2, HASHES)
        if not hit.any():
            return None
        # a run of min_words words at i holds the windows i to i + min_words - block; their least is the anchor it meets others at
        count = np.concatenate([[0], np.cumsum(hit)])
        near = np.flatnonzero(count[min_words - block + 1 :][:n] > count[:n])
        if not len(near):
            return None
        one, two = rolling(h, min_words, 1)[near], rolling(h, min_words, 2)[near]
        order = np.lexsort((near, two >> U64(32), one))
        same = (one[order][1:] == one[order][:-1]) & ((two[order][1:] ^ two[order][:-1]) >> U64(32) == 0)
        back = np.full(len(near), -1)
        back[order[1:][same]] = near[order[:-1][same]]
        again = back >= 0
        at, back = near[again], back[again]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1] + 1) | (back[1:] != back[:-1] + 1)
        begins = np.flatnonzero(fresh)
        within = at[begins], np.diff([*begins, len(at)]), back[begins]
        near, one, two = near[~again], one[~again], two[~again]
        anchor = _least_of(probe, min_words - block + 1)[near]
        fresh = np.ones(len(near), bool)
        fresh[1:] = (near[1:] != near[:-1] + 1) | (anchor[1:] != anchor[:-1])
        begins = np.flatnonzero(fresh)
        # no stretch is longer than a run, so that its first and last run have all of its words
        since = np.arange(len(near)) - np.repeat(begins, np.diff([*begins, len(near)]))
        begins = np.flatnonzero(fresh | (since % min_words == 0))
        ends = np.append(begins[1:], len(near))
        with np.errstate(over="ignore"):
            c1 = mix(one[begins] * U64(0xA0761D6478BD642F) + one[ends - 1] + (ends - begins).astype(U64))
            c2 = mix(two[begins] * U64(0xE7037ED1A0B428DB) + two[ends - 1] + (ends - begins).astype(U64))
        packed = np.empty(len(near), _PACKED)
        packed["a"], packed["b"] = one, two >> U64(32)
        return anchor[begins], c1, c2, near[begins], ends - begins, packed, *within

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, versions, found, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            anchor, c1, c2, at, count, packed, start, length, back = (np.concatenate([f[i] for f in found]) for i in range(9))
            all_ids, all_versions = pa.concat_arrays(ids), pa.concat_arrays(versions)
            whose = lambda i: pa.array(np.repeat(np.arange(len(found)), [len(f[i]) for f in found]))
            ints = lambda x: pa.array(x.astype(np.int32))
            names = ["m", "c1", "c2", "id", "version", "at", "n", "hs", "length", "back"]
            none = lambda n, kind: pa.nulls(n, kind)
            if n := len(start):
                yield pa.RecordBatch.from_arrays([*[none(n, pa.int64())] * 3, all_ids.take(whose(6)), all_versions.take(whose(6)), ints(start), none(n, pa.int64()), none(n, pa.binary()), ints(length), ints(back)], names=names)
            if not len(at):
                return
            table = pa.table({"c1": signed(c1), "c2": signed(c2), "id": all_ids.take(whose(0)), "version": all_versions.take(whose(0)), "at": at})
            order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("c1", "c2", "id", "version", "at")], null_placement="at_end")
            o = order.to_numpy()
            first = np.ones(len(o), bool)
            first[1:] = (c1[o][1:] != c1[o][:-1]) | (c2[o][1:] != c2[o][:-1])
            n = np.zeros(len(o), np.int64)
            n[first] = np.diff([*np.flatnonzero(first), len(o)])
            upto = np.concatenate([[0], np.cumsum(count)])
            hs = [packed[upto[i] : upto[i + 1]].tobytes() if f else None for i, f in zip(o.tolist(), first)]
            table = table.take(order).combine_chunks()
            column = lambda c: table.column(c).combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array(signed(anchor[o])), *(column(c) for c in ("c1", "c2", "id", "version")), ints(at[o]), pa.array(n, mask=~first), pa.array(hs, pa.binary()), *[none(len(o), pa.int32())] * 2], names=names)

        for batch in batches:
            for r, h in _rows(batch.column(1)):
                if len(h) < min_words or (x := stretches(h)) is None:
                    continue
                found.append(x)
                ids.append(batch.column(0).slice(r, 1))
                versions.append(batch.column(2).slice(r, 1))
                held += len(x[5]) + len(x[6])
                if held >= AT_ONCE:
                    yield from flush()
                    ids, versions, found, held = [], [], [], 0
        if found:
            yield from flush()

    return task


#: 96 bits of the hash of a run: 64 and 32 of two independent ones.
_PACKED = np.dtype([("a", "<u8"), ("b", "<u4")])


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by m, for each stretch the pieces of it whose runs occur first at places that follow on one another, if they occur elsewhere."""
    names = ["c1", "c2", "off", "length", "first_id", "first_version", "first_at"]

    def close(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        c1, c2, at, n = (t.column(c).to_numpy() for c in ("c1", "c2", "at", "n"))
        order = pc.sort_indices(t.select(["id", "version"]), sort_keys=[("id", "ascending"), ("version", "ascending")], null_placement="at_end").to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        # rows of one document have one rank
        ids, versions = t.column("id").combine_chunks(), t.column("version").to_numpy()
        sorted_ids = ids.take(pa.array(order))
        same = np.zeros(len(order), bool)
        if len(order) > 1:
            equal = pc.fill_null(pc.equal(sorted_ids.slice(1), sorted_ids.slice(0, len(order) - 1)), False).to_numpy(zero_copy_only=False)
            both_null = pc.and_(pc.is_null(sorted_ids.slice(1)), pc.is_null(sorted_ids.slice(0, len(order) - 1))).to_numpy(zero_copy_only=False)
            same[1:] = (equal | both_null) & (versions[order][1:] == versions[order][:-1])
        rank[order] = np.cumsum(~same) - 1
        holder = order[~same]
        runs = [np.frombuffer(x, _PACKED) for x in t.column("hs").to_pylist()]
        size = np.array([len(x) for x in runs])
        whole = np.concatenate(runs)
        owner = np.repeat(np.arange(len(runs)), size)
        off = np.arange(len(whole)) - np.repeat(np.cumsum(size) - size, size)
        place = at[owner] + off
        o = np.lexsort((place, rank[owner], whole["b"], whole["a"]))
        a, b = whole["a"][o], whole["b"][o]
        first = np.ones(len(o), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        group = np.cumsum(first) - 1
        total = np.bincount(group, n[owner[o]]).astype(np.int64)
        f_rank, f_place, documents = (np.empty(len(o), np.int64) for _ in range(3))
        f_rank[o], f_place[o], documents[o] = rank[owner[o][first]][group], place[o][first][group], total[group]
        # one of like stretches is enough
        lead = np.zeros(len(runs), bool)
        lead[np.unique(np.stack([c1, c2]), axis=1, return_index=True)[1]] = True
        keep = np.flatnonzero(lead[owner] & (documents > 1))
        if not len(keep):
            return pa.RecordBatch.from_arrays([pa.array([], x) for x in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), ids.type, pa.int64(), pa.int32())], names=names)
        shift = f_place[keep] - off[keep]
        fresh = np.ones(len(keep), bool)
        fresh[1:] = (keep[1:] != keep[:-1] + 1) | (owner[keep][1:] != owner[keep][:-1]) | (f_rank[keep][1:] != f_rank[keep][:-1]) | (shift[1:] != shift[:-1])
        begins = np.flatnonzero(fresh)
        k = keep[begins]
        doc = pa.array(holder[f_rank[k]])
        length = np.diff([*begins, len(keep)])
        ints = lambda x: pa.array(x.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(c1[owner[k]]), pa.array(c2[owner[k]]), ints(off[k]), ints(length), ids.take(doc), pa.array(versions[holder[f_rank[k]]]), ints(f_place[k])], names=names)

    parts, held = [], 0
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        m = batch.column(0).to_numpy()
        if held >= AT_ONCE:
            # all rows of an anchor are resolved together
            until = int(np.searchsorted(m, last, "right")) if m[0] == last else 0
            if until:
                parts.append(batch.slice(0, until))
            if until < batch.num_rows:
                yield close(parts)
                parts, held, batch = [], 0, batch.slice(until)
            else:
                continue
        parts.append(batch)
        held += sum(len(x) for x in batch.column(7).to_pylist()) // _PACKED.itemsize
        last = m[-1]
    if parts:
        yield close(parts)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", bits_per_block: int = 24, bytes_per_word: int = 6, most_bits: int = 1 << 30) -> DataFrame:
    """The maximal exact repeats of ``min_words`` words and more, each beside the place where its words occur first.

    With blocks of b = (min_words + 1) // 2 words laid end to end over each document, every run of ``min_words`` words holds
    one whole block. Two bit filters index the blocks, one those seen once and one those seen twice, and every rolling window
    of b words probes them: a window that lies on its own block counts if that block is in the second, any other if it is in
    the first. A repeated run holds such a window in each place where it occurs, so only runs around hits go on, in stretches
    that share an anchor, the least window of b words by hash. Like runs have like anchors, so stretches are shuffled by
    anchor, once for all like ones of a task; there the first place of each run is found by 96 bits of its hash. Runs that
    the document itself had before are settled where they are read. Runs that follow on one another both here and there grow to the maximal repeat. No pairs of places are formed, and a passage
    with many copies is no larger a task than one with few. The filters' size is bounded by ``most_bits``; when they are full
    more runs go to the exact step and the result is the same.

    Result: ``id_col``, start_word, end_word (after the last), n_words, first_doc_id, first_word. The words from start_word on
    are those of first_doc_id from first_word on, all n_words of them. For runs that the document has had before, that is the
    last place before; for others the least place of all, by id and place. Each such place has a row of its own, with itself
    as first. A span ends where the next run is new or comes from elsewhere; spans may overlap.

    Words are parted by ASCII white space and compared byte by byte, so a repeat may differ in white space. Null and short
    texts have no spans. Rows equal in id and text are one document; the texts of one id are apart, in an order by their
    hash. A null id is the greatest, and stays. Other columns are left out. An empty input gives an empty result.
    """
    if min_words < 2:
        raise ValueError("min_words is at least 2")
    block = (min_words + 1) // 2
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    log2 = bits.width(size / bytes_per_word / block, bits_per_block, most_bits)

    def blocks(batch: pa.RecordBatch) -> np.ndarray:
        parts = [rolling(h, block)[::block] for _, h in _rows(batch.column(0))]
        return np.concatenate(parts) if parts else np.zeros(0, U64)

    index = bits.build(source.select("text"), blocks, log2, HASHES)
    shared = source.sparkSession.sparkContext.broadcast(index)
    long, integer = T.LongType(), T.IntegerType()
    shape = T.StructType([*(T.StructField(c, long) for c in ("m", "c1", "c2")), T.StructField("id", kind), T.StructField("version", long), T.StructField("at", integer), T.StructField("n", long), T.StructField("hs", T.BinaryType()), T.StructField("length", integer), T.StructField("back", integer)])
    found = cut(source.select("id", "text", F.xxhash64("text").alias("version")).mapInArrow(lambda batches: _candidates(shared.value, log2, min_words, block)(batches), shape))
    solved = T.StructType([*(T.StructField(c, long) for c in ("c1", "c2")), *(T.StructField(c, integer) for c in ("off", "length")), T.StructField("first_id", kind), T.StructField("first_version", long), T.StructField("first_at", integer)])
    pieces = found.where("hs is not null").repartition("m").sortWithinPartitions("m").mapInArrow(_resolve, solved)
    columns = ["id", "version", "at", "length", "first_id", "first_version", "first_at"]
    placed = found.where("length is null").select("c1", "c2", "id", "version", "at").join(pieces, ["c1", "c2"]).withColumn("at", F.col("at") + F.col("off"))
    copies = placed.where("not (id <=> first_id and version = first_version and at = first_at)").select(*columns)
    within = found.where("length is not null").select("id", "version", "at", "length", F.col("id").alias("first_id"), F.col("version").alias("first_version"), F.col("back").alias("first_at"))
    # the shuffle by document serves both repeated rows and the window
    each = copies.union(within).repartition("id", "version").dropDuplicates(["id", "version", "at"])
    before = lambda c: F.lag(c).over(Window.partitionBy("id", "version").orderBy("at"))
    follows = (before(F.col("at") + F.col("length")) == F.col("at")) & (before(F.col("first_at") + F.col("length")) == F.col("first_at")) & before("first_id").eqNullSafe(F.col("first_id")) & (before("first_version") == F.col("first_version"))
    numbered = each.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("span", F.sum("new").over(Window.partitionBy("id", "version").orderBy("at")))
    joined = numbered.groupBy("id", "version", "span", "first_id", "first_version").agg(F.min("at").alias("start"), F.max(F.col("at") + F.col("length") - 1 + min_words).alias("stop"), F.min("first_at").alias("first_at"))
    spans = cut(joined.select("id", "start", (F.col("stop") - F.col("start")).alias("words"), "first_id", "first_version", "first_at"))
    firsts = spans.select("first_id", "first_version", "first_at", "words").distinct()
    rows = spans.select("id", "start", "words", "first_id", "first_at").union(firsts.select("first_id", "first_at", "words", "first_id", "first_at"))
    wide = lambda c, name: c.cast("bigint").alias(name)
    return rows.select(F.col("id").alias(id_col), wide(F.col("start"), "start_word"), wide(F.col("start") + F.col("words"), "end_word"), wide(F.col("words"), "n_words"), F.col("first_id").alias("first_doc_id"), wide(F.col("first_at"), "first_word"))


def oracle(min_words: int = MIN_WORDS) -> str:
    """Every run of ``min_words`` words as a string, with its first place; runs that follow on here and there are joined. DuckDB SQL."""
    return f"""
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\v\\f\\r]+'), lambda x: x != '') AS w FROM documents),
runs AS (SELECT doc_id, i - 1 AS place, array_to_string(w[i:i + {min_words - 1}], ' ') AS run FROM words, LATERAL (SELECT unnest(range(1, len(w) - {min_words - 2})) AS i) u),
known AS (SELECT run, min((doc_id, place)) AS first FROM runs GROUP BY run HAVING count(*) > 1),
seen AS (SELECT doc_id, place, first, lag(place) OVER (PARTITION BY run, doc_id ORDER BY place) AS back FROM runs JOIN known USING (run)),
copied AS (SELECT doc_id, place, CASE WHEN back IS NULL THEN first[1] ELSE doc_id END AS first_doc, coalesce(back, first[2]) AS first_place FROM seen WHERE back IS NOT NULL OR first[1] != doc_id OR first[2] != place),
marked AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id, first_doc, first_place - place ORDER BY place) AS span FROM copied),
spans AS (SELECT doc_id, min(place) AS start_word, max(place) + {min_words} - min(place) AS n_words, first_doc, min(first_place) AS first_word FROM marked GROUP BY doc_id, first_doc, first_place - place, span),
rows AS (SELECT * FROM spans UNION ALL SELECT DISTINCT first_doc, first_word, n_words, first_doc, first_word FROM spans)
SELECT doc_id, start_word, start_word + n_words AS end_word, n_words, first_doc AS first_doc_id, first_word FROM rows"""
