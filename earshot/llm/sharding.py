"""Hierarchical weighted hash tree: each row descends region, rack and shard by weighted hash draws."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("region", "rack", "shard")
#: A node is (weight, children); a leaf is its weight. Four regions of uneven capacity, 3 to 4 racks each, 4 shards a rack.
PRODUCTION_TREE: dict = {
    "north": (4.0, {f"n{i}": (w, {f"n{i}s{j}": v for j, v in enumerate((1.0, 1.0, 1.0, 2.0))}) for i, w in enumerate((1.0, 1.0, 2.0, 2.0))}),
    "south": (3.0, {f"s{i}": (w, {f"s{i}s{j}": 1.0 for j in range(4)}) for i, w in enumerate((1.0, 1.0, 1.0))}),
    "east": (2.0, {f"e{i}": (w, {f"e{i}s{j}": v for j, v in enumerate((2.0, 1.0, 1.0, 1.0))}) for i, w in enumerate((1.0, 3.0, 1.0))}),
    "west": (1.0, {f"w{i}": (w, {f"w{i}s{j}": 1.0 for j in range(4)}) for i, w in enumerate((1.0, 1.0, 1.0))}),
}
NULL_KEY = "<null>"


def _weight(node: object) -> float:
    return float(node[0] if isinstance(node, (tuple, list)) else node)


def children(tree: Mapping, depth: int = 3) -> dict[str, list[tuple[str, float]]]:
    """The positive-weight children of each inner node, by its path ("" is the root, "north/n0" a rack)."""
    out: dict[str, list[tuple[str, float]]] = {}

    def walk(path: str, nodes: Mapping, left: int) -> None:
        out[path] = [(name, _weight(x)) for name, x in sorted(nodes.items()) if _weight(x) > 0]
        if any(not math.isfinite(_weight(x)) or _weight(x) < 0 for x in nodes.values()):
            raise ValueError(f"a weight below {path or 'the root'} is negative or not finite")
        if any("/" in name or "|" in name for name in nodes):
            raise ValueError("a node's name holds / or |")
        if not out[path]:
            raise ValueError(f"{path or 'the root'} has no child of positive weight")
        if left > 1:
            for name, x in nodes.items():
                if _weight(x) > 0:
                    walk(f"{path}/{name}".lstrip("/"), x[1], left - 1)

    walk("", tree, depth)
    return out


def _draw(key: Column, path: Column, child: Column, weight: Column, seed: int) -> Column:
    """An exponential variate of rate ``weight``, fixed by seed, path, child and key: the child with the least one is drawn in proportion to the weights."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), path, child, key))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def _scored(key: Column, path: Column, weights: Column, seed: int):
    return lambda n, i: F.struct(_draw(key, path, n, F.get(weights, i), seed).alias("s"), n.alias("n"))


def shard(docs: DataFrame, tree: Mapping = PRODUCTION_TREE, key: str = "doc_id", seed: int = 0, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Add one column for each of ``levels`` with the node that each row falls to.

    At each level a row draws for each child an exponential variate from the hash of its key and of the child's path, at the
    child's weight as rate, and goes to the least. A child's draw doesn't depend on its siblings, so a changed weight moves
    rows only into or out of that child, and, as a node's weight is its own and not the sum of what lies below, no row moves
    outside the subtree whose root is the parent of the changed node. It is one projection: no shuffle, no state, any size.

    A null key counts as the key "<null>"; rows of equal keys go to one shard; other columns are kept, and an input column
    that is named like a level is replaced. An empty input gives an empty result. Nodes of weight 0 get nothing. Negative or
    non-finite weights, and nodes without a child of positive weight, raise ValueError.
    """
    below = children(tree, len(levels))
    keyed = docs.drop(*levels)
    name = F.coalesce(F.col(key).cast("string"), F.lit(NULL_KEY))
    at: dict[int, list[str]] = {d: [p for p in below if (p.count("/") + 1 if p else 0) == d] for d in range(len(levels))}
    path: Column = F.lit("")
    for depth, level in enumerate(levels):
        array = lambda xs: F.array(*[F.lit(x) for x in xs])
        names = F.create_map(*[c for p in at[depth] for c in (F.lit(p), array(n for n, _ in below[p]))])[path]
        weights = F.create_map(*[c for p in at[depth] for c in (F.lit(p), array(w for _, w in below[p]))])[path]
        keyed = keyed.withColumn(level, F.array_min(F.transform(names, _scored(name, path, weights, seed)))["n"])
        path = F.col(level) if depth == 0 else F.concat_ws("/", path, F.col(level))
    return keyed


def balance(placed: DataFrame, tree: Mapping = PRODUCTION_TREE, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Rows and expected share of each leaf, for a report: a row for each leaf of positive weight, with 0 rows where none fell.

    Rows with a null level are in no leaf and don't count; other columns are left out; an empty input gives all leaves with 0.
    """
    below, share = children(tree, len(levels)), []

    def walk(path: str, p: float, depth: int) -> None:
        total = sum(w for _, w in below[path])
        for n, w in below[path]:
            full = f"{path}/{n}".lstrip("/")
            if depth == len(levels) - 1:
                share.append((*full.split("/"), p * w / total))
            else:
                walk(full, p * w / total, depth + 1)

    walk("", 1.0, 0)
    spark = placed.sparkSession
    expected = spark.createDataFrame(share, ", ".join(f"{x} string" for x in levels) + ", expected_share double")
    return expected.join(placed.groupBy(*levels).agg(F.count("*").alias("n_rows")), [*levels], "left").fillna(0, ["n_rows"])


def oracle(tree: Mapping = PRODUCTION_TREE, table: str = "documents", key: str = "doc_id", seed: int = 0, levels: Sequence[str] = LEVELS, keep: str | None = None) -> str:
    """The same placement in DuckDB SQL: candidates by join with the children's list, least draw by arg_min."""
    below = children(tree, len(levels))
    rows = ", ".join(f"('{p}', '{n}', {w!r}::DOUBLE)" for p, xs in below.items() for n, w in xs)
    draw = f"-ln((('0x' || substr(md5('{seed}|' || p.path || '|' || c.child || '|' || p.k), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / c.weight"
    parts = [f"tree(path, child, weight) AS (VALUES {rows})", f"l0 AS (SELECT DISTINCT coalesce({key}::VARCHAR, '{NULL_KEY}') AS k, '' AS path FROM {table})"]
    for d in range(len(levels)):
        parts.append(f"l{d + 1} AS (SELECT p.k, CASE WHEN p.path = '' THEN '' ELSE p.path || '/' END || arg_min(c.child, {draw}) AS path FROM l{d} p JOIN tree c ON c.path = p.path GROUP BY p.k, p.path)")
    cols = ", ".join(f"split_part(l.path, '/', {i + 1}) AS {name}" for i, name in enumerate(levels))
    return f"WITH {', '.join(parts)} SELECT {keep or 'd.' + key}, {cols} FROM {table} d JOIN l{len(levels)} l ON l.k = coalesce(d.{key}::VARCHAR, '{NULL_KEY}')"
