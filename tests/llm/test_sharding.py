from __future__ import annotations

import copy
import math

import pytest
from conftest import values

from earshot.llm import sharding


def many(spark, n=20_000):
    return spark.range(n).withColumnRenamed("id", "doc_id")


def test_shares_follow_weights(spark):
    rows = sharding.balance(sharding.shard(many(spark))).collect()
    assert sum(r["n_rows"] for r in rows) == 20_000 and abs(sum(r["expected_share"] for r in rows) - 1) < 1e-9
    for r in rows:
        p = r["expected_share"]
        assert abs(r["n_rows"] - 20_000 * p) < 5 * math.sqrt(20_000 * p)


def test_movement_stays_in_the_changed_subtree(spark):
    tree = copy.deepcopy(sharding.PRODUCTION_TREE)
    weight, racks = tree["north"]
    racks["n0"] = (racks["n0"][0] * 3, racks["n0"][1])
    before = {r[0]: r[1:] for r in values(sharding.shard(many(spark)))}
    after = {r[0]: r[1:] for r in values(sharding.shard(many(spark), tree))}
    moved = {k for k in before if before[k] != after[k]}
    assert moved and all(before[k][0] == after[k][0] == "north" and after[k][1] == "n0" for k in moved)
    tree["south"] = (0.0, tree["south"][1])
    gone = {r[0]: r[1:] for r in values(sharding.shard(many(spark), tree))}
    assert all(gone[k] == after[k] for k in after if after[k][0] != "south") and not any(v[0] == "south" for v in gone.values())


def test_odd_rows_and_columns(odd, none):
    got = sharding.shard(odd.withColumn("rack", odd.n_chars))
    assert got.count() == odd.count() and got.where("region is null or rack is null or shard is null").count() == 0
    assert set(got.columns) == {*odd.columns, *sharding.LEVELS}
    assert got.where("doc_id is null").select("region", "rack", "shard").distinct().count() == 1
    assert got.where("doc_id = 7").select("shard").distinct().count() == 1
    assert sharding.shard(none).count() == 0


@pytest.mark.parametrize("tree", [{}, {"a": (1.0, {"b": (1.0, {})})}, {"a": (-1.0, {"b": (1.0, {"c": 1.0})})}, {"a/b": (1.0, {"b": (1.0, {"c": 1.0})})}, {"a": (float("nan"), {"b": (1.0, {"c": 1.0})})}])
def test_bad_trees(spark, tree):
    with pytest.raises(ValueError):
        sharding.shard(many(spark, 1), tree)
