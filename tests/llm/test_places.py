from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from conftest import values
from pyspark.sql import functions as F

from earshot.llm.places import PLACE, Placed, _file_system, _Lists


def without(df, condition, parts=3):
    """``df`` without the rows of a condition, by their places."""

    def drop(batch, at, _):
        keep = np.ones(batch.num_rows, bool)
        keep[at] = False
        return batch.filter(pa.array(keep))

    placed = Placed(df)
    gone = placed.df.where(condition(placed)).select(*PLACE)
    return placed.apply(gone, parts, drop, df.schema), placed


@pytest.fixture
def files(spark, tmp_path):
    rows = [(i, f"t{i}", i % 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n int").repartition(5)
    df.write.option("parquet.block.size", 4096).option("parquet.page.size", 512).parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


@pytest.mark.parametrize("parts", [1, 4, 300])
def test_rows_are_found_by_their_places(files, parts, spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got, placed = without(files, lambda p: p.col("doc_id") % 3 == 0, parts)
        assert placed.df.select(*PLACE).distinct().count() == 3000
        assert values(got, "doc_id") == [(i,) for i in range(3000) if i % 3]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_filters_and_projections_keep_places(files):
    some = files.where("n > 2").select("text", F.col("doc_id").alias("N"))
    got, _ = without(some, lambda p: p.col("n") > 1000)
    assert got.columns == ["text", "N"] and {r["N"] for r in got.collect()} == {i for i in range(1001) if i % 7 > 2}


def test_tables_without_places_are_written_first(files, spark, tmp_path):
    files.write.json(str(tmp_path / "j"))
    twice = files.where("doc_id < 4").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    for df, n in ((spark.read.json(str(tmp_path / "j")), 3000), (twice, 8), (files.union(files), 6000), (files.join(files.select("doc_id"), "doc_id"), 3000), (files.withColumn("_metadata", F.lit("own")), 3000)):
        placed = Placed(df)
        assert placed.df.select(*PLACE).distinct().count() == n
    got, _ = without(twice, lambda p: (p.col("doc_id") == 1) & (p.col("copy") == 2))
    assert values(got, "doc_id", "copy") == [(0, 1), (0, 2), (1, 1), (2, 1), (2, 2), (3, 1), (3, 2)]


def test_empty_tables_and_lists(files):
    assert without(files.where("false"), lambda p: F.lit(True))[0].count() == 0
    assert without(files, lambda p: F.lit(False))[0].count() == 3000


def test_values_come_with_their_rows(files):
    placed = Placed(files)
    lists = placed.df.where(placed.col("doc_id") < 10).select(*PLACE, (placed.col("doc_id") * 2).alias("twice"))

    def change(batch, at, found):
        out = np.zeros(batch.num_rows, np.int64)
        if len(at):
            out[at] = found.to_numpy()
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out.astype(np.int32))], names=batch.schema.names)

    got = values(placed.apply(lists, 2, change, files.schema), "doc_id", "n")
    assert got == [(i, 2 * i if i < 10 else 0) for i in range(3000)]


def test_folders_of_any_file_system(tmp_path):
    for uri in (f"file:{tmp_path}", f"file://{tmp_path}", str(tmp_path)):
        fs, path = _file_system(uri)
        assert path == str(tmp_path) and fs.type_name == "local"
    assert _Lists(str(tmp_path)).find(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))[1] is None
