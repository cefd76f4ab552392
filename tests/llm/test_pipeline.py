from __future__ import annotations

import random

import pytest
from conftest import values
from llm.conftest import CLASHING, DOCS, words
from llm.test_decontaminate import brute
from llm.test_langid import text

import corpus_pipeline
from earshot.llm import queries, sharding


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "source_mixing", "sharding"] and corpus_pipeline.ORACLE_SQL is None
    assert len(queries.queries()) == 10 and [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]


def write(spark, path, rows, items):
    spark.createDataFrame(rows, DOCS + "".join(f", `{c}` string" for c in CLASHING)).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_each_stage_works_on_what_is_left(spark, tmp_path):
    rng = random.Random(3)
    extra = ["x"] * len(CLASHING)
    item = " ".join("q" + w for w in words(rng, 30))
    texts = {i: text(rng, "xx", 80) if i % 2 else text(rng, "yy", 80) for i in range(60)}
    texts |= {60: texts[7], 61: texts[7] + " more", 62: f"{text(rng, 'xx', 20)} {item} {text(rng, 'xx', 20)}", 63: None, 64: "  ", 65: texts[8]}
    rows = [(i, t, "xx" if i % 2 else "yy", "ab"[i % 3 == 0], None, *extra) for i, t in texts.items()]
    sf = write(spark, tmp_path / "in", rows, [(1, item), (2, None)])
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, sf)
        assert name == "sharding" or out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = values(docs, "doc_id")
    assert {63, 64}.isdisjoint(r[0] for r in seen["language_id"]) and len(seen["language_id"]) >= 62
    left = {r[0] for r in seen["near_dedup"]}
    assert left == {r[0] for r in seen["language_id"]} - {60, 61, 65}
    leaks = {r[0] for r in brute([(i, texts[i]) for i in left], [(1, item)])}
    assert leaks == {62} and {r[0] for r in seen["decontamination"]} == left - leaks
    assert abs(len(seen["source_mixing"]) - len(seen["decontamination"])) <= 1
    assert seen["sharding"] == seen["source_mixing"]
    ran = corpus_pipeline.run(spark, sf)
    assert set(ran.columns) == {*docs.columns} and values(ran, "doc_id", *sharding.LEVELS) == values(docs, "doc_id", *sharding.LEVELS)


def test_empty_tables(spark, tmp_path):
    sf = write(spark, tmp_path / "in", [(1, "x", "en", "s", 1, *["x"] * len(CLASHING))][:0], [])
    assert corpus_pipeline.run(spark, sf).count() == 0


@pytest.mark.parametrize("name", ["op1_sharding", "op3_line_dedup", "op5_substring_dedup", "op7_decontamination"])
def test_queries_against_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    from verify import rows

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
