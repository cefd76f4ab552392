from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from earshot.plans.queries import QUERIES, SQLS

ROOT = Path(__file__).resolve().parents[1]
SF = Path("/root/testdata/sf0.001")


def test_registry():
    assert set(SQLS) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries()) and len(QUERIES) >= 90


@pytest.mark.skipif(not SF.exists(), reason="no tables")
@pytest.mark.parametrize("name", ["metrics_by_child", "subtract_others", "conversation_summary", "krippendorff_alpha", "metrics_by_period", "periodic_session"])
def test_queries_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from verify import TABLES, rows

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, str(SF)).toPandas(), con.execute(SQLS[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.skipif(not SF.exists(), reason="no tables")
@pytest.mark.parametrize("name", ["collapse_timeline", "derived_set", "lp_cp_n"])
def test_segments_without_length_against_sql(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    from verify import rows

    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 5 < 2 THEN 0.0 ELSE value END AS value, CASE WHEN event_id % 7 = 0 THEN date_trunc('day', ts) ELSE ts END AS ts) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.execute(SQLS[name]).df())


@pytest.mark.skipif(not SF.exists(), reason="no tables")
def test_templates_and_whitelist_of_whole_tables(spark):
    from conftest import values

    from earshot.plans import adapter

    seg = {tuple(r) for r in adapter.segments(spark, str(SF)).select("recording_filename", "segment_onset", "segment_offset").collect()}
    got = values(QUERIES["annotation_templates"](spark, str(SF)), "recording_filename", "code_onset", "code_offset")
    assert len(got) == len(seg) and set(got) == seg
    ordered = {f"rec{r[0]}" for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey").collect()}
    assert values(QUERIES["recordings_whitelist"](spark, str(SF)), "recording_filename") == sorted((r,) for r in ordered & {s[0] for s in seg})


def test_entry_works_without_the_optional_parts(tmp_path):
    import shutil

    shutil.copytree(ROOT / "earshot", tmp_path / "earshot", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'metrics_by_child' in e.queries() and 'pipeline' not in e.queries() and not any(n.startswith('op') for n in e.oracle_sql())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)
