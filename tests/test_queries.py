"""Every query with SQL against DuckDB, on the smallest tables; plans are looked at where they matter."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tallyloom.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, (float, np.floating)) and np.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.integer, np.floating)):
        return float(v)
    return v


def rows(df):
    return sorted(map(repr, zip(*([plain(v) for v in df[c].astype(object)] for c in sorted(df.columns)))))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, DIR).toPandas(), duck.execute(catalogue.ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DIR).count() > 0


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned_and_rate_joins_are_hashed(spark):
    assert "props" not in plan(catalogue.QUERIES["w05_session_active_seconds"](spark, DIR))
    assert "text" not in plan(catalogue.QUERIES["a05_session_aggregate"](spark, DIR)).split("ReadSchema")[1].split(">")[0]
    assert "NestedLoop" not in plan(catalogue.QUERIES["j10_overlap_pairs"](spark, DIR)) and "Cartesian" not in plan(catalogue.QUERIES["a15_window_180s"](spark, DIR))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_cut_texts_of_two_bytes_a_character(spark, tmp_path):
    texts = ["я" * 60, "я" * 20, "a" * 60, "a" * 25 + "я" * 25, "a" * 19 + "я" * 30, "a" * 20 + "я" * 30, "語" * 30, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalogue.ORACLE["p26_truncate_utf8"]).fetchdf()
    assert rows(catalogue.QUERIES["p26_truncate_utf8"](spark, str(tmp_path)).toPandas()) == rows(want)


@pytest.mark.parametrize("name,most", [("p06_token_events", 60), ("p10_event_ids", 60), ("a02_message_fold", 120), ("p04_transcript_tokens", 120), ("j01_rollout_edits", 110), ("j02_edit_results", 110), ("a04_rollout_tool_counts", 700)])
def test_fields_of_a_line_are_read_once(spark, name, most):
    optimized = catalogue.QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("get_json_object") <= most


@pytest.mark.parametrize("name", ["a04_rollout_tool_counts", "j01_rollout_edits"])
def test_lines_of_calls_and_outputs_are_read_and_dealt_once(spark, name):
    """Two scans, of the calls and of the outputs; whatever else is taken from them reads their shuffle again."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert plan(catalogue.QUERIES[name](spark, DIR)).count("FileScan") == 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
