"""Registered queries against their SQL twins on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")

# One or two of each family; tools/check.py runs all of them.
SAMPLE = ["scan_csv_text", "scan_json_panel", "scan_climate_payload", "sink_upsert", "sink_manifest", "clean_numeric_text", "clean_category",
          "clean_currency", "clean_grid_location", "filter_min_group_size", "join_factor_lookup", "join_backfill_each", "join_fuzzy_names",
          "dedup_ranked", "dedup_collapse_hot_keys", "agg_validation_summary", "agg_median_hot_groups", "window_lag_features", "window_dense_ids",
          "reshape_balanced_panel", "split_stratified", "split_few_shot", "sample_city_quota", "prep_target_encode", "model_ar1", "model_blend_grid",
          "eval_all_metrics", "eval_stratified", "eval_paired_bootstrap", "incr_upsert", "panel_building",
          "panel_company_baseline", "panel_company_splits", "sink_audit_observed", "forecast_runs"]


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and set(SAMPLE) <= set(o) and len(q) > 180


@needs_data
def test_entry(spark):
    df = entry.entry(spark)
    assert "macro_r2" in df.columns and df.count() == 5


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())
