"""Time the headline queries; prints one JSON line.

Every query is written to the no-op sink, so all rows and columns are computed. The first run of a
query (cold: planning, code generation) and the better of two further runs (warm) are reported.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "forecast_macro", "forecast_macro_simple", "scan_pruned_columns", "scan_json_map", "clean_category", "clean_numeric_text",
    "clean_clipped_predictions", "filter_min_group_size", "join_lookup_chain", "join_factor_lookup", "join_backfill_each",
    "join_fuzzy_names", "dedup_keep_first", "dedup_ranked", "dedup_collapse", "agg_sector_totals", "agg_intensity_ladder",
    "agg_validation_summary", "agg_coverage", "agg_median_hot_groups", "agg_ratio_quality", "window_lag_features", "window_row_numbers",
    "window_quantile_zone", "sort_top_k", "reshape_balanced_panel", "split_stratified", "split_grouped", "sample_city_quota",
    "prep_median_impute", "prep_target_encode", "model_group_mean", "model_ar1", "model_holt", "model_blend_grid", "learn_ols",
    "eval_all_metrics", "eval_stratified", "eval_log_suite", "eval_bootstrap_200", "incr_pending",
]


def run(fn, spark, sf):
    start = time.perf_counter()
    fn(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    from emipanel.session import get_session
    from workload import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session("bench", f"local[{cpus}]", cpus)
    spark.range(1000000).selectExpr("sum(id)").collect()
    cold, warm = {}, {}
    for name in HEADLINE:
        cold[name] = round(run(QUERIES[name], spark, sf), 3)
        warm[name] = round(min(run(QUERIES[name], spark, sf) for _ in range(2)), 3)
    print(json.dumps({"metric": "headline_queries_warm_total", "value": round(sum(warm.values()), 3), "unit": "sec",
                      "queries": warm, "cold": cold, "cold_total": round(sum(cold.values()), 3),
                      "sf": os.path.basename(sf.rstrip("/")), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
