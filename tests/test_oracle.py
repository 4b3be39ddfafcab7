"""A query of each family against its SQL in DuckDB."""

import math

import duckdb
import pandas as pd
import pytest

from tracelake.plans import catalog
from tracelake.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"
NAMES = (
    "p8_bool", "p15_j10_log_context", "j3_compare_periods", "a6_rank_percentiles", "a11_empty_buckets", "a18_significant_terms", "w7_islands", "n2_bottlenecks", "g1_dependency_edges", "g4_service_rollup", "g9_critical_path",
    "g22_g23_error_chains", "g45_closeness", "g49_components", "r3_fill_missing", "r4_w14_ema", "r15_forecast", "h3_divergences", "x1b_mad", "x14_span_anomalies", "t1_template_a", "t14_rules", "b7_violations", "c1_c2_c4_canary", "k1_k2_regressions",
    "q1_q5_retry_storms", "v1_v2_cost", "y1_y2_pipeline_health", "d1_d2_dependency_health", "m1_system_health", "st3_tumbling", "st1_st2_drift", "st3_live_percentiles",
    "z1_failure_patterns", "z3_warning_signals", "z4_predictions", "f3_pattern_matches", "m1_health_summary", "q5_retry_impact", "c4_score_parts", "i3_operations", "i7_anomalies", "d1_d2_transitive_risks", "v6_cost_trend", "q4_retry_root_causes", "l3_field_pairs", "cp29_nested_fields", "x3_density_noise", "e1_hash_embedding", "s1_scan_spans", "a13_auto_histogram",
)


def rows(df: pd.DataFrame) -> list[str]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        if hasattr(v, "tolist") and not isinstance(v, pd.Timestamp):
            v = v.tolist()
        if isinstance(v, list):
            return tuple(map(plain, v))
        return float(v) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(str(tuple(plain(v) for v in r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == rows(duck.execute(catalog.oracle_sql()[name]).fetchdf())


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert len(catalog.queries()) > 150
