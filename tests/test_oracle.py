"""Registered queries against their SQL. A spread of queries by default, all with AISLEFLOW_ALL=1."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from aisleflow.plans.registry import ORACLES, QUERIES

SF = os.environ.get("AISLEFLOW_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "order_gap_days", "top_return_reason", "return_rate_by_size", "divide_rules", "date_normalisation", "iqr_outlier_report", "forecast_contract", "daily_funnel_table",
    "promo_phase_calendar", "projected_promotions", "calendar_columns", "expanding_quantiles", "level_hierarchy", "inventory_asof_per_unit", "stock_scenarios_updating",
    "seasonal_reference_block", "spike_strength_features", "traffic_scenarios", "spike_classifier_metrics", "ensemble_best_weights", "scaling_config_picks", "blend_risk_table",
    "walk_forward_scale", "recursive_panel_forecast", "adaptive_spike_blend", "final_forecast", "return_flag_auc", "boosted_rounds", "boosted_forecast", "huber_forecast", "pinball_forecast",
    "pinball_coverage", "spike_probabilities",
]
NAMES = sorted(QUERIES) if os.environ.get("AISLEFLOW_ALL") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def tidy(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].astype(float)
        elif df[c].dtype.kind not in "ib":
            df[c] = [None if v is None or v is pd.NaT or v != v else (str(v)[:10] if hasattr(v, "isoformat") else str(v)) for v in df[c]]
    keys = sorted(df.columns, key=lambda c: df[c].dtype.kind == "f")
    return df.sort_values(keys, na_position="first", key=lambda s: s.round(3) if s.dtype.kind == "f" else s.astype(str)).reset_index(drop=True)


def test_every_query_is_a_pair():
    assert set(ORACLES) <= set(QUERIES)
    assert len(set(QUERIES) - set(ORACLES)) <= 5
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    got = tidy(QUERIES[name](spark, SF).toPandas())
    if name not in ORACLES:
        return
    want = tidy(duck.execute(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind == "f" or want[c].dtype.kind == "f":
            pd.testing.assert_series_equal(got[c].astype(float), want[c].astype(float), check_exact=False, rtol=1e-9, atol=1e-9)
        else:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist()
