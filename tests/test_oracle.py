"""Registered queries beside their SQL on the smallest tables."""

import duckdb
import pytest

from check import TABLES, compare
from tests.conftest import FOLDER

from __spark_entry__ import entry, oracle_sql, queries

PICK = [
    "a19_load_wide", "b8_drop_rows_where", "c14_nearest_band", "c2_compare_results", "d1_pivot_mean", "d4_consensus_baseline", "d15_value_bands",
    "d16_drift_metrics", "d25_crosstab_margins", "d39_pearson_gappy", "d42_cross_corr", "d43_hist_mutual_info", "e2_centered_median_mad",
    "e6_time_rolling_mean", "e17_best_window", "e21_periods", "f1_top_k_tags", "i3_auto_clean", "i7_clean_anchored", "i9_deviation_inside",
    "i18_multi_signal_no_peer", "i19_apply_tag_controls", "j3_paths_to_target", "j7_corr_clusters", "l1_stream_daily_buckets",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", PICK)
def test_query(spark, con, name):
    text, _, ok = compare(spark, con, name, queries()[name], oracle_sql()[name], FOLDER)
    assert text.startswith("ok"), text


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
