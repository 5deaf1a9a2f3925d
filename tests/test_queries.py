"""A cross-section of the registered queries against their SQL; tools/verify.py runs all of them."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.verify import TABLES, compare
from workload.inputs import REGISTRY

SF = "/root/testdata/sf0.01"
SAMPLE = ["daily_window_labels", "window_meta", "flow_positions_long_source", "cleaned_flows_drop", "deduplication_report",
          "encoded_categories", "balanced_split_points", "stratified_sample", "attack_episodes", "window_stats_all",
          "spectrum_amplitude", "hybrid_decomposition", "autocorrelation", "distribution_distances", "spectral_drift",
          "mmd_given_gamma", "frequency_score", "rank_fusion", "best_f1_grid", "branch_metrics", "attack_recall"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    res = duck.execute(entry.oracle_sql()[name])
    assert compare(df.columns, df.collect(), [d[0] for d in res.description], res.fetchall()) is None


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r["normal_windows"] + r["abnormal_windows"] > 0 for r in rows)


def test_registry_is_well_formed():
    names = [q.name for q in REGISTRY]
    assert len(names) == len(set(names)) and set(entry.oracle_sql()) <= set(entry.queries())
