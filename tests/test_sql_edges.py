"""Queries against their SQL, value by value, on events that the small tables don't have."""

import datetime
import math

import duckdb
import pytest

from boxquery.plans import registry


@pytest.fixture
def compared(spark, tmp_path):
    """Rows of a query and of its SQL over events (event_id, user_id, event_type, value)."""

    def run(name, events):
        rows = [(i, datetime.datetime(2024, 1, 1), u, kind, float(v), "{}") for i, u, kind, v in events]
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
        duck = duckdb.connect()
        duck.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        got, want = registry.QUERIES[name](spark, str(tmp_path)), duck.sql(registry.ORACLE_SQL[name])
        clean = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
        by_name = lambda names, r: tuple(clean(v) for _, v in sorted(zip(names, r, strict=True)))
        return sorted(by_name(got.columns, r) for r in got.collect()), sorted(by_name(want.columns, r) for r in want.fetchall())

    return run


@pytest.mark.parametrize("name", ["e15_metric_sweep", "e16_best_of_metrics"])
def test_floor_that_only_scores_beyond_one_pass(compared, name):
    got, want = compared(name, [(1, 1, "error", 100), (2, 1, "error", 300), (3, 2, "click", 620), (4, 2, "view", 505)])
    assert got == want


def test_floor_of_the_first_source(compared):
    got, want = compared("f01_score_floor", [(3, 1, "error", 125), (4, 1, "error", 125), (5, 1, "view", 124), (6, 1, "view", 126)])
    assert got == want == [(4,), (6,)]


@pytest.mark.parametrize("name", ["g08_ensemble_borda", "g04_g06_ensemble_vote"])
def test_clusters_without_weight(compared, name):
    got, want = compared(name, [(1, 1, "error", 0), (2, 2, "error", 70), (3, 2, "click", 0), (99, 2, "click", 0)])
    assert got == want and any("nan" in r for r in got)


def test_doubles_are_rounded_as_in_sql(spark):
    values = [31.631249999999998, 32.44875, 0.5, -0.00005, 1e-9, 123456.78905, float("nan"), float("inf")]
    got = [r.v for r in registry.rounded(spark.createDataFrame([(v,) for v in values], "v double"), "v", places=4).collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 4)", [v]).fetchone()[0] for v in values]
    assert list(map(repr, got)) == list(map(repr, want)) and got[0] == 31.6313
