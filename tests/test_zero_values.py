"""Queries on events against their SQL where values are zero, alone, in runs and at the ends: division by zero is that of IEEE 754."""

import random
from datetime import datetime, timedelta

import pytest
from test_oracles import rows

from tidemark.plans import catalog

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    rng, folder, made = random.Random(5), tmp_path_factory.mktemp("zeros"), []
    for k in range(2600):
        zero = k in (0, 1, 2599) or 700 <= k < 712 or rng.random() < 0.01
        value = 0.0 if zero else round(rng.choice([100, 100, 100, 125]) * rng.uniform(0.995, 1.005), 2)
        made.append((k, datetime(2024, 1, 1) + timedelta(seconds=37 * k), 1, rng.choice("ab"), value, "{}"))
    kinds = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(made, kinds).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["event_excursions", "event_lag_features", "event_indicators", "event_robust_extremes"])
def test_zeros_like_sql(spark, events, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{events}/events.parquet/*.parquet'")
    got, want = catalog.queries()[name](spark, events), con.sql(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(map(tuple, got.select(*columns).collect())) == rows(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())
