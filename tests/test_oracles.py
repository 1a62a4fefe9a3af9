import math
from collections import Counter

import pytest

from tidemark.plans import catalog

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(tiny):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return c


def rows(tuples):
    return Counter(tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in t) for t in tuples)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, tiny, name):
    got, want = catalog.queries()[name](spark, tiny), con.sql(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(map(tuple, got.select(*columns).collect())) == rows(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_every_query_has_an_oracle_or_a_reason():
    fitted_or_random = {
        "strategy_search", "learned_search", "learned_holdout", "learned_importances", "path_model_scores", "selected_paths",
    }
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == fitted_or_random


def test_entry(spark, tiny):
    assert catalog.flagship(spark, tiny).count() == 3
