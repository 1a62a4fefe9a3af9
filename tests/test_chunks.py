"""Series by chunks against whole series."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.recursive import Difference, averaged, averaged_in_chunks, span, wilder
from tidemark.operators import audit, chunks, features, indicators


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(3)
    rows = [(name, k, round(rng.uniform(1, 9), 2)) for name, n in (("a", 403), ("b", 64), ("c", 1)) for k in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "series_id string, row long, value double").withColumn("date", F.expr("date_add(date'2020-01-01', int(row))")).cache()


def same(a, b):
    if a is None or b is None or isinstance(a, (bool, str)):
        return a == b
    return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) if isinstance(a, float) else a == b


def assert_same(got, want):
    columns = sorted(want.columns)
    a, b = (sorted(df.select("series_id", "row", *columns).collect(), key=lambda r: (r.series_id, r.row)) for df in (got, want))
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(same(x[c], y[c]) for c in columns), (x, y)


@pytest.mark.parametrize("rows", [7, 64, 1000])
def test_averages_by_chunk(series, rows):
    """Nulls at the beginning, in between, at chunk ends and over whole chunks."""
    gaps = series.withColumn("x", F.when((F.col("row") % 11 > 2) & ~F.col("row").between(20, 45) & (F.col("row") > 4), F.col("value")))
    columns = [span("fast", "x", 3), span("slow", "x", 9), wilder("own", "value", 5), Difference("gap", "fast", "slow"), span("signal", "gap", 4), span("again", "signal", 2)]
    assert_same(averaged_in_chunks(gaps, columns, rows), averaged(gaps, columns))


def test_all_null_series_and_empty_table(series):
    none = series.withColumn("x", F.lit(None).cast("double"))
    assert averaged_in_chunks(none, [span("e", "x", 3)], 5).where("e is not null").count() == 0
    assert averaged_in_chunks(none.limit(0), [span("e", "x", 3)], 5).count() == 0


@pytest.mark.parametrize("rows", [100, 128, 1000])
def test_indicators_by_chunk(series, rows):
    assert_same(indicators.with_long_indicators(series, rows), indicators.with_indicators(series))


@pytest.mark.parametrize("rows", [60, 61, 500])
def test_features_and_targets_by_chunk(series, rows):
    make = lambda s: features.with_targets(features.with_features(s), 7)
    assert_same(chunks.in_chunks(series, make, features.DRIFT, 7, rows), make(series))


def test_excursions_by_chunk(spark):
    rows = [("s", k, 100.0 * (1.2 if k % 17 in (3, 4) else 1.0)) for k in range(200)]
    s = spark.createDataFrame(rows, "series_id string, row long, value double")
    assert_same(chunks.in_chunks(s, audit.with_excursions, 5, 5, 6), audit.with_excursions(s))


def test_window_wider_than_a_chunk(series):
    with pytest.raises(ValueError, match="reach"):
        chunks.in_chunks(series, features.with_features, 60, rows=10)


def test_long_position(spark):
    """Many ranges, a null series, null and equal order keys, and a series whose rows are all alike."""
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([None, *range(300)])) for _ in range(4000)] + [("same", 1)] * 1500
    df = spark.createDataFrame(rows, "series_id string, at int").repartition(9)
    got = chunks.with_long_position(df, "at").collect()
    for name in ("a", "b", None, "same"):
        own = sorted((r.row, r.at) for r in got if r.series_id == name)
        assert [p for p, _ in own] == list(range(sum(s == name for s, _ in rows)))
        assert [a for _, a in own] == sorted((a for s, a in rows if s == name), key=lambda a: (a is not None, a or 0))
    assert chunks.with_long_position(df.limit(0), "at").count() == 0


@pytest.mark.parametrize("spoil", [None, 0, 9, 10, 57, 99])
def test_rises(spark, spoil):
    """A fall inside a range, at its border, at the ends."""
    values = list(range(0, 200, 2))
    if spoil is not None:
        values[spoil] = values[spoil] + (3 if spoil < 99 else -5)
    df = spark.createDataFrame([("s", k, v) for k, v in enumerate(values)] + [("flat", k, 1) for k in range(30)], "series_id string, k int, v int").repartition(5)
    got = {r.series_id: r.rises for r in chunks.rises(df, "v", "k", F.expr("k div 10")).collect()}
    assert got == {"s": spoil is None, "flat": True}
