"""Order statistics by counts over bits against sorted values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import selection

INF, NAN = float("inf"), float("nan")
ODD = [0.0, -0.0, 1.0, -1.0, 2.0**-1074, -(2.0**-1074), 2.0**-1022, math.nextafter(2.0**-1022, 0), 2.0**1023, math.nextafter(INF, 0), -math.nextafter(INF, 0), INF, -INF,
       math.nextafter(1.0, 0), math.nextafter(1.0, 2), math.nextafter(8.0, 0), 8.0, math.pi, 1e-300, 123456789.123]


def test_bits_round_trip_and_order(spark):
    rng = random.Random(4)
    values = ODD + [rng.uniform(-1, 1) * 10.0 ** rng.randint(-320, 308) for _ in range(3000)] + [math.ldexp(1.0, k) * s for k in range(-1074, 1024, 7) for s in (1, -1)]
    values += [math.nextafter(math.ldexp(1.0, k), 0) for k in range(-1060, 1024, 5)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", selection.ordered_bits(F.col("v")).alias("b")).withColumn("back", selection.from_bits(F.col("b")))
    rows = df.collect()
    assert all(r.back == r.v for r in rows)
    order = sorted({(r.v + 0.0, r.b) for r in rows})
    assert all((a[0] < b[0]) == (a[1] < b[1]) and a[1] != b[1] for a, b in zip(order, order[1:], strict=False))
    assert df.where("b is null").count() == 0


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(6)
    rows = [("wide", v) for v in ODD for _ in range(3)] + [("hot", round(rng.gauss(0, 1), 2)) for _ in range(5000)] + [("hot", 0.25)] * 3000
    rows += [(None, float(k)) for k in range(7)] + [("one", 4.5), ("none", None), ("hot", None)] + [("close", 1 + k * 2.0**-52) for k in range(100)]
    return spark.createDataFrame(rows, "g string, v double").repartition(6).cache(), rows


def quantile(values, share):
    v = sorted(values)
    place = share * (len(v) - 1)
    low, high = math.floor(place), math.ceil(place)
    return v[low] if low == high else (high - place) * v[low] + (place - low) * v[high]


def test_quantiles(table):
    df, rows = table
    shares = [0.0, 0.05, 1 / 3, 0.5, 0.9, 1.0]
    got = {(r.g, r.share): (r.n, r.value) for r in selection.exact_quantiles(df, ["g"], "v", shares).collect()}
    groups = {g: [v for h, v in rows if h == g and v is not None] for g in {g for g, _ in rows}}
    want = {(g, s): (len(v), quantile(v, s)) for g, v in groups.items() if v for s in shares}
    assert got.keys() == want.keys()
    for k, (n, v) in want.items():
        assert got[k][0] == n and (got[k][1] == v or math.isnan(v) and math.isnan(got[k][1])), k


def test_equals_percentile(table):
    df, _ = table
    some = df.where("g in ('hot', 'close')")
    want = {r.g: r.p for r in some.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.77))).alias("p")).collect()}
    got = selection.exact_quantiles(some, ["g"], "v", [0.1, 0.77]).collect()
    assert all(r.value == pytest.approx(want[r.g][0 if r.share < 0.5 else 1], rel=1e-15) for r in got) and len(got) == 4


def test_conformal_place(table):
    df, rows = table
    got = {r.g: (r.n, r.value) for r in selection.conformal_places(df.where("g = 'hot' or g = 'one' or g is null"), ["g"], "v", 0.9).collect()}
    for g in ("hot", "one", None):
        v = sorted(x for h, x in rows if h == g and x is not None)
        assert got[g] == (len(v), v[min(math.ceil((len(v) + 1) * 0.9), len(v)) - 1])


def test_nan_is_last_and_empty(spark):
    df = spark.createDataFrame([(NAN,), (INF,), (1.0,), (NAN,)], "v double").withColumn("g", F.lit("x"))
    got = {r.share: r.value for r in selection.exact_quantiles(df, ["g"], "v", [0.0, 1 / 3, 1.0]).collect()}
    assert got[0.0] == 1.0 and got[1 / 3] == INF and math.isnan(got[1.0])
    assert selection.exact_quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0
