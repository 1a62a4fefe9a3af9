"""Streams: tables in versions (failures between years, replays, two writers), and averages under corrections."""

import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import averages, upsert, versions


def batch(spark, rows):
    return spark.createDataFrame([("s", date.fromisoformat(d), v, datetime(2024, 1, t)) for d, v, t in rows], upsert.SCHEMA)


def table_of(spark, table):
    return {str(r.date): r.value for r in upsert.read_table(spark, table).collect()}


OLD = [("2022-05-01", 1.0, 1), ("2023-12-31", 2.0, 1), ("2024-01-01", 3.0, 1)]
NEW = [("2023-12-31", 20.0, 2), ("2024-01-01", 30.0, 2), ("2025-01-01", 4.0, 2)]


def test_failure_between_years(spark, tmp_path, monkeypatch):
    """A batch of three years that dies after writing one of them leaves the old rows; replayed, it is there once."""
    table = f"file://{tmp_path}/t"
    upsert.upsert_batch(batch(spark, OLD), table, "a", 0)
    real = upsert.merged

    def dies(old, new):
        # Rows of one year in each task, and the task of the last year fails.
        m = real(old, new).repartitionByRange(3, "date")
        return m.withColumn("value", F.when(F.year("date") == 2025, F.raise_error(F.lit("lost"))).otherwise(F.col("value")))

    monkeypatch.setattr(upsert, "merged", dies)
    with pytest.raises(Exception, match="lost"):
        upsert.upsert_batch(batch(spark, NEW), table, "a", 1)
    assert table_of(spark, table) == {d: v for d, v, _ in OLD}
    monkeypatch.setattr(upsert, "merged", real)
    for _ in range(2):
        upsert.upsert_batch(batch(spark, NEW), table, "a", 1)
    assert table_of(spark, table) == {"2022-05-01": 1.0, "2023-12-31": 20.0, "2024-01-01": 30.0, "2025-01-01": 4.0}
    assert versions.current(spark, table).number == 2
    upsert.upsert_batch(batch(spark, OLD), table, "a", 0)  # an old batch of the stream again
    assert table_of(spark, table)["2024-01-01"] == 30.0


def test_failure_before_the_manifest(spark, tmp_path, monkeypatch):
    table = f"file://{tmp_path}/t"
    upsert.upsert_batch(batch(spark, OLD), table, "a", 0)
    with monkeypatch.context() as m:
        m.setattr(versions, "MANIFEST", "nonsense")
        with pytest.raises(Exception):
            upsert.upsert_batch(batch(spark, NEW), table, "a", 1)
    assert table_of(spark, table) == {d: v for d, v, _ in OLD}
    upsert.upsert_batch(batch(spark, NEW), table, "a", 1)
    assert table_of(spark, table)["2025-01-01"] == 4.0


def test_two_streams(spark, tmp_path, monkeypatch):
    """Another stream publishes while a batch is being written: the batch merges again into what that left."""
    table, real, done = f"file://{tmp_path}/t", upsert.merged, []
    upsert.upsert_batch(batch(spark, OLD), table, "a", 0)

    def slow(old, new):
        if not done:
            done.append(1)
            upsert.upsert_batch(batch(spark, [("2024-01-02", 9.0, 3)]), table, "b", 0)
        return real(old, new)

    monkeypatch.setattr(upsert, "merged", slow)
    upsert.upsert_batch(batch(spark, NEW), table, "a", 1)
    assert table_of(spark, table) == {"2022-05-01": 1.0, "2023-12-31": 20.0, "2024-01-01": 30.0, "2024-01-02": 9.0, "2025-01-01": 4.0}
    assert versions.current(spark, table).batches == {"a": 1, "b": 0}


def test_empty_batch_and_table(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    assert table_of(spark, table) == {}
    upsert.upsert_batch(batch(spark, []), table, "a", 0)
    assert table_of(spark, table) == {} and versions.current(spark, table).number == 0


def average_of(values, n):
    """Averages of all (day, value) at once."""
    out, average = {}, None
    for k, (day, v) in enumerate(sorted(values.items())):
        average = v if average is None else (1 - 2 / (n + 1)) * average + 2 / (n + 1) * v
        out[day] = (v, average if k + 1 >= n else None)
    return out


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", averages.PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_averages_under_corrections(rocks, tmp_path):
    """Late days, corrections and days out of reach, over restarts: what holds in the end is the average of all that was in reach."""
    spark, rng, begin = rocks, random.Random(2), date(2024, 1, 1)
    (tmp_path / "in").mkdir()
    known, refused = {"a": {}, "b": {}}, []

    def send(k, rows):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"series_id": s, "date": str(d), "value": v, "seen": f"2024-06-{k + 1:02d}T00:00:{i:02d}"}) for i, (s, d, v) in enumerate(rows)))
        stream = averages.running_average(spark.readStream.schema(upsert.SCHEMA).json(str(tmp_path / "in")), 3)
        out = stream.withColumn("batch", F.lit(k)).writeStream.format("parquet").option("path", str(tmp_path / f"out{k}")).option("checkpointLocation", str(tmp_path / "cp"))
        # Another output folder each time: the query's own log would keep the literal of its first run.
        out.trigger(availableNow=True).start().awaitTermination()

    newest = {"a": None, "b": None}
    for k in range(4):
        rows = []
        for s in known:
            for _ in range(9):
                rows.append((s, begin + timedelta(rng.randint(10 * k, 10 * k + 12)), float(rng.randint(1, 50))))
        if k == 3:
            rows.append(("a", begin, 999.0))
        for s in known:
            edge = newest[s] - timedelta(averages.BACK) if newest[s] else None
            settled = max((d for d in known[s] if edge and d <= edge), default=None)
            for name, d, v in rows:
                if name == s:
                    if settled and d <= settled:
                        refused.append((s, d, v))
                    else:
                        known[s][d] = v
            newest[s] = max(known[s])
        send(k, rows)
    sent = spark.read.option("recursiveFileLookup", "true").parquet(*[str(tmp_path / f"out{k}") for k in range(4)])
    got = {(r.series_id, r.date): (r.value, r.ema) for r in averages.latest_averages(sent, "batch").collect()}
    want = {(s, d): v for s in known for d, v in average_of(known[s], 3).items()}
    assert got.keys() == want.keys()
    for k, (v, e) in want.items():
        assert got[k][0] == v and (got[k][1] is e is None or abs(got[k][1] - e) < 1e-9)
    late = [(r.series_id, r.date, r.value) for r in sent.where("status = 'too_late'").collect()]
    assert sorted(late) == sorted(refused) and ("a", begin, 999.0) in late
