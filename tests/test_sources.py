import csv
import json
import threading
from collections import Counter
from datetime import date
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files, onefile, quotes, sinks, staging
from tidemark.streaming import upsert


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_delimited(spark, tmp_path, sep):
    path = tmp_path / "a.csv"
    path.write_text("﻿" + sep.join(["Date", "other", "USD/CDF"]) + "\n" + sep.join(["2024-01-01", "x", "1 215.5"]) + "\n" + sep.join(["junk", "y", ""]) + "\n", encoding="utf-8")
    got = files.read_delimited(spark, str(path)).orderBy("row_in_file").collect()
    assert [(r.date_raw, r.value_raw) for r in got] == [("2024-01-01", "1 215.5"), ("junk", None)]
    with pytest.raises(ValueError):
        files.read_delimited(spark, str(path), value_column="nothing")


@pytest.mark.parametrize("split", [900, 4_000, 1 << 20])
def test_true_line_numbers(spark, tmp_path, split):
    """Numbers are those of enumerate, over many splits and two files, with blank lines and a quoted delimiter."""
    bodies = {}
    for name, n in (("a.csv", 500), ("b.csv", 137)):
        rows = [f'2024-01-{k % 28 + 1:02d},"x,{k}",{name}{k}' for k in range(n)]
        bodies[name] = rows
        (tmp_path / name).write_text("\n".join(["date,other,value", *(r + ("\n" if k % 9 == 4 else "") for k, r in enumerate(rows))]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for path, want in ((tmp_path / "a.csv", [f"a.csv{k}" for k in range(500)]), (tmp_path, [f"{n}{k}" for n in bodies for k in range(len(bodies[n]))])):
            got = files.read_delimited(spark, str(path)).orderBy("row_in_file").collect()
            assert [(r.row_in_file, r.value_raw) for r in got] == list(enumerate(want))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("shape", ["list", "envelope", "map"])
def test_json_shapes(spark, tmp_path, shape):
    rows = [{"date": "2024-01-01", "value": 1.5}, {"date": "2024-01-02", "value": 2}]
    body = {"list": rows, "envelope": {"source": "x", "series": rows}, "map": {r["date"]: r["value"] for r in rows}}[shape]
    path = tmp_path / "a.json"
    path.write_text(json.dumps(body, indent=1))
    got = files.read_json_series(spark, str(path)).orderBy("row_in_file").collect()
    assert [(r.date_raw, float(r.value_raw)) for r in got] == [("2024-01-01", 1.5), ("2024-01-02", 2.0)]


def test_json_keys(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps({"meta": {"a": 1}, "items": [{"date": "2024-01-01", "value": 3}]}))
    assert [r.value_raw for r in files.read_json_series(spark, str(path)).collect()] == ["3"]
    for body in ({"records": [{"date": "2024-01-01", "value": 3}]}, {"a": {"b": 1}}, {}):
        path.write_text(json.dumps(body))
        with pytest.raises(ValueError):
            files.read_json_series(spark, str(path))


def test_dates_and_blanks(spark):
    from tidemark.functions.scalars import audit_number, parsed_date

    texts = {
        "2024-12-31": ("2024-12-31",) * 2, "2024-12-31 10:30": ("2024-12-31",) * 2, "2024-12-31T10:30:00.5Z": ("2024-12-31",) * 2, "2024/1/2": ("2024-01-02",) * 2, "20240102": ("2024-01-02",) * 2,
        " 01-02-2024\t": ("2024-01-02", "2024-02-01"), "31.12.2024": (None, "2024-12-31"), "1/2/2024 00:00:00": ("2024-01-02", "2024-02-01"), "2024-13-01": (None, None), "2024-1/2": (None, None), "soon": (None, None), "": (None, None),
        "5 March 2024": ("2024-03-05",) * 2, "Mar 5, 2024": ("2024-03-05",) * 2, "05-MAR-2024": ("2024-03-05",) * 2, "december 31. 2024 10:30": ("2024-12-31",) * 2, "2024 sep 3": ("2024-09-03",) * 2, "2024-May-03": ("2024-05-03",) * 2,
        "31 February 2024": (None, None), "5 Mars 2024": (None, None), "5 Marchy 2024": (None, None), "March 2024": (None, None), "12 2024 March": (None, None),
    }
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    got = df.select("raw", parsed_date(F.col("raw")).cast("string").alias("m"), parsed_date(F.col("raw"), True).cast("string").alias("d")).collect()
    assert {r.raw: (r.m, r.d) for r in got} == texts
    numbers = spark.createDataFrame([("\t1 215,5\r\n",), ("\u202f7\u00a0",), ("\x0b",)], "raw string")
    assert [r.n for r in numbers.select(audit_number(F.col("raw")).alias("n")).collect()] == [1215.5, 7.0, None]


def test_fetch_tries_again(monkeypatch):
    asked = []

    def no(request, timeout):
        asked.append(request.full_url)
        raise TimeoutError("slow")

    monkeypatch.setattr(quotes, "urlopen", no)
    answer = quotes.fetch("http://x/1", 1, 2, 0.0)
    assert answer == quotes.Answer(None, 3, "slow") and asked == ["http://x/1"] * 3
    assert list(quotes.waits(2, 1.5)) == [0.0, 1.5, 3.0]


def test_typed(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("date,value\n2024-01-02,2\n2024-01-01,1\n2024-01-02,9\nx,3\n2024-01-03,y\n")
    assert [(str(r.date), r.value) for r in files.read_typed(spark, str(path)).orderBy("date").collect()] == [("2024-01-01", 1.0), ("2024-01-02", 2.0)]
    path.write_text("date,value\n2024-01-02,-2\n")
    with pytest.raises(ValueError):
        files.read_typed(spark, str(path))
    assert files.read_report(spark, str(tmp_path / "missing.csv")) is None


def test_envelope_round_trip(spark, tmp_path):
    s = spark.createDataFrame([("a", date(2024, 1, 2), 2.0), ("a", date(2024, 1, 1), 1.0)], "series_id string, date date, value double")
    e = sinks.envelope(s, {"added": F.lit(2)})
    sinks.write_json(e, str(tmp_path / "e"))
    back = spark.read.json(str(tmp_path / "e"))
    assert back.first().observations == 2 and back.first().period.end == "2024-01-02"
    assert Counter(sinks.open_envelope(back).collect()) == Counter(s.collect())
    sinks.write_csv(s, str(tmp_path / "c"), value="USD/CDF")
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["series_id", "date", "USD/CDF"]
    sinks.write_table(s, str(tmp_path / "t"), "series_id")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    sinks.check_published(s, "2024-01-02")
    with pytest.raises(ValueError):
        sinks.check_published(s, "2024-01-01")


def test_quote_pages(spark):
    class Page(BaseHTTPRequestHandler):
        def do_GET(self):
            good = not self.path.endswith("02")
            self.send_response(200 if good else 404)
            self.end_headers()
            if good:
                self.wfile.write(f"<p>USD (cours moyen) 22{self.path[-2:]},5</p>".encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(quotes.QuotePages)
        pages = spark.read.format("quote_pages").options(base=f"http://127.0.0.1:{server.server_port}/d", start="2024-01-01", end="2024-01-04", retries=0, days_per_partition=3).load()
        got = {str(r.date): r.value for r in quotes.rates(pages).collect()}
    finally:
        server.shutdown()
    assert got == {"2024-01-01": 2201.5, "2024-01-03": 2203.5, "2024-01-04": 2204.5}


def test_staged_once_follows_the_files(spark, tmp_path):
    made = []

    def of():
        return staging.staged_once(spark, str(tmp_path), "n", lambda: made.append(1) or spark.read.parquet(f"{tmp_path}/t").agg(F.sum("id").alias("s"))).first().s

    spark.range(5).write.parquet(f"{tmp_path}/t")
    assert of() == of() == 10 and len(made) == 1
    spark.range(7).write.mode("overwrite").parquet(f"{tmp_path}/t")
    assert of() == 21 and len(made) == 2


def test_quote_stream(spark, tmp_path):
    """Batches read the new days and the last ones before again; a restart asks for no other day."""
    asked = []

    class Page(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path.rsplit("/", 1)[1])
            self.send_response(200)
            self.end_headers()
            self.wfile.write(f"<td>USD (cours moyen)</td><td>2 2{self.path[-2:]},50</td>".encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def run(end):
        spark.dataSource.register(quotes.QuotePages)
        pages = spark.readStream.format("quote_pages").options(base=f"http://127.0.0.1:{server.server_port}/d", start="2024-01-01", end=end, retries=0, back=3, days_per_partition=2).load()
        query = quotes.rates(pages).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        query.awaitTermination()
        days = sorted(asked)
        asked.clear()
        return days

    try:
        assert run("2024-01-05") == [f"2024-01-0{k}" for k in range(1, 6)]
        assert run("2024-01-05") == []
        assert run("2024-01-07") == [f"2024-01-0{k}" for k in range(3, 8)]
    finally:
        server.shutdown()
    got = [(str(r.date), r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == 10 and {d: v for d, v in got} == {f"2024-01-0{k}": 2200.5 + k for k in range(1, 8)}


@pytest.mark.parametrize("kind", ["csv", "json", "lines"])
def test_one_file(spark, tmp_path, kind):
    """Rows in order, odd values, one file and nothing beside it; a failed task leaves the old file whole."""
    path = tmp_path / "new" / f"out.{kind}"
    rows = [(k, f'x,"{k}"\né', date(2024, 1, 1 + k % 28), [k, None], None) for k in range(50)]
    df = spark.createDataFrame(rows, "k int, t string, d date, a array<int>, n double").repartitionByRange(5, "k").sortWithinPartitions("k")
    onefile.write_one_file(df.drop("a") if kind == "csv" else df, str(path), kind)

    def read():
        if kind == "csv":
            with open(path, newline="") as f:
                return [(int(r["k"]), r["t"], r["d"]) for r in csv.DictReader(f)]
        text = path.read_text()
        objects = json.loads(text) if kind == "json" else [json.loads(line) for line in text.splitlines()]
        assert all(o["a"] == [o["k"], None] and o["n"] is None for o in objects)
        return [(o["k"], o["t"], o["d"]) for o in objects]

    want = [(k, t, str(d)) for k, t, d, *_ in rows]
    assert read() == want and [p.name for p in path.parent.iterdir()] == [path.name]
    dies = df.withColumn("t", F.when(F.col("k") == 43, F.raise_error(F.lit("lost"))).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="lost"):
        onefile.write_one_file(dies.drop("a") if kind == "csv" else dies, str(path), kind)
    assert read() == want
    onefile.write_one_file(df.limit(0).drop("a"), str(path), kind)
    assert read() == []


def test_stream_upsert(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / x) for x in ("in", "table", "cp"))
    (tmp_path / "in").mkdir()

    def send(name, rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"series_id": "s", "date": d, "value": v, "seen": t}) for d, v, t in rows))
        upsert.start(spark, source, table, checkpoint).awaitTermination()

    send("1.json", [("2023-12-31", 1.0, "2024-01-01T00:00:00"), ("2024-01-01", 2.0, "2024-01-01T00:00:00"), ("2024-01-01", 2.5, "2024-01-02T00:00:00")])
    send("2.json", [("2024-01-01", 3.0, "2024-01-03T00:00:00"), ("2024-01-02", 4.0, "2024-01-03T00:00:00")])
    got = {str(r.date): r.value for r in upsert.read_table(spark, table).collect()}
    assert got == {"2023-12-31": 1.0, "2024-01-01": 3.0, "2024-01-02": 4.0}
