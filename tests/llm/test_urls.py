from collections import Counter
from datetime import date, datetime, timedelta

from tidemark.llm import url_filters

URLS = [None, "", "nohost", "http://A.B.c/x", "https://u:p@b.c:80/", "https://b.c./q?x#y", "ftp://x.y", "http://zb.c/", "http://d/"]
ENTRIES = [("b.c", 3, "x"), ("b.c", 6, None), ("b.c", 8, "z"), ("b.c", 8, "y"), ("a.b.c", 5, "own"), ("D", 1, "d"), (None, 1, "n"), ("c", None, "n"), ("y", 2, None)]


def host(url):
    if not url or "://" not in url:
        return None
    rest = url.split("://", 1)[1].split("/", 1)[0].split("?", 1)[0].split("#", 1)[0].rsplit("@", 1)[-1]
    return rest.split(":")[0].rstrip(".").lower() or None


def test_against_loops(spark):
    day = lambda k: date(2024, 1, 1) + timedelta(k)
    captures = [(10 * u + d, url, day(d), "clash") for u, url in enumerate(URLS) for d in range(10)] + [(None, URLS[3], day(4), "c"), (999, URLS[3], None, "c"), (35, URLS[3], day(5), "c")]
    entries = [(d, None if k is None else day(k), c) for d, k, c in ENTRIES]
    df = spark.createDataFrame(captures, "page_id long, url string, fetched_on date, host string")
    listed = spark.createDataFrame(entries, "domain string, listed_on date, category string")
    want = Counter()
    for i, url, at, _ in captures:
        h, hit = host(url), None
        labels = h.split(".") if h and at else []
        for k in range(len(labels)):
            name = ".".join(labels[k:])
            dated = [(d, c) for n, d, c in entries if n and n.lower() == name and d and d <= at]
            if dated:
                last = max(d for d, _ in dated)
                found = [c for d, c in dated if d == last and c is not None]
                if found:
                    hit = (name, max(found))
                    break
        want[i, h, *(hit or (None, None)), hit is not None] += 1
    got = url_filters.filter_urls(df, listed)
    assert Counter(map(tuple, got.collect())) == want
    assert url_filters.filter_urls(df, listed.limit(0)).where("blocked").count() == 0
    assert url_filters.filter_urls(df.limit(0), listed).count() == 0


def test_times_within_a_day(spark):
    """Timestamps: entries earlier the same day, at the same moment, days before, and taken off again."""
    at = lambda s: datetime.fromisoformat(f"2024-01-{s}")
    entries = [("x.y", at("01T10:00:00"), "a"), ("x.y", at("03T12:00:00"), None), ("x.y", at("03T18:00:00"), "b"), ("y", at("02T00:00:00"), "c")]
    moments = ["01T09:59:59", "01T10:00:00", "01T23:00:00", "02T05:00:00", "03T11:59:59", "03T12:00:00", "03T17:59:59", "03T18:00:00", "09T00:00:00"]
    df = spark.createDataFrame([(k, "http://w.x.y/", at(m)) for k, m in enumerate(moments)], "page_id long, url string, fetched_on timestamp").repartition(4)
    got = {r.page_id: (r.domain, r.category) for r in url_filters.filter_urls(df, spark.createDataFrame(entries, "domain string, listed_on timestamp, category string")).collect()}
    assert got == dict(enumerate([(None, None), ("x.y", "a"), ("x.y", "a"), ("x.y", "a"), ("x.y", "a"), ("y", "c"), ("y", "c"), ("x.y", "b"), ("x.y", "b")]))


def test_sql_host_rule(spark, tmp_path):
    """The query and its SQL agree on odd URLs."""
    import duckdb

    from tidemark.llm import queries

    urls = [None, "", "nohost", "http://A.ads-track.example.org/x", "https://u:p@example.net:80/", "https://example.net./q?x#y", "http://[::1]:80/", "http://u@[::2]/", "http://[oops/", "ftp://cheap-pills.example.com"]
    spark.createDataFrame([(60 * k + 9, u, "") for k, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    names = ["page_id", "host", "domain", "category", "blocked"]
    want = con.sql(queries.oracle_sql()["op3_url_filters"]).select(", ".join(names)).fetchall()
    assert sorted(map(tuple, queries.op3_url_filters(spark, str(tmp_path)).select(*names).collect())) == sorted(want)


def test_hosts(spark):
    from pyspark.sql import functions as F

    from tidemark.llm.url_filters import host_of

    urls = {"http://[::1]:8080/x": "[::1]", "https://u@[2001:DB8::2]/": "[2001:db8::2]", "http://A.b.:80?q": "a.b", "http://[oops/": None, "mailto:x": None, "": None}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.host for r in df.select("url", host_of(F.col("url")).alias("host")).collect()} == urls
