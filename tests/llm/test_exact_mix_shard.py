import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm import exact_dedup, mixing, queries, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_exact_groups(request, table, keep):
    df = request.getfixturevalue(table)
    rows, got = df.select("doc_id", "text").collect(), exact_dedup.exact_groups(df, keep=keep).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    best = {t: (min if keep == "min" else max)([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    want = Counter((r.doc_id, best[r.text or ""], len(groups[r.text or ""]), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert Counter(r.text_sha256 for r in kept) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
    assert all(r.doc_id == r.keep_id for r in kept)
    left = exact_dedup.drop_exact(df, keep=keep)
    assert left.columns == df.columns
    assert Counter((r.doc_id, r.text or "") for r in left.collect()) == Counter((best[t], t) for t in groups)


def _targets(sizes, weights, cap):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while True:
        left, w = total - sum(target.values()), sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > cap * sizes[s]} if free else set()
        if not over:
            return target | {s: left * weight[s] / w for s in free}
        target |= {s: cap * sizes[s] for s in over}
        free -= over


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
def test_mix_sources(request, table):
    df = request.getfixturevalue(table)
    rows = df.select("doc_id", "text", "source").collect()
    got = mixing.mix_sources(df, [5.0, 2.0, 1.0]).collect()
    again = mixing.mix_sources(df.repartition(5), [5.0, 2.0, 1.0]).collect()
    assert Counter(got) == Counter(again)
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    target = _targets(dict(sizes), [5.0, 2.0, 1.0], 3)
    want = Counter((r.doc_id, len(WORD.findall(r.text or "")), sizes[r.source], round(target[r.source], 4)) for r in rows)
    assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 4)) for r in got) == want
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    by = defaultdict(lambda: [0, 0.0])
    for r in got:
        key = (r.source_size, round(r.target, 4))
        by[key][0] += r.taken
        by[key][1] = sum(t for s, t in target.items() if (sizes[s], round(t, 4)) == key)
    assert all(abs(taken - goal) <= 40 for taken, goal in by.values())


def test_mix_many_shards(docs):
    got = mixing.mix_sources(docs, [5.0, 2.0, 1.0], words_per_shard=3000).collect()
    by = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        by[r.source_size, r.target] += r.taken
    assert all(abs(taken - target) <= max(300, 0.02 * target) for (_, target), taken in by.items())


def test_mix_caps(spark):
    rows = [(k, "w " * 10, "a" if k < 2 else "b") for k in range(100)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), [50.0, 1.0]).collect()
    assert {r.target for r in got if r.source_size == 20} == {60.0}
    assert {r.target for r in got if r.source_size == 980} == {940.0}
    assert all(r.taken == 30 for r in got if r.source_size == 20)


def test_sainte_lague(spark):
    votes = [("a", 53, 7), ("b", 24, 7), ("c", 23, 7), ("d", 0, 7)]
    frame = spark.createDataFrame([(p, float(v), s, 1) for p, v, s in votes], "party string, votes double, seats long, one int")
    got = {r.party: r.won_seats for r in mixing.sainte_lague(frame, ["party"], ["one"], "votes", "seats", "won_seats").collect()}
    quotients = sorted(((-v / (2 * j + 1), p) for p, v, _ in votes if v for j in range(7)))[:7]
    assert got == {p: sum(q[1] == p for q in quotients) for p, _, _ in votes}


@pytest.mark.parametrize("seats", [1, 2, 13, 100, 4001])
def test_sainte_lague_matches_all_quotients(spark, seats):
    votes = [(f"p{k}", float((k * k * 7919) % 1009 + 1)) for k in range(23)]
    frame = spark.createDataFrame([(p, v, seats, 1) for p, v in votes], "party string, votes double, seats long, one int")
    got = {r.party: r.won_seats for r in mixing.sainte_lague(frame, ["party"], ["one"], "votes", "seats", "won_seats").collect()}
    top = sorted((-v / (2 * j + 1), p, j) for p, v in votes for j in range(seats))[:seats]
    assert got == {p: sum(q[1] == p for q in top) for p, _ in votes}


def test_mixed_rows(docs, odd, none):
    for df in (docs, odd, none):
        got = mixing.mixed_rows(df, [5.0, 2.0, 1.0])
        assert got.columns == df.columns
        often = Counter(r.doc_id for r in got.select("doc_id").collect())
        taken = mixing.mix_sources(df, [5.0, 2.0, 1.0]).where("size > 0").collect()
        want = Counter()
        for r in taken:
            want[r.doc_id] += (2 * r.taken + r["size"]) // (2 * r["size"])
        assert sum(often.values()) == sum(want.values())


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
@pytest.mark.parametrize("shards", [40, 3])
def test_shards(request, table, shards):
    df = request.getfixturevalue(table)
    rows = df.select("doc_id", "text", "source").collect()
    got = sharding.interleaved_shards(df, shards).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(slots[k]) for k in range(shards)]
    assert max(counts) - min(counts) <= 1


def test_shards_match_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_CELL", 100)
    rows = [(k, f"t{k}", "big" if k % 10 < 7 else f"s{k % 10}") for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sharding.interleaved_shards(df, 8).join(df, "doc_id").groupBy("shard", "source").count().collect()
    assert {r["count"] for r in got if r.source == "big"} <= {349, 350, 351}
    assert {r["count"] for r in got if r.source != "big"} <= {49, 50, 51}


def test_oracles(spark, tiny):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, tiny)
        want = con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        assert Counter(map(tuple, got.select(*sorted(got.columns)).collect())) == Counter(want.select(", ".join(sorted(want.columns))).fetchall()), name
