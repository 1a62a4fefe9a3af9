import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tidemark.llm import components, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text, k):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, most):
    values = sorted(set(prints.values()))
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= most:
                root[top(a)] = top(b)
    return {v: top(v) for v in values}


def check(df, most=4):
    rows = df.select("doc_id", "text").collect()
    prints = {n: brute_fingerprint(r.text, 4) for n, r in enumerate(rows)}
    tops = brute_components(prints, most)
    least = {}
    for n, r in enumerate(rows):
        if r.doc_id is not None:
            t = tops[prints[n]]
            least[t] = min(least.get(t, r.doc_id), r.doc_id)
    want = Counter((r.doc_id, f"{prints[n]:016x}", least.get(tops[prints[n]])) for n, r in enumerate(rows))
    got = simhash.near_groups(df, max_bits=most).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_near_groups(docs, odd, none):
    for df in (docs, odd, none):
        check(df)


def test_more_bits(docs):
    check(docs, 6)


def _noisy(spark, n=300):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(500)]
    base = list(rng.choice(vocabulary, 200))
    rows = []
    for k in range(n):
        words = list(base)
        for at in rng.integers(0, 200, k % 5):
            words[at] = str(rng.choice(vocabulary))
        rows.append((k, " ".join(words)))
    rows += [(n + k, " ".join(rng.choice(vocabulary, 200))) for k in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("sizes", [(32, 20_000), (4, 50)])
def test_large_and_split_lists(spark, monkeypatch, sizes):
    monkeypatch.setattr(simhash, "SMALL", sizes[0])
    monkeypatch.setattr(simhash, "BLOCK", sizes[1])
    check(_noisy(spark))


def test_drop_near(spark, tmp_path, odd, none):
    df = _noisy(spark)
    df.write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    kept = {r.doc_id for r in simhash.drop_near(df).collect()}
    assert kept >= {0, *range(300, 360)}
    assert len(kept) <= 70  # pairs of far copies may be under the limit
    for table in (odd, none):
        assert simhash.drop_near(table).columns == table.columns


def test_drop_near_against_jaccard(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets, ids = [], []
    for r in docs.dropDuplicates(["text"]).collect():
        words = WORD.findall((r.text or "").lower())
        if len(words) >= 50:
            sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
            ids.append(r.doc_id)
    near = [(ids[a], ids[b], len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in range(len(sets)) for b in range(a)]
    df = docs.where(docs.doc_id.isin(ids))
    kept = {r.doc_id for r in simhash.drop_near(df).select("doc_id").collect()}
    alike = [p for p in near if p[2] >= 0.85]
    assert np.mean([not (p[0] in kept and p[1] in kept) for p in alike]) >= 0.95
    touched = {i for p in near if p[2] >= 0.6 for i in p[:2]}
    assert kept >= set(ids) - touched


def _passages(rng, kind, n):
    """A text by Zipf's law, and the text with a passage of up to a sixth of it inserted, cut out or appended."""
    vocabulary = np.array([f"w{k}" for k in range(20_000)])
    weight = 1 / np.arange(1, 20_001)
    words = list(rng.choice(vocabulary, n, p=weight / weight.sum()))
    size, at = max(1, int(n * rng.uniform(0.02, 0.16))), int(rng.integers(1, n * 3 // 4))
    passage = list(rng.choice(vocabulary, size, p=weight / weight.sum()))
    other = {"insert": words[:at] + passage + words[at:], "cut": words[:at] + words[at + size :], "append": words + passage}[kind]
    return words, other


def _shingles(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def _jaccard(a, b):
    x, y = _shingles(a), _shingles(b)
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("kind", ["insert", "cut", "append"])
def test_drop_near_meets_passages(spark, tmp_path, kind):
    rng = np.random.default_rng(5)
    pairs = [_passages(rng, kind, int(rng.integers(60, 400))) for _ in range(300)]
    rows = [(2 * k + j, " ".join(p[j])) for k, p in enumerate(pairs) for j in (0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    kept = {r.doc_id for r in simhash.drop_near(spark.read.parquet(str(tmp_path / "d"))).collect()}
    alike = [k for k, p in enumerate(pairs) if _jaccard(*p) >= 0.9]
    assert len(alike) > 50
    assert not [k for k in alike if 2 * k + 1 in kept]
    assert kept >= set(range(0, 600, 2))


@pytest.mark.parametrize("together", [400_000, 400])
def test_drop_near_is_exact(spark, tmp_path, monkeypatch, together):
    """Pairs on both sides of 0.8, and groups in several blocks: what stays is what all pairs by brute force leave."""
    monkeypatch.setattr(simhash, "TOGETHER", together)
    rng = np.random.default_rng(11)
    texts = []
    for k in range(60):
        words, other = _passages(rng, ["insert", "cut", "append"][k % 3], int(rng.integers(5, 300)))
        texts += [words, other, words[: int(len(words) * rng.uniform(0.74, 0.86))]]
    base = [f"b{k}" for k in range(200)]
    for _ in range(40):
        words = list(base)
        for at in rng.integers(0, 200, int(rng.integers(1, 8))):
            words[at] = f"x{rng.integers(10**9)}"
        texts.append(words)
    sets = [_shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    kept = {r.doc_id for r in simhash.drop_near(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert kept == set(root)


def test_drop_near_goes_through_the_index(spark, tmp_path, monkeypatch):
    """Close copies are found by the byte-position index alone."""
    monkeypatch.setattr(simhash, "set_links", lambda nodes, *_: spark.createDataFrame([], "a long, b long"))
    rng = np.random.default_rng(7)
    rows = []
    for k in range(20):
        words = [f"w{v}" for v in rng.integers(0, 10**6, 400)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, "more"]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    kept = {r.doc_id for r in simhash.drop_near(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert kept == set(range(0, 40, 2))


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + k, 1001 + k) for k in range(90)]
    root = {}

    def top(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in pairs:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {v: top(v) for v in list(root) if top(v) != v}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
