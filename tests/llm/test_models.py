import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import boosting, docstats, language, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            inside |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\t\x1c\xa0#|é"), max_size=60))
def test_counts(text):
    assert docstats.text_stats(text)[:5] == brute_counts(text)


def test_repeat_words_with_many_distinct():
    codes = np.array([0, 1, 2, 3, 0, 1, 2, 9, 1, 2, 3])
    assert docstats.repeat_words(codes, 10) == docstats.repeat_words(codes, 1 << 20) == 10


def test_monotone():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4)).astype(np.float32)
    y = (x[:, 0] + 0.4 * np.sin(9 * x[:, 0]) + x[:, 1] > 1).astype(float)
    trees = boosting.fit(x, y, monotone={0: 1, 1: -1})
    grid = np.repeat(rng.random((50, 4)).astype(np.float32), 40, 0).reshape(50, 40, 4)
    for k, sign in ((0, 1), (1, -1)):
        g = grid.copy()
        g[:, :, k] = np.linspace(0, 1, 40)
        s = trees.score(g.reshape(-1, 4)).reshape(50, 40)
        assert (sign * np.diff(s, axis=1) >= -1e-12).all()
    free = boosting.fit(x, y)
    assert ((free.score(x) >= 0.5) == y).mean() > 0.95


def test_trees_like_recursion():
    rng = np.random.default_rng(2)
    x = rng.random((500, 3)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] > 0.3).astype(float)
    t = boosting.fit(x, y, trees=5)

    def walk(k, row):
        node = 0
        while node < t.feature.shape[1]:
            node = 2 * node + 1 + (row[t.feature[k, node]] > t.threshold[k, node])
        return t.leaf[k, node - t.feature.shape[1]]

    want = [t.base + sum(walk(k, row) for k in range(5)) for row in x]
    assert np.allclose(t.margin(x), want)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify_quality(docs, labels)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.collect())
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    bad = [r for r in rows if r.quality == 0]
    assert np.mean([r.predicted == 0 for r in bad]) > 0.8


def test_rules(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = quality.quality_rules(docs, labels).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute_counts(texts[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in got if r.kept}
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == kept
    ok = {r.doc_id for r in got if not r.base_failed}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    assert np.mean([i in kept for i in ok if marks.get(i) == 1]) > 0.98
    assert np.mean([i in kept for i in ok if marks.get(i) == 0]) < 0.2


@pytest.mark.parametrize("table", ["odd", "none"])
def test_odd_quality(request, spark, table, no_labels):
    df = request.getfixturevalue(table)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for marks in (labels, no_labels):
        got = quality.classify_quality(df, marks).collect()
        assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
        rules = quality.quality_rules(df, marks).collect()
        assert Counter((r.doc_id, r.n_words) for r in rules) == Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in df.collect())
        assert quality.keep_good(df, marks).columns == df.columns


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify_language(docs).join(docs, "doc_id").collect()
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert np.mean([r.accepted for r in held if r.lang_pred == r.lang]) > 0.95


@pytest.mark.parametrize("table", ["odd", "none"])
def test_odd_language(request, table):
    df = request.getfixturevalue(table)
    got = language.identify_language(df).collect()
    assert len(got) == df.count()
    blank = {r.doc_id for r in df.collect() if not any(c.isalpha() for c in r.text or "")}
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (r.doc_id in blank)
