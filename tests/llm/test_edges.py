"""Odd and empty tables row by row, features and models by brute force, and results that do not depend on how scans are split."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import docstats, exact_dedup, language, mixing, quality, shared, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near_kept(rows, similarity=0.8):
    """(id, text) that stay, by all pairs; rows of a group that share its smallest id count as alike."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if root[i] != root[j] and (sets[i] == sets[j] or both and both >= similarity * len(sets[i] | sets[j])):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    best = {}
    for (i, t), r in zip(rows, root, strict=True):
        best[r] = min(best.get(r, (True, 0)), (i is None, i or 0))
    return Counter(i if not none else None for none, i in best.values())


@pytest.mark.parametrize("table", ["odd", "none"])
@pytest.mark.parametrize("plain", [False, True])
def test_drop_near_rows(request, table, plain):
    df = request.getfixturevalue(table)
    got = simhash.drop_near(df, plain_table=plain)
    assert got.columns == df.columns
    rows = [(r.doc_id, r.text) for r in df.collect()]
    left = got.collect()
    assert Counter(r.doc_id for r in left) == near_kept(rows)
    assert all((r.doc_id, r.text) in rows for r in left)


def test_keep_good_rows(odd, none, no_labels):
    for df in (odd, none):
        got = quality.keep_good(df, no_labels)
        assert got.columns == df.columns
        want = Counter()
        for r in df.collect():
            words = WORD.findall(r.text or "")
            windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
            inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
            if len(words) >= 50 and 100 * len(inside) <= 50 * len(words):
                want[tuple(r)] += 1
        assert Counter(map(tuple, got.collect())) == want
        judged = quality.quality_rules(df, no_labels).where("kept").collect()
        assert len(judged) == sum(want.values())


@pytest.fixture
def scattered(spark, tmp_path):
    """Documents in several small files, with repeated rows and near copies."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(400):
        words = [f"w{v}" for v in rng.integers(0, 3000, 60)]
        rows.append((k, " ".join(words), "abc"[k % 3]))
        if k % 3 == 0:
            rows.append((1000 + k, " ".join([*words[:-1], "other"]), "b"))
        if k % 7 == 0:
            rows.append(rows[-1])
    path = str(tmp_path / "scattered")
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(12).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", ["near", "near_of_table", "mixed", "mixed_of_table", "exact", "groups"])
def test_splits_may_change_between_scans(spark, scattered, name):
    """As when executors come or go: splits follow the cores at hand."""
    make = {
        "near": lambda d: simhash.drop_near(d), "near_of_table": lambda d: simhash.drop_near(d, plain_table=True),
        "mixed": lambda d: mixing.mixed_rows(d, [5.0, 2.0, 1.0]), "mixed_of_table": lambda d: mixing.mixed_rows(d, [5.0, 2.0, 1.0], plain_table=True),
        "exact": exact_dedup.drop_exact, "groups": exact_dedup.exact_groups,
    }[name]
    got = []
    spark.conf.set("spark.sql.files.openCostInBytes", "1024")
    try:
        for first, then in ((2, 2), (2, 40), (40, 1)):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", first)
            df = make(scattered)
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", then)
            assert scattered.rdd.getNumPartitions() > 1 or then == 1
            got.append(Counter(map(tuple, df.collect())))
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sum(got[0].values()) >= 400 and got[0] == got[1] == got[2]


def test_row_keys_are_unique(spark, scattered, odd):
    for df, plain in ((scattered, True), (scattered, False), (odd.union(odd), True), (odd.where("doc_id > 3"), True)):
        keyed, key = shared.with_row_key(df, plain)
        assert keyed.select(*key).distinct().count() == df.count() and keyed.drop(*key).columns == df.columns


def test_shared_folder_is_asked_for(monkeypatch):
    class Session:
        conf = type("", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = type("", (), {"getConf": staticmethod(dict), "master": "spark://somewhere:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Session)


def test_features_by_brute_force(docs):
    """The models' inputs, each by its definition."""
    for r in docs.limit(60).collect():
        text = r.text or ""
        got = dict(zip(docstats.FEATURES, docstats.text_stats(text)[len(docstats.COUNTS) :], strict=True))
        words, raw = WORD.findall(text), text.encode()
        if not words:
            assert not any(got.values())
            continue
        ink = [b for b in raw if b not in b" \t\n\x0b\x0c\r"]
        lines = [x for x in text.split("\n") if WORD.search(x)]
        share = lambda of, among: sum(b in of for b in among) / len(among)
        windows = [raw[i : i + 1024] for i in range(0, len(raw), 1024)]
        worst = lambda of: max(sum(b in of for b in w) for w in windows) / min(len(raw), 1024)
        upper, digits = bytes(range(65, 91)), b"0123456789"
        runs, longest = 1, 1
        for a, b in zip(words, words[1:], strict=False):
            runs = runs + 1 if a == b else 1
            longest = max(longest, runs)
        windows3 = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        inside = {j for i in range(len(words) - 2) if windows3[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        want = {
            "log_words": np.log1p(len(words)), "mean_word": len(ink) / len(words), "symbols": share(b"#*$%&|<>", ink), "worst_symbols": worst(b"#*$%&|<>"), "bangs": share(b"!", ink), "worst_bangs": worst(b"!"),
            "capitals": share(upper, ink), "worst_capitals": worst(upper), "digits": share(digits, ink), "marks": share(b".,:;?", ink), "high_bytes": sum(b > 127 for b in ink) / len(ink), "lines": len(lines) / len(words),
            "dup_lines": (len(lines) - len(set(lines))) / max(len(lines), 1), "repeats": len(inside) / len(words), "distinct": len(set(words)) / len(words),
            "doubled": np.mean([a == b for a, b in zip(words, words[1:], strict=False)]) if len(words) > 1 else 0.0, "longest_run": longest / len(words),
            "alphabetic": sum(b > 127 or chr(b).isalpha() for b in ink) / len(ink),
        }
        assert set(want) == set(got)
        for k, v in want.items():
            assert got[k] == pytest.approx(v, abs=1e-6), k


def test_rules_held_out(spark):
    """Fitted on two thirds of the labels, the rules keep the good of the rest and drop the bad."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.held_out("doc_id", 3, 1)
    judged = quality.quality_rules(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels.where(~out)).join(labels.where(out), "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in judged if r.quality == 1], [r.kept for r in judged if r.quality == 0]
    assert len(good) > 500 and np.mean(good) > 0.97
    assert len(bad) > 50 and np.mean(bad) < 0.1


def brute_subwords(text):
    """Two- and three-letter subwords with word edges, as pairs of length and text (edges are blanks)."""
    shown = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = f" {shown} "
    two = [padded[i : i + 2] for i in range(len(padded) - 1) if padded[i : i + 2].strip()]
    three = [padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " "]
    return two + three


def test_subwords_by_brute_force(docs):
    """Equal subwords fall into equal buckets, as often as they occur, and different ones rarely meet."""
    bucket = {}
    for text in ["a", "ab", "déjà vu!", "Ünïcödé wörds, 12 of them", *[r.text for r in docs.limit(20).collect() if r.text]]:
        names, got = brute_subwords(text), language.subwords(text)
        assert len(names) == len(got)
        for n, b in zip(names, got.tolist(), strict=True):
            assert bucket.setdefault(n, b) == b, n
    assert max(bucket.values()) < language.BUCKETS and len(set(bucket.values())) > 0.6 * min(len(bucket), language.BUCKETS)
    assert len(language.subwords("12 ?!")) == 0


def test_prediction_by_brute_force():
    """The share-weighted mean of embeddings through the softmax, subword by subword."""
    rng = np.random.default_rng(2)
    texts = ["der hund und die katze"] * 20 + ["the dog and the cat"] * 20
    rows = language.Sample.of([np.unique(language.subwords(t), return_counts=True) for t in texts])
    model = language.train(rows, ["de"] * 20 + ["en"] * 20, epochs=5)
    for text in ("the cat", "und katze", "xyz " * 50, "".join(rng.choice(list("abc é"), 200))):
        grams = language.subwords(text)
        z = np.array([np.mean([model.logits[g, k] for g in grams]) + model.bias[k] for k in range(2)])
        p = np.exp(z) / np.exp(z).sum()
        (name,), (score,) = model.predict([text])
        assert name == ["de", "en"][int(z.argmax())] and score == pytest.approx(p.max(), abs=1e-5)
    top = model.predict(texts)[1]
    assert language.train(rows, ["de"] * 20 + ["en"] * 20, keep=0.5).least > 0 == model.least and (top >= 0.5).all()
    assert model.predict(["the dog and cat", "die katze und hund", "", None, "?"])[0] == ["en", "de", "und", "und", "und"]


def test_sparse_rows_are_dense_rows():
    rows = language.Sample.of([(np.array([3, 7]), np.array([1, 3])), (np.array([], int), np.array([], int)), (np.array([7]), np.array([2]))])
    got = rows.dense(np.array([2, 0]))
    assert got[0, 7] == 1 and got[1, 3] == 0.25 and got[1, 7] == 0.75 and got.sum() == 2


def test_every_language_is_learned(spark):
    """More languages than any fixed list, most of them rare; each has an alphabet of its own."""
    alphabet = {f"l{k:03d}": [chr(0x4E00 + 40 * k + j) for j in range(12)] for k in range(90)}
    rng, rows = np.random.default_rng(6), []
    for k, (name, letters) in enumerate(alphabet.items()):
        for _ in range(400 if k == 0 else 14):
            rows.append((len(rows), " ".join("".join(rng.choice(letters, 5)) for _ in range(12)), name))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify_language(df, rows_per_lang=60, max_rows=1200).join(df, "doc_id").collect()
    assert {r.lang_pred for r in got} == set(alphabet)
    assert np.mean([r.lang_pred == r.lang for r in got if r.held_out]) > 0.9
    sample, langs = language._sample(df, "doc_id", "text", "lang", 60, 1200)
    by = Counter(langs)
    assert set(by) == set(alphabet) and by["l000"] < 60 and len(langs) == len(sample.ends) < 2400


@pytest.mark.parametrize("place", [0, 8, 9, 19, 29])
def test_a_language_of_one_row_is_fitted(place):
    """Wherever its row stands in the sample, also where every tenth row would only calibrate."""
    texts = [f"the house number {k} stands near some old trees" for k in range(30)]
    texts[place] = "zzyx qqwv zzyx kkzz qqwv"
    langs = ["zz" if k == place else "en" for k in range(30)]
    sample = language.Sample.of([np.unique(language.subwords(t), return_counts=True) for t in texts])
    names, _ = language.train(sample, langs).predict(["zzyx qqwv kkzz", "some house stands near"])
    assert names == ["zz", "en"]


def test_large_lists_are_found(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SAMPLED", 1)
    monkeypatch.setattr(simhash, "BLOCK", 50)
    nodes = spark.range(300).select(F.col("id").alias("node"))
    rows = simhash.met(lambda d: d.select("node", F.lit(0).alias("slot"), F.when(F.col("node") < 200, 7).otherwise(F.col("node")).alias("value")), nodes).collect()
    lists = defaultdict(set)
    for r in rows:
        lists[r.value, r.x, r.y].add(r.node)
    assert {v for v, _, _ in lists} == {7} and len(lists) > 1
    assert max(map(len, lists.values())) < 150
    pairs = {(a, b) for held in lists.values() for a in held for b in held}
    assert len(pairs) == 200 * 200
