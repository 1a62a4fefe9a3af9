import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from tidemark.llm.shared import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    names, seen = docs.columns, [docs]
    assert [k for k, _ in cp.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "packing"]
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, sf), name)
        seen.append(docs)
        if name != "packing":
            assert docs.columns == names
    before, good, exact, near, mixed, packed = [d.collect() for d in seen]
    kept = {r.doc_id for r in good}
    assert all(len(WORD.findall(r.text or "")) >= 50 for r in good)
    long = [r for r in before if len(WORD.findall(r.text or "")) >= 60]
    clean = [r.doc_id for r in long if r.doc_id in labels and labels[r.doc_id].quality == 1]
    assert sum(i in kept for i in clean) > 0.98 * len(clean)
    texts = {}
    for r in good:
        texts[r.text] = min(r.doc_id, texts.get(r.text, r.doc_id))
    assert sorted(r.doc_id for r in exact) == sorted(texts.values())
    assert {r.doc_id for r in near} <= {r.doc_id for r in exact} and len(near) == len({r.doc_id for r in near})
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in near}
    words = lambda rows: sum(len(WORD.findall(r.text)) for r in rows)
    assert abs(words(mixed) - words(near)) < 0.05 * words(near)
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed}


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def expected_before_mixing(good):
    """Of the rows that the rules keep: of equal texts and then of near copies the smallest id, by all pairs."""
    first = {}
    for r in good:
        first[r.text] = min(first.get(r.text, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    rows = [(i, t) for t, i in first.items()]
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if root[i] != root[j] and both and both >= 0.8 * len(sets[i] | sets[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    best = {}
    for (i, _), r in zip(rows, root, strict=True):
        best[r] = min(best.get(r, i), i)
    return {i for none, i in best.values() if not none}


def test_run(spark):
    """The whole pipeline, stage by stage by other means: all pairs, the mixture's words, the tokenizers library."""
    from tokenizers import Tokenizer

    from tidemark.llm import mixing, quality
    from tidemark.llm.queries import CAPACITY, WEIGHTS, tokenizer_path

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in quality.quality_rules(docs, labels).where("kept").collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    near = expected_before_mixing([r for i, r in rows.items() if i in kept])
    taken = mixing.mix_sources(spark.createDataFrame([rows[i] for i in near], docs.schema), WEIGHTS).collect()
    want = {r.doc_id: (2 * r.taken + r.size) // (2 * r.size) for r in taken if r.size and (2 * r.taken + r.size) // (2 * r.size)}
    library, pieces, sequences = Tokenizer.from_file(tokenizer_path()), {}, {}
    for r in cp.run(spark, sf).collect():
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    expected = {}
    for i, copies in want.items():
        ids = np.array([*library.encode(rows[i].text, add_special_tokens=False).ids, 0], "<u4")
        own = [(k // CAPACITY, k, len(ids[k : k + CAPACITY]), zlib.crc32(ids[k : k + CAPACITY].tobytes())) for k in range(0, len(ids), CAPACITY)]
        expected[i] = sorted(own * copies)
    assert {i: sorted(p) for i, p in pieces.items()} == expected
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= CAPACITY


@pytest.mark.parametrize("table", ["odd", "none"])
def test_odd_tables(spark, request, table, no_labels, tmp_path):
    """Nulls, very long and repeated texts, clashing columns; and no rows at all."""
    df = request.getfixturevalue(table)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    no_labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = cp.run(spark, str(tmp_path)).collect()
    good = [r for r in quality_kept(df)]
    assert {r.doc_id for r in got} <= {r.doc_id for r in good} and bool(got) == bool(good)
    docs = df
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
        docs = stored(docs, "odd")
    texts = {r.text for r in good}
    assert {r.text for r in docs.collect()} == texts


def quality_kept(df):
    """Rows that the base rules keep, by their definition."""
    for r in df.collect():
        words = WORD.findall(r.text or "")
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        if len(words) >= 50 and 100 * len(inside) <= 50 * len(words):
            yield r
