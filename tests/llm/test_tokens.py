import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing, token_coder, token_files, tokens
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.shared import shared_dir

CODER = tokens.coder(tokenizer_path())


def library(text):
    return np.array(CODER.tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcXYZ ,.'\n\t\x1c\xa0<|>0é́İΣ"), st.characters(exclude_categories=("Cs",))), max_size=40))
def test_words_encode_like_the_library(text):
    assert CODER.encode(text) == library(text)


def encoded(texts):
    """Ids of each text by encode_many, without the end id."""
    got = []
    for _, ids, ends in CODER.encode_many(pa.array(texts, pa.string()), 7):
        got += [p[:-1].tobytes() for p in np.split(ids, ends[:-1])]
    return got


def test_every_letter_before_every_mark():
    """Letters that normalise to a letter and a combining mark included; both ways of encoding."""
    letters = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000 and chr(k).isalpha()]
    changed = [x for x in letters if unicodedata.normalize("NFC", x).lower() != x]
    words = [f"a{x}," for x in letters] + [f"a{x}{chr(m)}" for x in changed for m in tokens.MARKS] + [f"{x}." for x in letters] + ["EDİLDİ.", "EDİLDİ.) x", "ড়. ঢ়,"]
    want = [np.array(e.ids, "<u4").tobytes() for e in CODER.tokenizer.encode_batch(words, add_special_tokens=False)]
    assert encoded(words) == want
    assert [CODER.encode(w) for w in words[::7] + words[-3:]] == want[::7] + want[-3:]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcßéñøXYZ ,.'-)!\n\t\x1c\xa0<|>0é́İΣড়"), st.characters(exclude_categories=("Cs",))), max_size=30), max_size=5))
def test_many_encode_like_the_library(texts):
    assert encoded(texts) == [library(t) for t in texts]


def test_known_words_make_room(docs, monkeypatch):
    """Few words are kept, over many slices: the same ids."""
    texts = [r.text or "" for r in docs.collect()]
    want = encoded(texts)
    monkeypatch.setattr(tokens, "KNOWN", 300)
    monkeypatch.setattr(tokens, "SLICE", 4_000)
    assert encoded(texts) == want == [library(t) for t in texts]
    assert len(CODER.known.words) <= 300 + 4_000


@pytest.mark.parametrize("size", [1 << 24, 40])
def test_documents_encode_like_the_library(docs, odd, monkeypatch, size):
    assert CODER.memory.direct
    monkeypatch.setattr(tokens, "SLICE", size)
    monkeypatch.setattr(tokens, "GATHER", size)
    for df in (docs, odd):
        texts = [r.text for r in df.collect()]
        want = [library(t) for t in texts]
        assert [CODER.encode(t) for t in texts] == want
        for whole in (pa.array([None, *texts])[1:], pa.array(texts[:0], pa.string())):
            got = []
            for at, ids, ends in CODER.encode_many(whole, 7):
                assert at == len(got)
                got += [p.tobytes() for p in np.split(ids, ends[:-1])]
            assert got == [w + b"\7\0\0\0" for w in want[: len(whole)]]


@pytest.mark.parametrize("n", [0, 1, 2, 2047, 2048, 2049, 6000])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 1 << 17, n), rng.integers(0, 1 << 32, n), rng.integers(0, 30_000, 40 * n), rng.zipf(1.4, n) % 49408, np.zeros(n), np.arange(n) % 3):
        ids = ids.astype("<u4")
        assert (token_coder.decode(token_coder.encode(ids)) == ids).all()


def test_damage_shows():
    data = bytearray(token_coder.encode(np.arange(5000, dtype="<u4") % 700))
    for at in (0, 5, 30, len(data) // 2, len(data) - 9):
        bad = data.copy()
        bad[at] ^= 64
        with pytest.raises(ValueError):
            token_coder.decode(bytes(bad))
    with pytest.raises(ValueError):
        token_coder.decode(bytes(data[:-2]))


def test_blocks_do_not_depend_on_each_other():
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.3, 5 * token_coder.BLOCK) % 900).astype("<u4")
    data = bytearray(token_coder.encode(ids))
    data[-20] ^= 1  # in the last block
    with pytest.raises(ValueError, match="block 4"):
        token_coder.decode(bytes(data))


def test_coding_pays():
    """Repeated passages, and the ids of documents: under zlib's size for the same blocks and under the entropy of single ids."""
    ids = np.tile(np.arange(300), 40)
    assert len(token_coder.encode(ids)) < len(ids) / 4
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id")["text"].combine_chunks()
    ids = np.concatenate([ids for _, ids, _ in CODER.encode_many(texts, 1)])
    blocks = [ids[at : at + token_coder.BLOCK].astype("<u2") for at in range(0, len(ids), token_coder.BLOCK)]
    share = np.bincount(ids) / len(ids)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum() / 8
    size = len(token_coder.encode(ids)) / len(ids)
    assert size < 0.75 * sum(len(zlib.compress(b.tobytes(), 9)) for b in blocks) / len(ids)
    assert size < 0.95 * entropy


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
@pytest.mark.parametrize("segment", [4_000_000, 1000])
def test_token_files(request, spark, monkeypatch, table, segment):
    monkeypatch.setattr(token_files, "SEGMENT", segment)
    df = request.getfixturevalue(table)
    path = f"{shared_dir(spark)}/files-{table}-{segment}"
    token_files.write_tokens(df, path, tokenizer_path())
    got = token_files.read_digests(spark, path).collect()
    rows = sorted(((r.doc_id, library(r.text) + b"\1\0\0\0") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((i is not None, i or 0, len(d) // 4, zlib.crc32(d)) for i, d in rows)
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == np.cumsum([0] + [r.n_tokens for r in order])[:-1].tolist()
    assert [r.doc_id for r in order] == [i for i, _ in rows]
    full = token_files.read_tokens(spark, path).collect()
    assert sum(len(r.tokens) for r in full) == sum(len(d) // 4 for _, d in rows)


@pytest.mark.parametrize("table", ["docs", "odd", "none"])
@pytest.mark.parametrize("capacity", [2048, 64])
def test_pack(request, table, capacity):
    df = request.getfixturevalue(table)
    got = packing.pack(df, capacity, tokenizer_path()).collect()
    want = []
    for r in df.collect():
        ids = library(r.text) + bytes(4)
        for k, at in enumerate(range(0, len(ids), 4 * capacity)):
            part = ids[at : at + 4 * capacity]
            want.append((r.doc_id or -1, k, at // 4, len(part) // 4, zlib.crc32(part)))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(w[3] for w in want)
    assert len(places) <= max(1.01 * -(-total // capacity) + 1, sum(2 * w[3] > capacity for w in want)) or not want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200))
def test_plan(lengths):
    counts = np.bincount(lengths, minlength=41) if lengths else np.zeros(41, int)
    rows = packing.plan(counts, 40)
    assert (rows.groupby("length").n.sum().reindex(range(41), fill_value=0).to_numpy() == counts).all()
    full = defaultdict(int)
    for r in rows.itertuples():
        for k in range(r.n):
            full[r.sequence + k] += r.length
    assert all(v <= 40 for v in full.values())
    assert len(full) <= max(1.3 * -(-sum(lengths) // 40) + 2, sum(2 * v > 40 for v in lengths))


def test_least_squares_fits():
    rng = np.random.default_rng(0)
    counts = np.zeros(65, np.int64)
    sets = packing.patterns(np.arange(1, 64), 64)
    for k in rng.integers(0, len(sets), 3000):
        for v in sets[k]:
            counts[v] += v > 0
    x = packing.least_squares(sets, counts, 400)
    made = np.bincount(sets.ravel(), np.repeat(x, 3), 65)
    made[0] = 0
    assert (x >= 0).all() and np.abs(made - counts).sum() < 0.1 * counts.sum()
