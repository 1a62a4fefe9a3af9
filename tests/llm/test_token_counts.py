"""Operator 13 against the tokenizers library."""

import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import merges, queries, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
COUNTER = token_counts.counter(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("abcXYZ ,.'sdlt\n\t\r\x1c\xa0\u0085<|>019é́İΣ=-日")), st.characters(exclude_categories=("Cs",))), max_size=40))
def test_any_text(text):
    from tokenizers import Tokenizer

    assert COUNTER.count([text]) == [len(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids)]


def test_odd_texts(library):
    rng = random.Random(1)
    parts = ["a", "b", "é", " ", "  ", "\n", "'s", "'ll", "12", "½", "!", "--", "<|endoftext|>", "<|", "日本", "\u0085", "\x1c", "😀", "👍🏽", "́", "՘", "\U00010940", "\x00", "aaaa", " the", "=="]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(5_000)]
    texts += ["a" * 5001, " " * 3000 + "x", "ab" * 4000, "日" * 3000, "".join(rng.choice("abcdefghij") for _ in range(20_000)), "<|endoftext|>" * 3]
    assert COUNTER.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_long_texts_in_steps(library, monkeypatch):
    """A text over the limits is cut in steps, and memory makes room."""
    for name, value in (("CUT", 500), ("STEP", 7), ("MERGED", 64), ("REMEMBERED", 20)):
        monkeypatch.setattr(token_counts, name, value)
    rng = random.Random(2)
    texts = ["".join(rng.choice(["word ", "and ", "x1 ", "<|endoftext|>", "\n\n", "éé "]) for _ in range(n)) for n in (900, 3, 0, 700, 40, 41)]
    assert token_counts.TokenCounter(PATH).count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_query(spark, tiny, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = queries.op13_token_counts(spark, tiny).collect()
    assert len(got) == len(docs)
    for r in got:
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 512)


@pytest.mark.parametrize("table", ["odd", "none"])
def test_odd_rows(request, table, library):
    df = request.getfixturevalue(table)
    got = sorted((tuple(r) for r in token_counts.token_counts(df, PATH, 512).collect()), key=repr)
    want = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect()]
    assert got == sorted(((*w, w[2] > 512) for w in want), key=repr)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="plain byte-level"):
        token_counts.TokenCounter(public_tokenizers.path("word_bpe_49k.json"))
    letters = merges.byte_letters()
    vocab = {x: k for k, x in enumerate(letters.values())} | {"ab": 256, "abc": 257, "bc": 258}
    with pytest.raises(ValueError, match="out of turn"):
        merges.MergeTable({"type": "BPE", "vocab": vocab, "merges": ["a bc", "b c"]})
