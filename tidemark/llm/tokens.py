"""Token ids of whole texts by the tokenizers library: each distinct word of a batch is encoded once, with a bounded memory of words."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.merges import MergeTable, byte_letters

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words of lower-case letters up to U+024F: these are in normal form and have no lower case of their own.
SIMPLE = "^[a-z" + "".join(chr(c) for c in range(128, 0x250) if chr(c).isalpha() and chr(c).lower() == chr(c)) + "]+$"
#: Words that a worker encodes one by one and remembers, from before and since it last made room, each; the longest that are remembered.
WORDS, LONGEST = 50_000, 32
#: Words whose ids are kept in arrays; new words that are merged together.
KNOWN, MERGED = 1_000_000, 32_768
#: Marks that are cut off the end of a word; an apostrophe can belong to letters.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words whose ids are gathered at a time.
GATHER = 1 << 17
#: Bytes of text that are split into words at a time; a longer text goes alone.
SLICE = 1 << 24


def _ends_in_letter(word: str) -> bool:
    """Whether the word still ends in a letter when the tokenizer has normalised it: some letters become a letter and a combining mark."""
    return word[-1].isalpha() and (word[-1].isascii() or unicodedata.normalize("NFC", word[-1]).lower()[-1].isalpha())


class _Memory(dict):
    """Word (bytes) -> its ids as little-endian 32-bit integers."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer, self.model, self.letters = tokenizer, tokenizer.model, byte_letters()
        self.old: dict[bytes, bytes] = {}
        # Words of letters are one piece to a byte-level tokenizer; then its model alone gives the ids, faster.
        self.direct = True
        self.direct = all(self.by_model(w) == self.by_library(w) for w in ("a", "the", "zebra", "qxqz", "déjà", "straße", "ñandú", "çéèêñßüöä"))

    def by_library(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def by_model(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode("utf-8").decode("latin-1").translate(self.letters)
        return b"".join([p.id.to_bytes(4, "little") for p in self.model.tokenize(word)])

    def ids(self, word: str) -> bytes:
        # Up to U+024F lower-case letters are in normal form and have no lower case of their own.
        simple = self.direct and word.isalpha() and (word.isascii() or word == word.lower() and max(word) < "ɐ")
        return self.by_model(word) if simple else self.by_library(word)

    def __missing__(self, word: bytes) -> bytes:
        if not word:
            return b""
        if (ids := self.old.get(word)) is not None:
            pass
        elif len(letters := word.rstrip(MARKS)) < len(word) and letters and _ends_in_letter(letters.decode("utf-8")):
            return self[letters] + self[word[len(letters) :]]  # a letter and a mark never share a token
        else:
            ids = self.ids(word.decode("utf-8"))
        if len(word) <= LONGEST:
            if len(self) >= WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class _Known:
    """Words and their ids in arrays: little memory for many, looked up all at once; words of letters are also merged all at once."""

    def __init__(self, ids: Callable[[bytes], bytes], table: MergeTable | None) -> None:
        self.ids, self.table = ids, table
        self.words, self.size, self.pool = pa.array([], pa.large_binary()), np.zeros(0, np.int32), np.zeros(0, "<u4")
        self.used = np.zeros(0, bool)

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For different words: numbers of their entries, and the sizes and begins in pool of all entries."""
        at = pc.index_in(words, value_set=self.words)
        if at.null_count:
            new = words.filter(at.is_null())
            at = at.to_numpy(zero_copy_only=False)
            at[np.isnan(at)] = len(self.words) + np.arange(len(new))
            size, pool = self._encoded(new)
            self.words = pa.concat_arrays([self.words, new])
            self.size, self.pool = np.concatenate((self.size, size.astype(np.int32))), np.concatenate((self.pool, pool))
            self.used = np.concatenate((self.used, np.ones(len(new), bool)))
        else:
            at = at.to_numpy()
        at = at.astype(np.int64)
        self.used[at] = True
        return at, self.size, np.cumsum(self.size, dtype=np.int64) - self.size

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids one after the other: those of its letters, then those of the marks after them."""
        stems = pc.utf8_rtrim(words.cast(pa.large_string()), characters=MARKS.decode())
        simple = pc.match_substring_regex(stems, SIMPLE).to_numpy(zero_copy_only=False) & (self.table is not None)
        stems = stems.cast(pa.large_binary()).filter(pa.array(simple)).dictionary_encode()
        raw, length = stems.dictionary.to_pylist(), pc.binary_length(stems.dictionary).to_numpy()
        pools, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for k in range(0, len(raw), MERGED):
            pool, n = self.table.merged(np.frombuffer(b"".join(raw[k : k + MERGED]), np.uint8), length[k : k + MERGED])
            pools.append(pool.astype("<u4"))
            sizes.append(n)
        # Tails of the simple words, and all others whole, by the library.
        head, tail = np.full(len(words), -1), np.full(len(words), -1)
        head[simple] = stems.indices.to_numpy()
        cut = np.zeros(len(words), np.int64)
        cut[simple] = length[head[simple]]
        rest = np.flatnonzero(cut < pc.binary_length(words).to_numpy())
        tails = [w[k:] for w, k in zip(words.take(pa.array(rest)).to_pylist(), cut[rest].tolist(), strict=True)]
        number = {t: k for k, t in enumerate(dict.fromkeys(tails))}
        found = [self.ids(t) for t in number]
        tail[rest] = np.fromiter(map(number.__getitem__, tails), np.int64, len(tails)) + len(raw)
        pools.append(np.frombuffer(b"".join(found), "<u4"))
        sizes.append(np.fromiter(map(len, found), np.int64, len(found)) // 4)
        pool, size = np.concatenate(pools), np.concatenate(sizes)
        parts = np.stack((head, tail), 1).ravel()
        parts = parts[parts >= 0]
        n, begin = size[parts], (np.cumsum(size) - size)[parts]
        out = pool[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        of = lambda part: np.where(part >= 0, size[part], 0) if len(size) else np.zeros(len(part), np.int64)
        return of(head) + of(tail), out

    def make_room(self) -> None:
        """Forget long words; where there are too many, those that were not met since room was last made, or else the oldest."""
        stay = pc.less_equal(pc.binary_length(self.words), LONGEST).to_numpy(zero_copy_only=False)
        full = np.count_nonzero(stay) > KNOWN
        if full:
            stay &= self.used
            stay[: max(0, len(stay) - KNOWN)] &= np.count_nonzero(stay) <= KNOWN // 2
        if not stay.all():
            self.pool = self.pool[np.repeat(stay, self.size)]
            self.words, self.size, self.used = self.words.filter(pa.array(stay)), self.size[stay], self.used[stay]
        if full:
            self.used[:] = False


class WordCoder:
    """Encodes as the library does, word by word.

    Only for tokenizers that lower-case, drop white space and never join letters over it: there the ids of
    a text are those of its words in turn, and ASCII letters may be lower-cased first.  Texts that could hold a special
    token's name go to the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memory = _Memory(self.tokenizer)
        self.known = _Known(self.memory.__getitem__, self._table(path) if self.memory.direct else None)

    def _table(self, path: str) -> MergeTable | None:
        """The model's merges, if they give its ids."""
        with open(path, encoding="utf-8") as f:
            try:
                table = MergeTable(json.load(f)["model"])
            except ValueError:
                return None
        words = ["a", "the", "zebra", "qxqz", "banana", "mississippi", "déjà", "straße", "ñandú", "çéèêñßüöä"]
        raw = [w.encode("utf-8") for w in words]
        ids, n = table.merged(np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw]))
        return table if ids.astype("<u4").tobytes() == b"".join(map(self.memory.by_model, words)) and n.all() else None

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if "<|" in text:
            return self.memory.by_library(text)
        return b"".join(map(self.memory.__getitem__, text.encode("utf-8").translate(LOWER).split()))

    def encode_many(self, texts: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Runs of texts of about SLICE bytes: number of the first text, ids of all, and where each text's ids end.

        Every text ends with end_id; a null counts as empty.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
            yield at, *self._run(texts[at:stop], end_id)
            at = stop
        pa.default_memory_pool().release_unused()  # workers are kept, and share an executor's memory with others

    def _run(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        special = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
        whole = {int(k): np.frombuffer(self.memory.by_library(texts[int(k)].as_py()), "<u4") for k in special}
        if whole:
            texts = pc.if_else(pc.match_substring(texts, "<|"), pa.scalar("", pa.large_string()), texts)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        last = np.asarray(lists.offsets)[1:] - lists.offsets[0].as_py()  # a slice's offsets need not begin with 0
        words = lists.flatten().cast(pa.large_binary()).dictionary_encode()
        del lists, texts
        entry, size, start = self.known.find(words.dictionary)
        pool = np.append(self.known.pool, np.uint32(end_id))
        size, start, entry = np.append(size, np.int32(1)), np.append(start, len(pool) - 1), np.append(entry, len(size))
        code = entry.take(np.insert(words.indices.to_numpy(), last, len(entry) - 1))
        self.known.make_room()
        del words, entry
        n = size.take(code)
        done = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
        ids = np.zeros(done[-1], "<u4")
        for k in range(0, len(code), GATHER):
            own, begin = n[k : k + GATHER], done[k]
            first = start.take(code[k : k + GATHER]) - done[k : k + len(own)] + begin
            part = ids[begin : done[k + len(own)]]
            part[:] = pool.take(np.repeat(first, own) + np.arange(len(part)))
        ends = done[last + np.arange(1, len(last) + 1)]
        if whole:
            parts = np.split(ids, ends[:-1])
            parts = [np.concatenate((whole[k], p)) if k in whole else p for k, p in enumerate(parts)]
            ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return ids, ends


@cache
def coder(path: str) -> WordCoder:
    """The worker's coder for a tokenizer file."""
    return WordCoder(path)
