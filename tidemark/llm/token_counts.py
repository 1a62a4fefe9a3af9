"""Operator 13, token counts: byte-pair merging of ragged arrays, each sequence by its lowest rank at a time."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.merges import MergeTable
from tidemark.llm.shared import fresh

#: Fixed value: how byte-level tokenizers cut a text into pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose counts a worker remembers, from before and since it last made room, each; the longest of them.
REMEMBERED, LONGEST = 300_000, 48
#: Bytes of pre-tokens that are merged together; characters of text that are cut together; pre-tokens of a longer text at a time.
MERGED, CUT, STEP = 1 << 21, 1 << 22, 200_000


def _model(path: str) -> tuple[MergeTable, list[str]]:
    """The merges and the special strings of a tokenizer file; raises ValueError where it is no byte-level BPE without a normaliser."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"] or {}
    added = all(not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in spec["added_tokens"])
    if not (added and not spec["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]):
        raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
    return MergeTable(spec["model"]), sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)


class TokenCounter:
    """Counts tokens of texts as the tokenizers library does, special strings inside a text included."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        (self.table, specials), self.cut = _model(path), regex.compile(PRE_TOKEN)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.known: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.seen, self.odd = set(map(chr, range(128))), set()

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; runs of about CUT characters are cut and merged together, a longer text goes alone, in steps."""
        out, run, held = [], [], 0
        for t in texts:
            if run and held + len(t) > CUT:
                out += self._run(run)
                run, held = [], 0
            run.append(t)
            held += len(t)
        return out + (self._run(run) if run else [])

    def _run(self, texts: list[str]) -> list[int]:
        self._learn(texts)
        if len(texts) == 1 and len(texts[0]) > CUT:
            total = 0
            for part, extra in self._parts(texts[0]):
                total += extra
                pieces = self._pieces(part)
                while step := list(islice(pieces, STEP)):
                    total += sum(map(self._counts(step).__getitem__, step))
            return [total]
        parts = [list(self._parts(t)) for t in texts]
        pieces = [list(chain.from_iterable(self._pieces(p) for p, _ in of)) for of in parts]
        counts = self._counts(chain.from_iterable(pieces))
        return [sum(map(counts.__getitem__, own)) + sum(extra for _, extra in of) for own, of in zip(pieces, parts, strict=True)]

    def _parts(self, text: str) -> Iterator[tuple[str, int]]:
        """What stands between special strings, and 1 for the special string after it."""
        begin = 0
        for m in self.special.finditer(text) if self.special else ():
            yield text[begin : m.start()], 1
            begin = m.end()
        yield (text[begin:] if begin else text), 0

    def _pieces(self, text: str) -> Iterator[str]:
        if self.odd and not self.odd.isdisjoint(text):
            return (text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text))
        return iter(self.cut.findall(text)) if len(text) <= CUT else (m.group() for m in self.cut.finditer(text))

    def _learn(self, texts: list[str]) -> None:
        """Find characters that the library takes for another class than the pattern here does (it may know another Unicode)."""
        for c in set().union(*texts) - self.seen:
            self.seen.add(c)
            for s in (f"a{c}", f"1{c}", f"!{c}", f"\n{c}a"):
                if [o for _, o in self.library.pre_tokenize_str(s)] != [m.span() for m in self.cut.finditer(s)]:
                    self.odd.add(c)
                    break

    def _counts(self, pieces: Iterable[str]) -> dict[str, int]:
        """Counts of all these pieces (and others); pieces that are not remembered are merged once each."""
        wanted = set(pieces)
        found = {}
        for p in wanted:
            if (n := self.known.get(p)) is None:
                n = self.old.get(p)
            found[p] = n
        new = [p for p, n in found.items() if n is None]
        new.sort(key=len)
        while new:
            size, run = 0, []
            while new and (not run or size + len(new[-1]) < MERGED):
                run.append(new.pop())
                size += 4 * len(run[-1])
            raw = [p.encode("utf-8") for p in run]
            _, n = self.table.merged(np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw)))
            found.update(zip(run, n.tolist(), strict=True))
        if len(self.known) + len(found) > REMEMBERED:
            self.old, self.known = self.known, {}
        self.known.update((p, n) for p, n in found.items() if len(p) <= LONGEST)
        return found


@cache
def counter(path: str) -> TokenCounter:
    """The worker's counter for a tokenizer file."""
    return TokenCounter(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    tokenizer is a file of a byte-level BPE of the tokenizers library; another kind raises ValueError.  Counts are those of the library
    without added tokens, special strings in a text counting as their one token.  Null and empty texts have 0 bytes and tokens; very long
    texts are cut and merged in steps of bounded size; repeated rows and null ids each give their row; an empty table gives an empty
    result; other columns of docs, whatever their names, are not read.  Nothing is shuffled.
    """
    (size,) = fresh(docs.select(id_col), "n_bytes")
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    slim = slim.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    out = slim.select("id", "n_bytes").sparkSession.createDataFrame([], f"id {slim.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long").schema
    schema = to_arrow_schema(out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = counter(tokenizer).count(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["id"].cast(schema.field("id").type), batch["n_bytes"].cast(pa.int64()), pa.array(n, pa.int64())], schema=schema)

    counted = slim.mapInArrow(count, out)
    return counted.select(F.col("id").alias(id_col), F.col("n_bytes").alias(size), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
