"""Operator 9, language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.quality import held_out

BUCKETS = 1 << 12
#: Rows of each language that the fit takes, about, and rows of all languages together.
ROWS_PER_LANG, MAX_ROWS = 500, 32_000
#: Languages whose cut-offs (some 30 bytes each) are broadcast at most.
BROADCAST = 100_000
UNDETERMINED = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def subwords(text: str | None) -> np.ndarray:
    """Buckets of all two- and three-letter subwords of a text, with word edges; empty if it has no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[points]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    p = np.zeros(len(points) + 2, np.uint32)
    p[1:-1] = np.where(is_letter, points, 0)
    some = p > 0
    two = p[:-1] * np.uint32(0x9E3779B1) ^ p[1:] * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(0xC2B2AE35) + p[2:] * np.uint32(0x165667B1)
    buckets = np.concatenate((two[some[:-1] | some[1:]], three[some[1:-1]]))
    return ((buckets ^ (buckets >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20)).astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    langs: list[str]
    logits: np.ndarray  # (BUCKETS, langs): embedding times output weights
    bias: np.ndarray
    least: float  # scores under it are rejected

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language and its probability; und and 0 for a text without letters."""
        names, scores = [], np.zeros(len(texts))
        for k, text in enumerate(texts):
            grams = subwords(text)
            if not len(grams) or not self.langs:
                names.append(UNDETERMINED)
                continue
            z = np.bincount(grams, minlength=BUCKETS) @ self.logits / len(grams) + self.bias
            e = np.exp(z - z.max())
            names.append(self.langs[int(z.argmax())])
            scores[k] = e.max() / e.sum()
        return names, scores


def train(x: Sample, langs: list[str], dim: int = 16, epochs: int = 25, rate: float = 40.0, keep: float = 0.995, seed: int = 5) -> LanguageModel:
    """Fit by SGD on rows of subword shares.

    Every tenth row of a language only sets the rejection, so that each language is fitted, at the order statistic that leaves a share of keep or more of rightly named rows accepted, in
    expectation; where these rows are too few for that, none is rejected.
    """
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 0.0)
    y = np.searchsorted(names, langs)
    rng = np.random.default_rng(seed)
    inner = rng.normal(0, 0.3, (BUCKETS, dim)).astype(np.float32)
    outer, bias = rng.normal(0, 0.3, (dim, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    order = np.argsort(y, kind="stable")
    place = np.empty(len(y), np.int64)
    place[order] = np.arange(len(y)) - np.searchsorted(y[order], y[order])
    check = place % 10 == 9
    rows = np.flatnonzero(~check)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in np.array_split(rng.permutation(rows), max(1, len(rows) // 32)):
            own = x.dense(at)
            mean = own @ inner
            z = mean @ outer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            p /= len(at)
            back = p @ outer.T
            outer -= 0.05 * step * mean.T @ p
            bias -= 0.002 * step * p.sum(0)
            inner -= step * own.T @ back
    logits = inner @ outer
    z = np.concatenate([x.dense(at) @ logits + bias for at in np.array_split(np.flatnonzero(check), check.sum() // 256 + 1)])
    p = np.exp(z - z.max(1, keepdims=True)) if len(z) else np.ones((0, 1))
    top = (p.max(1) / p.sum(1))[z.argmax(1) == y[check]] if len(z) else np.zeros(0)
    place = int((1 - keep) * (len(top) + 1))
    return LanguageModel(names, logits, bias, float(np.sort(top)[place - 1]) if place else 0.0)


@dataclass(frozen=True)
class Sample:
    """Rows of subword shares, sparse: row k has buckets and shares from ends[k - 1] to ends[k]."""

    bucket: np.ndarray
    share: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, counts: list[tuple[np.ndarray, np.ndarray]]) -> Sample:
        """From (buckets, how often each) of every row."""
        whole = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts]).astype(kind)
        return cls(whole([b for b, _ in counts], np.int64), whole([np.asarray(n) / np.sum(n) for _, n in counts], np.float32), np.cumsum([len(b) for b, _ in counts], dtype=np.int64))

    def dense(self, rows: np.ndarray) -> np.ndarray:
        """Some rows as a matrix over all buckets."""
        out = np.zeros((len(rows), BUCKETS), np.float32)
        begin = np.append(0, self.ends)
        for k, r in enumerate(rows.tolist()):
            part = slice(begin[r], begin[r + 1])
            out[k, self.bucket[part]] = self.share[part]
        return out


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows_per_lang: int, max_rows: int) -> tuple[Sample, list[str]]:
    """Subword shares and languages of about rows_per_lang rows of each language, fewer where all of them would pass max_rows.

    A row is in if the hash of its id is under its language's cut-off, or the least of the language; so no task sees a
    whole language.  The cut-offs are a number for each language, counted before they are broadcast; beyond BROADCAST languages they are joined by a shuffle.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("id is not null and lang is not null")
    h = F.shiftrightunsigned(F.xxhash64("id"), 1)
    found = slim.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(h).alias("least")).collect()
    each = max(1, min(rows_per_lang, max_rows // max(1, len(found))))
    cuts = [(r.lang, 2**63 - 1 if r.n <= each else max(r.least, int(each / r.n * 2**63))) for r in found]
    limits = slim.sparkSession.createDataFrame(cuts, "lang string, cut long")
    texts = slim.withColumn("h", h).join(F.broadcast(limits) if len(cuts) <= BROADCAST else limits, "lang").where("h <= cut").select("lang", "h", "text")

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [np.unique(subwords(t), return_counts=True) for t in batch["text"]]
            yield pd.DataFrame({"lang": batch["lang"], "h": batch["h"], "bucket": [f[0].astype(np.int32) for f in found], "n": [f[1].astype(np.int32) for f in found]})

    got = texts.mapInPandas(shares, "lang string, h long, bucket array<int>, n array<int>").where(F.size("bucket") > 0)
    got = got.orderBy("h", "lang", "bucket", "n").limit(2 * max(max_rows, len(found))).collect()
    return Sample.of([(np.array(r.bucket), np.array(r.n)) for r in got]), [r.lang for r in got]


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, part: int = 2, rows_per_lang: int = ROWS_PER_LANG, max_rows: int = MAX_ROWS) -> DataFrame:
    """Language of every whole text: id, held_out, lang_pred, score, accepted.

    Learns from text and language of a bounded sample of rows whose crc32(id) mod parts is not part.  lang_pred
    is und (score 0) where a text is null, empty or without letters, and everywhere if nothing could be
    learned; else the likeliest learned language, of all that the rows name.  accepted is false where the score is under the calibrated
    limit.  Null ids are predicted, never learned from; repeated rows are predicted alike; equally likely languages go by code point;
    an empty table gives an empty result; texts are read whole, however long, and other columns not at all, whatever their names.
    """
    model = train(*_sample(docs.where(~held_out(id_col, parts, part)), id_col, text_col, lang_col, rows_per_lang, max_rows))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = model.predict(batch["text"].tolist())
            yield pd.DataFrame({"id": batch["id"], "lang_pred": names, "score": scores, "accepted": (scores >= model.least) & (np.array(names, object) != UNDETERMINED)})

    out = slim.mapInPandas(rows, f"id {slim.schema['id'].dataType.simpleString()}, lang_pred string, score double, accepted boolean")
    return out.select(F.col("id").alias(id_col), held_out("id", parts, part).alias("held_out"), "lang_pred", "score", "accepted")
