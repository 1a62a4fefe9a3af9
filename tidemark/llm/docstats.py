"""Statistics of a whole text, for quality rules and classifiers: exact counts, and shares made from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counts that the base rules use.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Inputs of the models, all between 0 and 1 but for the logarithms and means.
FEATURES = [
    "log_words", "mean_word", "symbols", "worst_symbols", "bangs", "worst_bangs", "capitals", "worst_capitals", "digits", "marks", "high_bytes",
    "lines", "dup_lines", "repeats", "distinct", "doubled", "longest_run", "alphabetic",
]
SYMBOLS = b"#*$%&|<>"
#: Bytes in a window whose worst share counts, so that a bad passage in a long text still shows.
WINDOW = 1024

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_KIND = np.zeros((256, 3), np.float32)  # symbols, bangs, capitals
_KIND[list(SYMBOLS), 0] = 1
_KIND[ord("!"), 1] = 1
_KIND[65:91, 2] = 1


def repeat_words(codes: np.ndarray, distinct: int) -> int:
    """Words that lie in a window of three words which the text holds twice or more."""
    if len(codes) < 4:
        return 0
    key = codes[:-2] * distinct + codes[1:-1]
    if distinct >= 1 << 20:
        key = np.unique(key, return_inverse=True)[1].astype(np.int64)
    key = key * distinct + codes[2:]
    order = np.argsort(key)
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(codes), bool)
    again[order[same[1:] | same[:-1]]] = True
    covered = again.copy()
    covered[1:] |= again[:-1]
    covered[2:] |= again[:-2]
    return int(covered.sum())


def text_stats(text: str | None) -> list[float]:
    """COUNTS, then FEATURES of a text; null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # splits at ASCII white space only
    n = len(words)
    if not n:
        return [0.0] * (len(COUNTS) + len(FEATURES))
    of: dict[bytes, int] = {}
    codes = np.fromiter((of.setdefault(w, len(of)) for w in words), np.int64, n)
    data = np.frombuffer(raw, np.uint8)
    hist = np.bincount(data, minlength=256)
    spaces, size = int(hist[_SPACE].sum()), len(raw)
    symbols = int(hist[list(SYMBOLS)].sum())
    seen: set[bytes] = set()
    full = dup = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            full += 1
            dup += line in seen
            seen.add(line)
    repeats = repeat_words(codes, len(of))
    per = np.add.reduceat(_KIND[data], range(0, size, WINDOW), axis=0) / min(size, WINDOW)
    worst = per.max(0)
    equal = codes[1:] == codes[:-1]
    breaks = np.flatnonzero(np.concatenate(([True], ~equal, [True])))
    letters = int(hist[65:91].sum() + hist[97:123].sum() + hist[128:].sum())
    ink = size - spaces
    return [
        n, len(text) - spaces, symbols, dup, repeats,
        np.log1p(n), ink / n, symbols / ink, worst[0], hist[33] / ink, worst[1], hist[65:91].sum() / ink, worst[2], hist[48:58].sum() / ink,
        hist[[44, 46, 58, 59, 63]].sum() / ink, hist[128:].sum() / ink, full / n, dup / max(full, 1), repeats / n, len(of) / n, equal.mean() if n > 1 else 0.0,
        np.diff(breaks).max() / n, letters / ink,
    ]


def with_stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, the COUNTS as longs and features as one array, for every row of docs."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            stats = np.array([text_stats(t) for t in batch["text"]], np.float64).reshape(len(batch), -1)
            out = pd.DataFrame({"id": batch["id"], **{c: stats[:, k].astype(np.int64) for k, c in enumerate(COUNTS)}})
            out["features"] = list(stats[:, len(COUNTS) :].astype(np.float32))
            yield out

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = f"id {slim.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS)
    return slim.mapInPandas(rows, f"{kinds}, features array<float>")
