"""Operators 2 and 10: a quality classifier and quality rules, both boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import boosting
from tidemark.llm.docstats import COUNTS, FEATURES, text_stats, with_stats
from tidemark.llm.shared import fresh, stored

#: Labelled rows that a model is fitted on, at most (those with the smallest hash of their id).
MAX_TRAIN_ROWS = 8_000
#: Directions in which the rules' score may move as a feature grows.
FALLING = ["symbols", "worst_symbols", "bangs", "worst_bangs", "capitals", "worst_capitals", "dup_lines", "repeats", "doubled", "longest_run"]
MONOTONE = {FEATURES.index(c): -1 for c in FALLING}


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls into the part that no model learns from; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def _sample(labels: DataFrame, id_col: str, label_col: str, max_rows: int) -> DataFrame:
    """id and label of at most max_rows labelled ids; of several labels of an id the smallest counts."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).dropna().groupBy("id").agg(F.min("label").alias("label"))
    return known.orderBy(F.xxhash64("id"), "id").limit(max_rows)


def _fit(stats: DataFrame, sample: DataFrame, max_rows: int, monotone: dict[int, int] | None) -> boosting.Trees:
    """Fit on the features of the sampled ids, at most max_rows rows of len(FEATURES) floats on the driver."""
    rows = stats.select("id", "features").join(F.broadcast(sample), "id").select("id", "features", "label")
    got = rows.orderBy(F.xxhash64("id"), "id", "features").limit(max_rows).toPandas()
    x = np.array(got["features"].tolist(), np.float32).reshape(len(got), len(FEATURES))
    return boosting.fit(x, got["label"].to_numpy(float), monotone=monotone)


def _scored(stats: DataFrame, trees: boosting.Trees) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch.pop("features").tolist(), np.float32).reshape(len(batch), len(FEATURES))
            yield batch.assign(score=trees.score(x))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema if f.name != "features")
    return stats.mapInPandas(rows, f"{kinds}, score double")


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", parts: int = 3, part: int = 1, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Score every text: id, held_out, score (0 to 1; higher: label 1 likelier), predicted (score >= 0.5).

    Texts are read once; their statistics go to the shared folder.  Rows whose crc32(id) mod parts is part are
    held out of the fit.  Null and empty texts have statistics of 0 and a score; a null id is scored, never
    learned from; without labels of both kinds every score is the prior; repeated rows are scored alike; very long texts are read whole; an
    empty table gives an empty result; other columns, whatever their names, are not read.
    """
    stats = stored(with_stats(docs, id_col, text_col).select("id", "features"), "quality-stats")
    sample = _sample(labels.where(~held_out(id_col, parts, part)), id_col, label_col, max_train_rows)
    scored = _scored(stats, _fit(stats, sample, max_train_rows, None))
    return scored.select(F.col("id").alias(id_col), held_out("id", parts, part).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def base_failed() -> Column:
    """The base rules: under 50 words, or over half of the words in repeated three-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train_rows: int = MAX_TRAIN_ROWS) -> boosting.Trees:
    """Fit the rules' trees on texts of at most max_train_rows labelled rows.  FALLING features only lower a score."""
    sample = _sample(labels, id_col, label_col, max_train_rows)
    texts = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias(text_col)).join(F.broadcast(sample.select(F.col("id").alias(id_col))), id_col, "left_semi")
    return _fit(with_stats(texts, id_col, text_col), sample, max_train_rows, MONOTONE)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train_rows: int = MAX_TRAIN_ROWS, least_score: float = 0.5) -> DataFrame:
    """Judge every text: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    kept is false where a base rule fails, else whether the trees' score reaches least_score.  Null and
    empty texts have no words and fail; repeated rows are judged alike; very long texts are read whole; a null id is judged, never learned from; without
    labels of both kinds the trees keep all that the base rules keep (the prior is then set aside); an empty table gives an empty result; other
    columns, whatever their names, are not read.
    """
    trees = fit_rules(docs, labels, id_col, text_col, label_col, max_train_rows)
    verdict = F.lit(True) if not len(trees.leaf) else F.col("score") >= least_score
    scored = _scored(with_stats(docs, id_col, text_col), trees).withColumn("base_failed", base_failed())
    return scored.select(F.col("id").alias(id_col), *COUNTS, "base_failed", (~F.col("base_failed") & verdict).alias("kept"), "score")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train_rows: int = MAX_TRAIN_ROWS, least_score: float = 0.5) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns, whatever these are called; the texts are judged where they stand.

    Null and empty texts go; repeated rows stay or go together; very long texts are read whole; an empty table gives an empty result.
    """
    trees = fit_rules(docs, labels, id_col, text_col, label_col, max_train_rows)
    words, repeats = COUNTS.index("n_words"), COUNTS.index("n_repeat_words")

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        stats = np.array([text_stats(t) for t in texts], np.float64).reshape(len(texts), -1)
        ok = (stats[:, words] >= 50) & (100 * stats[:, repeats] <= 50 * stats[:, words])
        if len(trees.leaf):
            ok &= trees.score(stats[:, len(COUNTS) :].astype(np.float32)) >= least_score
        return pd.Series(ok)

    (name,) = fresh(docs, "qr_good")
    return docs.withColumn(name, good(F.col(text_col))).where(F.col(name)).drop(name)
