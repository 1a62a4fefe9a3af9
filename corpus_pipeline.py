"""A corpus from documents to packed sequences: filter, deduplicate, mix and pack.

Stages take (spark, docs, sf_dir); each result is written as Parquet in the shared folder and read again as the
docs of the next.  All but the last return the columns of documents, whatever these are called.

In every stage null texts count as empty, ids may be null or repeated, very long texts are read whole, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.exact_dedup import drop_exact
from tidemark.llm.mixing import mixed_rows
from tidemark.llm.packing import pack
from tidemark.llm.quality import keep_good
from tidemark.llm.queries import CAPACITY, WEIGHTS, tokenizer_path
from tidemark.llm.shared import stored
from tidemark.llm.simhash import drop_near


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, null and empty texts among them; the trees learn from the labels table.

    Repeated rows stay or go together.  Without labels of both kinds only the base rules judge.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays, one without an id only where none has one.

    Of rows that tie in text and id the one with the least hash of its other columns stays; null and empty texts are one group.
    """
    return drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the smallest doc_id stays, one without an id only where none has one.

    SimHash proposes links through the byte-position inverted index with count filtering, as in op5.  Pairs near the limit can share too few bytes
    for any index of them, so texts that share one of their least common shingles are candidates too, which misses no pair; only an exact comparison
    links.  Texts without words are one group; of rows with one id in a group any one stays.
    """
    return drop_near(docs, plain_table=True)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: whole, repeated up to 3 times, left out where it takes none.

    Texts without words do not come; a null source is one of its own; repeated rows are taken each.
    """
    return mixed_rows(docs, WEIGHTS, plain_table=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the packed sequences; null and empty texts are a piece of the end id, repeated rows are packed each."""
    return pack(docs, CAPACITY, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Fitted trees, SimHash and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
