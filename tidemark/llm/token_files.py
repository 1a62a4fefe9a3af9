"""Operator 8, token-id output: documents as coded ids in segment files, in ascending order of their ids."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm import token_coder
from tidemark.llm.shared import fresh
from tidemark.llm.tokens import coder

#: Ids that a segment gathers before it is coded; a longer document makes a longer segment.
SEGMENT = 8_000_000


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> None:
    """Encode every whole text, append end_id, and write the ids to path in ascending order of id_col.

    The files are Parquet, so that Spark's committer takes care of lost executors and any store will do.  A row is a
    segment: part and segment (its place in the order), tokens_before (ids before it in its part), the ids and lengths of
    its documents with a checksum, and payload, a container of independent coded blocks.  Rows are dealt by ranges of id before they
    are tokenized, so each text is encoded once and no task holds more than a range; rows of one id (or none) may be in several ranges.

    Null and empty texts are end_id alone; a very long text makes a longer segment.  Null ids come first; rows of the same id, equal or
    not, follow each other in any order; an empty table makes files without rows.  Other columns of docs, whatever their names, are not read.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, own, lengths, size, before, number = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            payload = token_coder.encode(np.concatenate(held))
            docs, n = pa.concat_arrays(own), np.concatenate(lengths)
            one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
            row = {"part": pa.array([part], pa.int32()), "segment": pa.array([number], pa.int32()), "tokens_before": pa.array([before]), "ids": one(docs), "lengths": one(pa.array(n, pa.int32())),
                   "check": pa.array([_check(docs.to_pylist(), n)]), "payload": pa.array([payload], pa.binary())}
            return pa.RecordBatch.from_arrays(list(row.values()), list(row))

        for batch in batches:
            for at, ids, ends in coder(tokenizer).encode_many(batch["text"], end_id):
                held.append(ids), own.append(batch["id"].slice(at, len(ends))), lengths.append(np.diff(ends, prepend=0))
                size += len(ids)
                if size >= SEGMENT:
                    yield flush()
                    held, own, lengths, size, before, number = [], [], [], 0, before + size, number + 1
        if held:
            yield flush()

    (tie,) = fresh(docs, "tie")
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias(tie))
    kind = slim.schema["id"].dataType.simpleString()
    ordered = slim.repartitionByRange("id", tie).sortWithinPartitions("id", tie).drop(tie)
    coded = ordered.mapInArrow(segments, f"part int, segment int, tokens_before long, ids array<{kind}>, lengths array<int>, check long, payload binary")
    coded.write.parquet(path)


def _check(ids: list, lengths: np.ndarray) -> int:
    """Checksum of a segment's document ids and lengths."""
    return zlib.crc32(np.ascontiguousarray(lengths, "<i4"), zlib.crc32(repr(ids).encode()))


def read_tokens(spark: SparkSession, path: str, id_name: str = "doc_id") -> DataFrame:
    """Documents of files that write_tokens wrote: id, start (ids of all documents before it), tokens (the ids).

    Every block's checksum is verified; a wrong one fails the read.
    """
    files = spark.read.parquet(path)
    return _located(files, _decoded(files, lambda ids: {"tokens": ids}, "tokens array<int>")).withColumnRenamed("id", id_name)


def read_digests(spark: SparkSession, path: str, id_name: str = "doc_id") -> DataFrame:
    """Like read_tokens, but with n_tokens and ids_crc32 (of the ids as little-endian 32-bit) in place of the ids."""
    files = spark.read.parquet(path)
    digests = _decoded(files, lambda ids: {"n_tokens": len(ids), "ids_crc32": zlib.crc32(ids)}, "n_tokens long, ids_crc32 long")
    return _located(files, digests).withColumnRenamed("id", id_name)


def _decoded(files: DataFrame, of: Callable[[np.ndarray], dict], kinds: str) -> DataFrame:
    kind = files.schema["ids"].dataType.elementType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, lengths = token_coder.decode(r["payload"]), np.array(r["lengths"], np.int64)
                ends = np.cumsum(lengths)
                if r["check"] != _check(r["ids"], lengths) or len(ids) != lengths.sum():
                    raise ValueError("a segment's document ids and lengths are damaged")
                got = [of(ids[e - n : e]) for n, e in zip(lengths.tolist(), ends.tolist(), strict=True)]
                columns = {"part": [r["part"]] * len(got), "within": r["tokens_before"] + ends - lengths, "id": r["ids"], **{c: [g[c] for g in got] for c in got[0]}}
                yield pa.RecordBatch.from_pydict(columns, schema)

    out = files.select("part", "tokens_before", "ids", "lengths", "check", "payload")
    names = f"part int, within long, id {kind}, {kinds}"
    schema = to_arrow_schema(out.sparkSession.createDataFrame([], names).schema)
    return out.mapInArrow(rows, names)


def _located(files: DataFrame, docs: DataFrame) -> DataFrame:
    """Add start: what stands in earlier parts, which is summed over the parts alone, and what stands before in the own."""
    sizes = files.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)).alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    names = [c for c in docs.columns if c not in ("part", "within", "id")]
    return docs.join(base, "part").select("id", (F.col("base") + F.col("within")).alias("start"), *names)
