"""Operator 6, sharding: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import ROWS_PER_CELL, bucket_bits, numbered, stored, top_bits

SEED = 20_240_601


def interleaved_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "source", seed: int = SEED) -> DataFrame:
    """Deal all rows of docs into n_shards so that every shard has the mixture of the whole.

    Rows are shuffled by a seeded hash and ranked within their stratum; (rank + 1/2) / rows of the stratum
    orders them all, and the order is cut into shards whose counts differ by one at most (law "rows").
    Returns id, size (UTF-8 bytes of the text plus 16), text_crc32, law, shard, slot, grown_shard (null under
    this law).  Null text: no bytes; a null stratum is one of its own; repeated rows each have a slot (which of
    two equal rows comes first is left open); equal texts are dealt like any others; a very long text counts as one row; an empty table gives an
    empty result; other columns, whatever their names, are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = stored(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(stratum_col).isNull().alias("none"),
            F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"),
            (F.octet_length(text).cast("long") + 16).alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
        ).withColumn("h", F.xxhash64(F.lit(seed), "id", "crc")),
        "shard-rows",
    )
    n = slim.count()
    slim = slim.withColumn("h_cell", top_bits(F.col("h"), bucket_bits(n)))
    ranked = numbered(slim, ["none", "stratum"], "h_cell", ["h", "id", "crc", "size"], "rank")
    rows = slim.groupBy("none", "stratum").agg(F.count(F.lit(1)).alias("stratum_rows"))
    cells = max(1, n // ROWS_PER_CELL)
    placed = (
        ranked.join(rows, ["none", "stratum"])
        .withColumn("part", (F.col("rank") + 0.5) / F.col("stratum_rows"))
        .withColumn("cell", F.least(F.floor(F.col("part") * cells), F.lit(cells - 1)))
        .withColumn("all", F.lit(0))
    )
    placed = numbered(placed, ["all"], "cell", ["part", "none", "stratum"], "place")
    shard = F.expr(f"place * {n_shards} div {max(n, 1)}")
    return placed.withColumn("shard_no", shard).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard_no").cast("int").alias("shard"),
        (F.col("place") - F.expr(f"(shard_no * {n} + {n_shards - 1}) div {n_shards}")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
