"""Operator 7, exact dedup: group by a 128-bit content hash and compare the bytes inside each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, however long; null counts as empty.  The row with the smallest (keep="min") or
    largest ("max") id of a group stays; a row whose id is null stays only in a group without any other id.  Repeated
    rows with that same id each appear, exactly one of them as kept.  An empty table gives an empty result; other columns of docs are
    not read, whatever their names.

    The hash leads the key and spreads the shuffle; the text in the key is what compares the bytes.  Copies meet in the map-side
    aggregate, so that a hot group sends one row from each task.  Rows without their texts find their group by hash and SHA-256, where adaptive
    execution splits a hot one.  Everything is keyed by content, so a scan that is repeated on other executors changes nothing.
    """
    pick = F.max if keep == "max" else F.min
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("hash"), text.alias("text"))
    groups = rows.groupBy("hash", "text").agg(F.count(F.lit(1)).alias("group_size"), pick("id").alias("keep_id"))
    groups = groups.select("hash", F.sha2("text", 256).alias("sha"), "group_size", "keep_id")
    slim = rows.select("hash", F.sha2("text", 256).alias("sha"), "id").groupBy("hash", "sha", "id").agg(F.count(F.lit(1)).alias("copies"))
    found = slim.join(groups, ["hash", "sha"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of docs that exact_groups marks as kept, with all their columns, whatever these are called.

    One aggregate over whole rows: each text crosses the network once, copies meet before that.  Null texts count as empty ones but stay null;
    of rows with equal text and id the one with the least hash of its columns stays; an empty table gives an empty result.
    """
    text, own = F.col(text_col), F.col(id_col)
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(text.isNull().alias("none"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)])
    hashed = F.xxhash64(text.isNull(), *[F.col(f"`{c}`") for c in others if "map<" not in docs.schema[c].dataType.simpleString()])
    key = F.struct(own.isNotNull() if keep == "max" else own.isNull(), own, hashed)
    full = F.coalesce(text, F.lit(""))
    best = docs.groupBy(F.unhex(F.md5(full)).alias("hash"), full.alias("full")).agg((F.max_by if keep == "max" else F.min_by)(row, key).alias("row"))
    back = {c: F.col(f"row.c{k}") for k, c in enumerate(others)} | {text_col: F.when(~F.col("row.none"), F.col("full"))}
    return best.select(*[back[c].alias(c) for c in docs.columns])
