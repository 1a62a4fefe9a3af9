"""Helpers that several operators use: tables in the shared folder, and numbering rows without one big task."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one window partition should hold; hash buckets are made so small.
ROWS_PER_CELL = 8_000

#: Java's pattern for a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where it is unset and all is one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, under the application's own folder: that one can go as a whole when the application has ended."""
    return f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like names that df does not have yet (names are compared without case, as Spark does)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_row_key(docs: DataFrame, plain_table: bool) -> tuple[DataFrame, list[str]]:
    """docs with two columns that name each row, alike in every scan and whatever executors there are, and these columns' names.

    Rows of a plain_table (one that is read from files as it is) are named by file and place in it.  Any other docs is
    written to the shared folder with numbers.  Nothing that a scan counts up as it runs would do: splits follow the executors at hand.
    """
    file, at = fresh(docs, "row_file", "row_at")
    if plain_table:
        try:
            return docs.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at)), [file, at]
        except AnalysisException:  # not read from files after all
            pass
    return stored(docs.select("*", F.lit(0).cast("long").alias(file), F.monotonically_increasing_id().alias(at)), "rows"), [file, at]


def bucket_bits(rows: int) -> int:
    """Bits of a hash that split rows into buckets of about ROWS_PER_CELL rows."""
    return max(0, (rows // ROWS_PER_CELL).bit_length())


def top_bits(hashed: Column, bits: int) -> Column:
    """The leading bits of a signed 64-bit hash, as a number that grows with the hash."""
    return F.shiftright(hashed, 64 - bits) if bits else F.lit(0).cast("long")


def numbered(df: DataFrame, group: list[str], cell: str, order: list, out: str) -> DataFrame:
    """Position (from 0) of each row in its group, ordered by cell, then by order.

    No task sees a whole group: cell must split each group into bounded ranges of the order.  Only the counts
    by cell are ordered together.  Group columns must not be null.
    """
    base = df.groupBy(*group, cell).agg(F.count(F.lit(1)).alias("cell_rows"))
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    base = base.withColumn("cell_base", F.coalesce(F.sum("cell_rows").over(before), F.lit(0))).drop("cell_rows")
    inside = Window.partitionBy(*group, cell).orderBy(*order)
    return (
        df.join(base, [*group, cell])
        .withColumn(out, F.col("cell_base") + F.row_number().over(inside) - 1)
        .drop("cell_base")
    )
