"""Tables in the folder that driver and executors share, for results that several later steps read."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under spark.checkpoint.dir (a temporary folder only where that is unset) and read it back.

    The plan of what follows starts from a scan: it stays small, and a lost executor costs no recomputation.  The application's tables lie
    in a folder of their own, which can go as a whole when it has ended.
    """
    path = _write(df, name)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Path and schema of what staged_once has written, by application, source and its state, and name.
_KEPT: dict[tuple, tuple[str, StructType]] = {}


def state_of(spark: SparkSession, folder: str) -> int:
    """A number that changes when a file of the folder is added, removed or written again: of paths, sizes and times, not of contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("state")).first().state


def staged_once(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Like staged, but made once for an application and state of the source's files: later calls for the same read the table that is there."""
    key = spark.sparkContext.applicationId, source, state_of(spark, source), name
    if key not in _KEPT:
        df = make()
        _KEPT[key] = _write(df, name), df.schema
    path, schema = _KEPT[key]
    return spark.read.schema(schema).parquet(path)


def _write(df: DataFrame, name: str) -> str:
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/tidemark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def spread(df: DataFrame, *keys: str, parts: int = 0) -> DataFrame:
    """df dealt by keys over spark.sql.shuffle.partitions tasks, or over parts where that is more, also where it is small.

    For steps that multiply rows or fit models: adaptive execution joins small partitions by their bytes, which
    would run all that work in one task.
    """
    return df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)
