"""Tables that change in one step: data in folders of their own, and a manifest that says which folder holds each year.

    table/data/<version>-<id>/year=2024/part-..   written by one batch, never changed
    table/manifests/version=<n>/part-..           one row: folders by year, and the last batch of each stream

A batch writes the years that it touches into a new folder, then the next manifest, a single file that its commit renames into place.  A job that
fails anywhere before that leaves the table as it was, and the same batch again begins anew; a batch that is in a manifest is skipped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "folders map<int,string>, batches map<string,long>, writer string"
#: How often a writer begins again after another was faster.
ATTEMPTS = 20


@dataclass(frozen=True)
class Version:
    """What a manifest says."""

    number: int = 0
    folders: dict[int, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    writer: str = ""


def _missing(e: AnalysisException) -> bool:
    return e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def current(spark: SparkSession, table: str, number: int | None = None) -> Version:
    """The newest version of a table (or that number), number 0 where there is none.

    Where two writers made the same number at once, the earlier file holds.
    """
    try:
        rows = spark.read.schema(f"{MANIFEST}, version int").option("basePath", f"{table}/manifests").parquet(f"{table}/manifests")
        rows = rows.select("*", F.col("_metadata.file_modification_time").alias("made"))
        if number is not None:
            rows = rows.where(F.col("version") == number)
        found = rows.orderBy(F.desc("version"), "made", "writer").limit(1).collect()
    except AnalysisException as e:
        if not _missing(e):
            raise
        found = []
    return Version(found[0].version, dict(found[0].folders), dict(found[0].batches), found[0].writer) if found else Version()


def read(spark: SparkSession, table: str, schema: str, years: list[int] | None = None, version: Version | None = None) -> DataFrame:
    """The rows of a table's newest version, of all years or some; no rows where it has none."""
    version = version or current(spark, table)
    paths = [f"{table}/{folder}" for year, folder in sorted(version.folders.items()) if years is None or year in years]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def publish(spark: SparkSession, table: str, years: list[int], make: Callable[[Version], DataFrame], stream: str = "", batch: int | None = None) -> Version:
    """Replace years of a table by what make gives of its version (with a column year), in one step; the version that then holds.

    batch numbers a stream's batches: one that is in the manifest already changes nothing.
    """
    for _ in range(ATTEMPTS):
        old = current(spark, table)
        if batch is not None and old.batches.get(stream, -1) >= batch:
            return old
        writer = uuid.uuid4().hex
        folder = f"data/{old.number + 1}-{writer}"
        make(old).write.partitionBy("year").parquet(f"{table}/{folder}")
        folders = old.folders | {y: f"{folder}/year={y}" for y in years}
        batches = old.batches | ({stream: batch} if batch is not None else {})
        row = spark.createDataFrame([(folders, batches, writer)], MANIFEST)
        try:
            row.coalesce(1).write.mode("errorifexists").parquet(f"{table}/manifests/version={old.number + 1}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            continue
        new = current(spark, table, old.number + 1)
        if new.writer == writer:
            return new
    raise RuntimeError(f"{table} changed {ATTEMPTS} times while this batch was written")
