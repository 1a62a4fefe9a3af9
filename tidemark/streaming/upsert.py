"""An extension for streams: late and corrected observations, upserted batch by batch with checks of the last days.

The table is Parquet by year, in versions: a batch writes only the years that it touches, and changes all of them in one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.merge import merged
from tidemark.streaming import versions

SCHEMA = "series_id string, date date, value double, seen timestamp"
#: Columns of the table.
ROWS = "series_id string, date date, value double"


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Observations that arrive as JSON files."""
    return spark.readStream.schema(SCHEMA).json(path)


def latest(observations: DataFrame, delay: str = "14 days") -> DataFrame:
    """The newest sighting of each date inside the watermark, as a windowed aggregate over event time."""
    timed = observations.withColumn("event", F.col("date").cast("timestamp")).withWatermark("event", delay)
    return timed.groupBy("series_id", F.window("event", "1 day")).agg(F.max_by("value", "seen").alias("value")).select("series_id", F.to_date("window.start").alias("date"), "value")


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """The observations of the table as its last whole batch left it: series_id, date, value."""
    return versions.read(spark, table, ROWS)


def upsert_batch(batch: DataFrame, table: str, stream: str = "", number: int | None = None) -> None:
    """Merge one micro-batch into the table in one step; the same batch twice changes nothing.

    Readers see all years of a batch or none.  Two streams can write one table: the slower one merges again into what the faster one left.
    """
    spark = batch.sparkSession
    new = batch.dropna(subset=["series_id", "date"]).groupBy("series_id", "date").agg(F.max_by("value", "seen").alias("value"))
    years = [r.year for r in new.select(F.year("date").alias("year")).distinct().collect()]

    def make(version: versions.Version) -> DataFrame:
        known = versions.read(spark, table, ROWS, years, version)
        return merged(known, new).select("series_id", "date", "value", F.year("date").alias("year"))

    if years:
        versions.publish(spark, table, years, make, stream, number)


def start(spark: SparkSession, source: str, table: str, checkpoint: str) -> StreamingQuery:
    """Upsert everything that is there, then stop.  The checkpoint names the stream, as it numbers the batches."""
    stream = read_stream(spark, source).writeStream.foreachBatch(lambda batch, number: upsert_batch(batch, table, checkpoint, number))
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
