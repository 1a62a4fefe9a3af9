"""Writers: one-file CSV and JSON reports for people, Parquet for everything that grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.onefile import write_one_file


def write_csv(df: DataFrame, path: str, **names: str) -> None:
    """The named CSV file with a header, for a report that is small by nature; names rename columns on the way."""
    write_one_file(df.withColumnsRenamed(names), path, "csv")


def write_json(df: DataFrame, path: str) -> None:
    """The named file of one JSON object for each row."""
    write_one_file(df, path, "lines")


def write_table(df: DataFrame, path: str, *by: str) -> None:
    """Parquet, in a folder for each value of the by columns."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def envelope(series: DataFrame, status: dict[str, Column] | None = None) -> DataFrame:
    """One row per series: its sorted observations, their number, the period and what else status names."""
    ordered = F.sort_array(F.collect_list(F.struct(F.date_format("date", "yyyy-MM-dd").alias("date"), "value")))
    period = F.struct(F.date_format(F.min("date"), "yyyy-MM-dd").alias("start"), F.date_format(F.max("date"), "yyyy-MM-dd").alias("end"))
    out = series.groupBy("series_id").agg(ordered.alias("series"), F.count(F.lit(1)).alias("observations"), period.alias("period"))
    return out.withColumn("collection", F.struct(*[c.alias(k) for k, c in status.items()])) if status else out


def open_envelope(envelopes: DataFrame) -> DataFrame:
    """The observations of envelopes: series_id, date, value."""
    return envelopes.select("series_id", F.inline("series")).select("series_id", F.to_date("date").alias("date"), "value")


def check_published(series: DataFrame, last_model_date: str) -> None:
    """Raise ValueError unless every value is positive, dates are unique, and the model saw the last of them."""
    bad = series.agg(F.count_if(F.col("value") <= 0).alias("low"), (F.count(F.lit(1)) - F.count_distinct("series_id", "date")).alias("twice"), F.max("date").cast("string").alias("last")).first()
    if bad.low or bad.twice or bad["last"] != last_model_date:
        raise ValueError(f"published data are not consistent: {bad.asDict()}")
