"""Readers of dated series in files: delimited text of unknown delimiter, and three shapes of JSON."""

from __future__ import annotations

import csv

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import parsed_date
from tidemark.sources.staging import staged

BOM = "\ufeff"
#: Names that a date or value column may have, in order of preference.
DATE_NAMES = ["date", "Date", "DATE", "jour", "Jour"]
VALUE_NAMES = ["USD/CDF", "usd_cdf", "USDCDF", "value", "Value", "X", "taux", "cours"]
#: Keys under which an object may hold its list of observations, in order of preference.
LIST_KEYS = ["data", "observations", "series", "values", "rates", "items"]


def resolve(columns: list[str], names: list[str], wanted: str | None = None) -> str:
    """The wanted column, or the first of names that is there; raises ValueError else."""
    for name in [wanted] if wanted else names:
        if name in columns:
            return name
    raise ValueError(f"none of {[wanted] if wanted else names} is a column of {columns}")


def delimiter_of(header: str) -> str:
    """The most frequent of comma, semicolon and tab in a header line."""
    return max(",;\t", key=header.count)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not blank of one or many text files, with their place: file, line (from 0 in the file), text.

    A file is read in as many splits as Spark likes.  Lines are numbered as they are written out, with the split that they come from; what stands
    in earlier splits of the file is summed over splits.  So numbers are those of the file, whatever the parallelism.
    """
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("text"))
    held = staged(text.where(F.trim("text") != "").withColumn("number", F.monotonically_increasing_id()), "lines")
    splits = held.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("first"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return held.join(splits, ["file", "start"]).select("file", (F.col("number") + F.col("shift")).alias("line"), "text")


def read_delimited(spark: SparkSession, path: str, date_column: str | None = None, value_column: str | None = None, series_id: str = "series") -> DataFrame:
    """Raw observations (series_id, row_in_file, date_raw, value_raw) of a delimited file; every field stays text.

    row_in_file counts the rows after the header from 0, blank lines left out; the rows of several files follow each other in the order of the files' names.
    A field does not span lines.  Only the first file's header line is looked at beforehand; every file has one.
    """
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError(f"{path} is empty")
    lines = numbered_lines(spark, path)
    header = lines.where("line = 0").orderBy("file").limit(1).collect()
    if not header:
        raise ValueError(f"{path} is empty")
    text = header[0].text.lstrip(BOM)
    sep = delimiter_of(text)
    columns = [c.strip() for c in next(csv.reader([text], delimiter=sep))]
    day, value = (columns.index(resolve(columns, names, wanted)) for names, wanted in ((DATE_NAMES, date_column), (VALUE_NAMES, value_column)))
    sizes = lines.groupBy("file").agg((F.max("line")).alias("rows"))
    sizes = sizes.select("file", (F.coalesce(F.sum("rows").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - 1).alias("base"))
    parsed = F.from_csv("text", ", ".join(f"c{k} string" for k in range(len(columns))), {"sep": sep})
    rows = lines.where("line > 0").join(sizes, "file").select((F.col("base") + F.col("line")).alias("row_in_file"), parsed.alias("c"))
    return rows.select(F.lit(series_id).alias("series_id"), "row_in_file", F.col(f"c.c{day}").alias("date_raw"), F.col(f"c.c{value}").alias("value_raw"))


def read_json_series(spark: SparkSession, path: str, date_column: str | None = None, value_column: str | None = None, series_id: str = "series") -> DataFrame:
    """Raw observations of a JSON file: a list of objects, an object that holds one, or a map from date to value; any other raises ValueError."""
    text = spark.read.text(path, wholetext=True)
    if text.where(F.ltrim(F.regexp_replace("value", BOM, "")).startswith("[")).limit(1).count():
        rows = _objects(text.select(F.from_json("value", "array<map<string,string>>").alias("rows")))
    else:
        schema = T.StructType([T.StructField(k, T.StringType()) for k in LIST_KEYS])
        held = text.select(F.from_json("value", schema).alias("o"), F.col("value"))
        found = F.coalesce(*[F.when(F.col(f"o.{k}").startswith("["), F.col(f"o.{k}")) for k in LIST_KEYS])
        if held.where(found.isNotNull()).limit(1).count():
            rows = _objects(held.select(F.from_json(found, "array<map<string,string>>").alias("rows")))
        else:
            pairs = text.select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("row_in_file", "e"))
            nested = pairs.where(F.ltrim("e.value").rlike(r"^[\[{]")).select("e.key").limit(10).collect()
            if nested or pairs.isEmpty():
                raise ValueError(f"{path} holds no observations that can be told; keys with other contents: {[r.key for r in nested]}")
            return pairs.select(F.lit(series_id).alias("series_id"), F.col("row_in_file").cast("long"), F.col("e.key").alias("date_raw"), F.col("e.value").alias("value_raw"))
    pick = lambda names, own: F.coalesce(*[F.try_element_at("o", F.lit(n)) for n in ([own] if own else names)])
    return rows.select(F.lit(series_id).alias("series_id"), F.col("row_in_file").cast("long"), pick(DATE_NAMES, date_column).alias("date_raw"), pick(VALUE_NAMES, value_column).alias("value_raw"))


def _objects(df: DataFrame) -> DataFrame:
    return df.select(F.posexplode("rows").alias("row_in_file", "o"))


def read_typed(spark: SparkSession, path: str, series_id: str = "series") -> DataFrame:
    """series_id, date, value: rows that are no date or number are dropped, the first of a date stays, values must be positive."""
    raw = read_delimited(spark, path, series_id=series_id)
    typed = raw.select("series_id", "row_in_file", parsed_date(F.col("date_raw")).alias("date"), F.expr("try_cast(trim(value_raw) as double)").alias("value")).dropna(subset=["date", "value"])
    first = typed.groupBy("series_id", "date").agg(F.min_by("value", "row_in_file").alias("value"))
    if first.where("value <= 0").limit(1).count():
        raise ValueError("rates must be positive")
    return first


def read_report(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame | None:
    """A small report, or None where the file is not there."""
    try:
        return spark.read.csv(path, header=True, inferSchema=True) if kind == "csv" else spark.read.json(path, multiLine=True)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
