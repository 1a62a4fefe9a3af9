"""Set operations on dated series: upsert with counters, calendars, date filters and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAME = 1e-9
FIRST_DAY = "2017-01-01"
#: Days that each period of the site looks back.
PERIODS = {"1m": 31, "6m": 183, "1y": 365, "5y": 1825}


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by (series_id, date), new wins: value and status (added, corrected, unchanged).

    One full outer join on the key.  A null new value leaves the old one; differences up to 1e-9 are no correction.
    """
    both = old.select("series_id", "date", F.col("value").alias("old")).join(new.select("series_id", "date", F.col("value").alias("new")), ["series_id", "date"], "full_outer")
    differs = F.abs(F.col("new") - F.col("old")) > SAME
    status = F.when(F.col("old").isNull() & F.col("new").isNotNull(), "added").when(differs, "corrected").otherwise("unchanged")
    return both.select("series_id", "date", F.coalesce("new", "old").alias("value"), status.alias("status"))


def merge_counts(merge: DataFrame) -> DataFrame:
    """Added and corrected dates by series."""
    return merge.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "added").alias("added"), F.count_if(F.col("status") == "corrected").alias("corrected"))


def calendar(spark: SparkSession, today: str, days_back: int = 14, first: str = FIRST_DAY) -> DataFrame:
    """All days from days_back (1 at least) before today, but not before first."""
    begin = F.greatest(F.lit(first).cast("date"), F.date_sub(F.lit(today).cast("date"), max(1, days_back)))
    return spark.range(1).select(F.explode(F.sequence(begin, F.lit(today).cast("date"))).alias("date"))


def calendars(series: DataFrame, days_back: int = 14, first: str = FIRST_DAY) -> DataFrame:
    """The days to collect again for each series: from days_back (1 at least) before its newest one, but not before first, through the newest."""
    newest = series.groupBy("series_id").agg(F.max("date").alias("newest"))
    begin = F.greatest(F.lit(first).cast("date"), F.date_sub("newest", max(1, days_back)))
    return newest.where(F.col("newest") >= F.lit(first).cast("date")).select("series_id", F.explode(F.sequence(begin, "newest")).alias("date"))


def drawn(key: str, seed: int) -> Column:
    """A row's place in a draw: the md5 of seed and key, alike in every run and engine."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))


def stratified_sample(df: DataFrame, by: str, key: str, each: int, total: int, seed: int) -> DataFrame:
    """Rows of a seeded sample: `each` of every stratum, fewer where it has no more, then rows of any until there are total.

    key must be unique.  Places are limited before rows are shuffled, so a large stratum sends only its first of each task.
    """
    placed = df.withColumn("place_", drawn(key, seed))
    own = Window.partitionBy(by).orderBy("place_")
    strata = placed.withColumn("rank_", F.row_number().over(own)).where(F.col("rank_") <= each).drop("rank_")
    n = strata.agg(F.count(F.lit(1)).alias("have_"))
    others = placed.join(strata.select(F.col(key).alias("taken_")), F.col(key) == F.col("taken_"), "left_anti").orderBy("place_").limit(total)
    # Only as many others as are missing, which is known when the strata are counted.
    missing = others.withColumn("rank_", F.row_number().over(Window.orderBy("place_"))).crossJoin(n).where(F.col("rank_") <= total - F.col("have_"))
    return strata.select(*df.columns).unionByName(missing.select(*df.columns))


def without(df: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not in the sample."""
    return df.join(sample.select(F.col(key).alias("taken_")), F.col(key) == F.col("taken_"), "left_anti")


def in_period(series: DataFrame, period: str) -> DataFrame:
    """Observations of the last days before each series' last date; any other name gives all."""
    if period not in PERIODS:
        return series
    newest = series.groupBy("series_id").agg(F.max("date").alias("newest"))
    return series.join(newest, "series_id").where(F.col("date") >= F.date_sub("newest", PERIODS[period])).drop("newest")


def search_dates(series: DataFrame, text: str, n: int = 80) -> DataFrame:
    """The newest n observations of each series whose ISO date contains the text, with the change from the one before (in %)."""
    before = F.lag("value", 1).over(Window.partitionBy("series_id").orderBy("date"))
    base = F.coalesce(before, F.col("value"))
    pct = F.coalesce((F.col("value") - base) / F.nullif(base, F.lit(0.0)) * 100, F.lit(0.0))
    found = series.withColumn("pct", pct).where(F.date_format("date", "yyyy-MM-dd").contains(text.strip().lower()))
    newest = Window.partitionBy("series_id").orderBy(F.desc("date"))
    return found.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= n).select("series_id", "date", "value", "pct")


def last_rows(series: DataFrame, n: int) -> DataFrame:
    newest = Window.partitionBy("series_id").orderBy(F.desc("row"))
    return series.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= n).drop("place")


def quartile_picks(series: DataFrame) -> DataFrame:
    """The rows at floor(n * 0, 1/4, 1/2, 3/4) and the last, each once."""
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    at: Column = F.array(*[F.floor(F.col("n") * q) for q in (0.0, 0.25, 0.5, 0.75)], F.col("n") - 1)
    return series.withColumn("n", n).where(F.array_contains(at, F.col("row").cast("long"))).drop("n")


def new_since(series: DataFrame, trained_through: str) -> DataFrame:
    """Observations after a model's last training date, by series."""
    return series.groupBy("series_id").agg(F.count_if(F.col("date") > F.lit(trained_through).cast("date")).alias("n_new"))
