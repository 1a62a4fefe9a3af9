"""Series of any length: positions by ranges, windows by chunks of rows, and whether rows rise, without a task for a whole series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.staging import staged

#: Rows of a chunk.
ROWS = 65_536


def with_long_position(series: DataFrame, *order: str | Column) -> DataFrame:
    """Add row, the position from 0 (long) of each row in its series by order, null first; rows that are alike in it follow in any order.

    Rows are dealt by ranges of series and order, which Spark draws from a sample, and numbered as they are written; then a row's
    position is what stands in earlier ranges of its series, summed over ranges, and its place in its own.
    """
    keys = [F.col("series_id"), *[F.col(o) if isinstance(o, str) else o for o in order]]
    spread = series.withColumn("spread_", F.monotonically_increasing_id())  # for a series whose rows are all alike in order
    ranged = spread.repartitionByRange(*keys, "spread_").sortWithinPartitions(*keys, "spread_").drop("spread_")
    held = staged(ranged.withColumn("number_", F.monotonically_increasing_id()), "ranges").withColumn("part_", F.shiftright("number_", 33))
    runs = held.groupBy("series_id", "part_").agg(F.count(F.lit(1)).alias("n_"), F.min("number_").alias("first_"))
    earlier = Window.partitionBy("series_id").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("series_id").alias("series_"), F.col("part_").alias("run_"), (F.coalesce(F.sum("n_").over(earlier), F.lit(0)) - F.col("first_")).alias("shift_"))
    found = held.join(runs, F.col("series_id").eqNullSafe(F.col("series_")) & (F.col("part_") == F.col("run_")))
    return found.withColumn("row", F.col("number_") + F.col("shift_")).drop("number_", "part_", "series_", "run_", "shift_")


def in_chunks(series: DataFrame, make: Callable[[DataFrame], DataFrame], before: int, after: int = 0, rows: int = ROWS) -> DataFrame:
    """What make gives of series (series_id, row, ...) where its windows by series_id and row reach `before` rows back and `after` ahead at most.

    Each chunk of rows is a series of its own to make, together with the rows around it that its windows reach; what make gives of
    those is left out again.  make keeps series_id and row.  One shuffle by chunk serves all its windows.
    """
    if max(before, after) > rows:
        raise ValueError(f"windows reach over more than the {rows} rows of a chunk")
    own, place = F.expr(f"row div {rows}"), F.expr(f"row % {rows}")
    homes = F.array_compact(F.array(own, F.when(place >= rows - before, own + 1), F.when((place < after) & (own > 0), own - 1)))
    around = series.withColumn("chunk_", F.explode(homes)).withColumn("series_id", F.struct("series_id", F.col("chunk_").alias("chunk"))).drop("chunk_")
    return make(around).where(own == F.col("series_id.chunk")).withColumn("series_id", F.col("series_id.series_id"))


def rises(rows: DataFrame, value: str, order: str, cell: Column) -> DataFrame:
    """Whether each series' values never fall in the order of a column: series_id, rises.

    cell cuts the order into ranges.  Neighbours are compared inside them, and each range's first value with the last of the range before.
    """
    falls = F.col(value) < F.lag(value).over(Window.partitionBy("series_id", "cell_").orderBy(order))
    inside = rows.select("series_id", cell.alias("cell_"), order, value).withColumn("falls_", falls)
    cells = inside.groupBy("series_id", "cell_").agg(F.bool_or("falls_").alias("falls_"), F.min_by(value, order).alias("first_"), F.max_by(value, order).alias("last_"))
    border = F.col("first_") < F.lag("last_").over(Window.partitionBy("series_id").orderBy("cell_"))
    return cells.withColumn("border_", border).groupBy("series_id").agg((~F.coalesce(F.bool_or(F.coalesce("falls_", F.lit(False)) | F.coalesce("border_", F.lit(False))), F.lit(False))).alias("rises"))
