"""Exponential moving averages, which feed each value on to the next: no window function can express them.

Three routes with equal results.  averaged() hands each series to pandas once: for series of days, which are bounded.
averaged_in_chunks() scans series of any length: a chunk of rows is an affine map of the average before it, the maps of a series' chunks are
applied one after the other, and each chunk is averaged from what comes out.  averaged_in_sql() folds an array inside a window, quadratic in length: as a check.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.sources.staging import staged


@dataclass(frozen=True)
class Average:
    """An average of a column: seeded with its first value, weight alpha for the newest, null before `least` values."""

    name: str
    column: str
    alpha: float
    least: int


@dataclass(frozen=True)
class Difference:
    """A column minus another."""

    name: str
    column: str
    other: str


def span(name: str, column: str, n: int) -> Average:
    return Average(name, column, 2.0 / (n + 1), n)


def wilder(name: str, column: str, n: int) -> Average:
    return Average(name, column, 1.0 / n, n)


def averaged(df: DataFrame, averages: list[Average | Difference], key: str = "series_id", order: str = "row") -> DataFrame:
    """df with a column for each average.  An average may build on one that comes before it in the list."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(a.name, T.DoubleType()) for a in averages)])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        for a in averages:
            column = part[a.column].astype(float)
            if isinstance(a, Difference):
                part[a.name] = column - part[a.other]
            else:
                part[a.name] = column.ewm(alpha=a.alpha, adjust=False, min_periods=a.least).mean()
        return part

    return df.groupBy(key).applyInPandas(run, schema)


def chunk_map(x: np.ndarray, alpha: float) -> dict[str, float]:
    """What a chunk does to the average before it: rows before its first value, that value, the map a * y + b from the average at
    that value to the one at the end, rows after the last value, and the number of values."""
    at = np.flatnonzero(~np.isnan(x))
    if not len(at):
        return {"lead": len(x), "first": None, "a": None, "b": None, "trail": len(x), "n": 0}
    old = (1 - alpha) ** np.diff(at)
    rest = x[at[0] :].copy()
    rest[0] = 0.0
    b = pd.Series(rest).ewm(alpha=alpha, adjust=False).mean().iloc[-1]
    return {"lead": int(at[0]), "first": float(x[at[0]]), "a": float(np.prod(old / (old + alpha))), "b": float(b), "trail": int(len(x) - 1 - at[-1]), "n": len(at)}


def _met(alpha: float, y: float, gap: int, x: float) -> float:
    """The average at a value that comes gap + 1 rows after the average y."""
    old = (1 - alpha) ** (gap + 1)
    return (old * y + alpha * x) / (old + alpha)


def carried_over(m: dict[str, float], alpha: float, carry: dict[str, float]) -> dict[str, float]:
    """The average y after a chunk with this map, the rows since its last value (gap) and the number of values so far (n)."""
    if not m["n"]:
        return carry | {"gap": carry["gap"] + m["lead"]}
    y = _met(alpha, carry["y"], carry["gap"] + m["lead"], m["first"]) if carry["n"] else m["first"]
    return {"y": m["a"] * y + m["b"], "gap": m["trail"], "n": carry["n"] + m["n"]}


def continued(x: np.ndarray, average: Average, carry: dict[str, float]) -> np.ndarray:
    """The averages of a chunk after the carry."""
    seen = ~np.isnan(x)
    lead = int(seen.argmax()) if seen.any() else len(x)
    out = np.full(len(x), carry["y"] if carry["n"] else np.nan)
    if lead < len(x):
        rest = x[lead:].copy()
        if carry["n"]:
            rest[0] = _met(average.alpha, carry["y"], carry["gap"] + lead, rest[0])
        out[lead:] = pd.Series(rest).ewm(alpha=average.alpha, adjust=False).mean()
    out[carry["n"] + seen.cumsum() < average.least] = np.nan
    return out


def _levels(averages: list[Average | Difference]) -> dict[str, int]:
    """How many scans must come before each column's."""
    found: dict[str, int] = {}
    for a in averages:
        if isinstance(a, Difference):
            found[a.name] = max(found.get(a.column, 0), found.get(a.other, 0))
        else:
            found[a.name] = found[a.column] + 1 if a.column in found else 0
    return found


def averaged_in_chunks(df: DataFrame, averages: list[Average | Difference], rows: int, key: str = "series_id", order: str = "row") -> DataFrame:
    """df with a column for each average, as averaged() makes them, without a task for a whole series.

    order counts a series' rows from 0.  A chunk of rows is held as one row of arrays, which one shuffle makes; a scan sends a few numbers of each chunk, in
    order, through a task that keeps one carry.  Averages of raw columns are one scan, those of averages another.
    """
    level, inputs = _levels(averages), [c for c in df.columns if c != key]
    rest = F.sort_array(F.collect_list(F.struct(order, *[c for c in inputs if c != order])))
    packed = df.groupBy(key, F.expr(f"{order} div {rows}").alias("chunk")).agg(rest.alias("rows"))
    packed = staged(packed.withColumn("uid", F.monotonically_increasing_id()), "chunks")
    depth = max((v for a in averages if isinstance(a, Average) for v in [level[a.name]]), default=-1) + 1
    scans = [[a for a in averages if isinstance(a, Average) and level[a.name] == k] for k in range(depth)]
    empty = df.sparkSession.createDataFrame
    carry, state = "array<struct<y: double, gap: long, n: long>>", {"y": None, "gap": 0, "n": 0}

    def columns(held: pa.StructArray, carries: list[list[dict]]) -> dict[str, np.ndarray]:
        """Values of every column that the carries at hand allow."""
        out = {c: held.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in {a.column for a in averages} & set(inputs)}
        by_name = {a.name: c for scan, own in zip(scans, carries, strict=False) for a, c in zip(scan, own, strict=True)}
        for a in averages:
            if isinstance(a, Average) and a.name in by_name:
                out[a.name] = continued(out[a.column], a, by_name[a.name])
            elif isinstance(a, Difference) and a.column in out and a.other in out:
                out[a.name] = out[a.column] - out[a.other]
        return out

    def at(batch: pa.RecordBatch, k: int, scan: int) -> dict[str, np.ndarray]:
        return columns(batch["rows"][k].values, [batch[f"carry{s}"][k].as_py() for s in range(scan)])

    found = packed
    for scan, own in enumerate(scans):
        maps = empty([], f"uid long, {key} {df.schema[key].dataType.simpleString()}, chunk long, maps array<struct<lead: long, first: double, a: double, b: double, trail: long, n: long>>").schema
        maps_schema, after = to_arrow_schema(maps), empty([], f"uid long, carry{scan} {carry}").schema
        after_schema = to_arrow_schema(after)

        def summed(batches: Iterator[pa.RecordBatch], scan=scan, own=own, schema=maps_schema) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [[chunk_map(v[a.column], a.alpha) for a in own] for k in range(batch.num_rows) for v in [at(batch, k, scan)]]
                yield pa.RecordBatch.from_arrays([batch["uid"], batch[key], batch["chunk"], pa.array(got, schema.field("maps").type)], schema=schema)

        def folded(batches: Iterator[pa.RecordBatch], own=own, schema=after_schema) -> Iterator[pa.RecordBatch]:
            series, now = object(), []
            for batch in batches:
                out = []
                for name, ms in zip(batch[key].to_pylist(), batch["maps"].to_pylist(), strict=True):
                    if name != series:
                        series, now = name, [state] * len(own)
                    out.append(now)
                    now = [carried_over(m, a.alpha, c) for m, a, c in zip(ms, own, now, strict=True)]
                yield pa.RecordBatch.from_arrays([batch["uid"], pa.array(out, schema.field(1).type)], schema=schema)

        mapped = found.mapInArrow(summed, maps)
        carries = mapped.repartition(key).sortWithinPartitions(key, "chunk").mapInArrow(folded, after)
        found = found.join(staged(carries, "carries"), "uid")
    final = T.StructType([*df.schema.fields, *(T.StructField(a.name, T.DoubleType()) for a in averages)])
    final_schema = to_arrow_schema(final)

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                held, made = batch["rows"][k].values, at(batch, k, depth)
                have = {key: pa.repeat(batch[key][k], len(held))} | {c: held.field(c) for c in inputs} | {a.name: pa.array(made[a.name], from_pandas=True) for a in averages}
                yield pa.RecordBatch.from_arrays([have[f.name].cast(f.type) for f in final_schema], schema=final_schema)

    return found.mapInArrow(flat, final)


def averaged_in_sql(average: Average, key: str = "series_id", order: str = "row") -> Column:
    """The same average as a window expression over a column without gaps after its first value."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    values = F.collect_list(average.column).over(w)
    fold = F.aggregate(values, F.lit(None).cast("double"), lambda acc, x: F.coalesce((1 - F.lit(average.alpha)) * acc + F.lit(average.alpha) * x, x))
    return F.when(F.size(values) >= average.least, fold)
