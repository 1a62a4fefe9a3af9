"""An extension for streams: exponential averages whose state lives between batches, and that follow corrections of the last days."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Days that a collection asks for again, and that a correction may lie behind the newest one.
BACK = 14
OUTPUT = "series_id string, date date, value double, ema double, status string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def following(count: int, average: float, value: float, alpha: float) -> tuple[int, float]:
    """How many values there are and their average, after one more."""
    return count + 1, value if count == 0 else (1 - alpha) * average + alpha * value


class RunningAverage(StatefulProcessor):
    """State of a series: the days within reach of a correction with their values, and the average of all before them."""

    def __init__(self, n: int, back: int) -> None:
        self.n, self.alpha, self.back = n, 2.0 / (n + 1), back

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.settled = handle.getValueState("settled", "count long, average double, last date")
        self.days = handle.getMapState("days", "date date", "value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        count, average, last = self.settled.get() if self.settled.exists() else (0, 0.0, None)
        held = {k[0]: v[0] for k, v in self.days.iterator()}
        new = pd.concat(list(rows)).dropna(subset=["date", "value"])
        if "seen" in new:
            new = new.sort_values("seen", kind="stable")
        out, changed = [], {}
        for day, value in zip(new["date"], new["value"].astype(float), strict=True):
            if last is not None and day <= last:
                out.append((key[0], day, value, None, "too_late"))
            elif held.get(day) != value:
                changed[day] = "corrected" if day in held and changed.get(day) != "added" else "added"
                held[day] = value
        if changed:
            first = min(changed)
            for day in sorted(held):
                count, average = following(count, average, held[day], self.alpha)
                if day >= first:
                    out.append((key[0], day, held[day], average if count >= self.n else None, changed.get(day, "follows")))
            self._keep(held)
        yield pd.DataFrame(out, columns=["series_id", "date", "value", "ema", "status"])

    def _keep(self, held: dict[date, float]) -> None:
        """Days out of reach of the newest one go into the settled average."""
        count, average, last = self.settled.get() if self.settled.exists() else (0, 0.0, None)
        edge = max(held) - timedelta(self.back)
        for day in sorted(held):
            if day <= edge:
                count, average = following(count, average, held.pop(day), self.alpha)
                last = day
        self.settled.update((count, average, last))
        self.days.clear()
        for day, value in held.items():
            self.days.updateValue((day,), (value,))

    def close(self) -> None:
        pass


def running_average(observations: DataFrame, n: int, back: int = BACK) -> DataFrame:
    """Average of span n after each observation: series_id, date, value, ema (null before n of them), status.

    Observations may come in any order and be corrected within `back` days of the newest one of their series (of a day seen twice in a batch the one
    seen last holds).  A new or corrected day is sent out (added, corrected) with every later day again (follows), as their averages change too; of a day that was sent more
    than once the last row holds, see latest_averages.  Observations further back change nothing and are sent out as too_late.
    The session's state store must be RocksDB (PROVIDER).
    """
    slim = observations.select(*[c for c in ("series_id", "date", "value", "seen") if c in observations.columns])
    return slim.groupBy("series_id").transformWithStateInPandas(RunningAverage(n, back), OUTPUT, "append", "none")


def latest_averages(sent: DataFrame, order: str) -> DataFrame:
    """Of the rows that running_average sent over time the ones that hold; order grows from batch to batch."""
    good = sent.where("status <> 'too_late'")
    row = F.max_by(F.struct("value", "ema"), order).alias("row")
    return good.groupBy("series_id", "date").agg(row).select("series_id", "date", "row.value", "row.ema")
