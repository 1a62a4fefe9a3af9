"""A data source for daily quote pages: one partition for each run of days, one request for each day.

    spark.dataSource.register(QuotePages)
    spark.read.format("quote_pages").option("base", URL).option("start", "2024-01-01").option("end", "2024-01-31").load()
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark.functions.scalars import quote_rate


class Days(InputPartition):
    def __init__(self, first: date, n: int) -> None:
        self.first, self.n = first, n


@dataclass(frozen=True)
class Answer:
    """What asking for a page came to: its text, or the last error after so many attempts."""

    text: str | None
    attempts: int
    error: str | None = None


def waits(retries: int, pause: float) -> Iterator[float]:
    """Seconds to wait before each attempt: none before the first, then ever longer."""
    return (k * pause for k in range(retries + 1))


def fetch(url: str, timeout: float, retries: int, pause: float) -> Answer:
    """Ask for a page until it comes or the attempts are used up; network errors end an attempt, not the job."""
    request, answer = Request(url, headers={"User-Agent": "tidemark", "Accept": "text/html"}), Answer(None, 0)
    for seconds in waits(retries, pause):
        time.sleep(seconds)
        try:
            with urlopen(request, timeout=timeout) as page:
                return Answer(page.read().decode("utf-8", "ignore"), answer.attempts + 1)
        except OSError as e:  # of which URLError and TimeoutError are kinds
            answer = Answer(None, answer.attempts + 1, str(e))
    return answer


class QuoteReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.base = options["base"].rstrip("/")
        self.start, self.end = date.fromisoformat(options["start"]), date.fromisoformat(options["end"])
        self.timeout, self.retries, self.pause = float(options.get("timeout", 25)), int(options.get("retries", 2)), float(options.get("pause", 1.25))
        self.per_task = int(options.get("days_per_partition", 1))

    def partitions(self) -> list[InputPartition]:
        days = (self.end - self.start).days + 1
        return [Days(self.start + timedelta(k), min(self.per_task, days - k)) for k in range(0, max(0, days), self.per_task)]

    def read(self, partition: Days) -> Iterator[tuple]:
        return pages(partition, self.base, self.timeout, self.retries, self.pause)


def pages(days: Days, base: str, timeout: float, retries: int, pause: float) -> Iterator[tuple[date, str | None]]:
    """Days with their pages, one request for each."""
    for k in range(days.n):
        day = days.first + timedelta(k)
        yield day, fetch(f"{base}/{day.isoformat()}", timeout, retries, pause).text


class QuoteStream(DataSourceStreamReader):
    """Pages day by day; an offset is the last day that was read.

    A batch reads the days after the offset before it through the newest one, and again the last `back` days before these, as quotes are corrected.
    The newest day is the option end, or today.  A restart goes on from the checkpoint's offset and asks for no other days.
    """

    def __init__(self, options: dict) -> None:
        self.base, self.start, self.end = options["base"].rstrip("/"), date.fromisoformat(options["start"]), options.get("end")
        self.timeout, self.retries, self.pause = float(options.get("timeout", 25)), int(options.get("retries", 2)), float(options.get("pause", 1.25))
        self.back, self.per_task = int(options.get("back", 14)), int(options.get("days_per_partition", 1))

    def initialOffset(self) -> dict:
        return {"day": (self.start - timedelta(1)).isoformat()}

    def latestOffset(self) -> dict:
        newest = date.fromisoformat(self.end) if self.end else date.today()
        return {"day": max(newest, self.start - timedelta(1)).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, last = date.fromisoformat(start["day"]), date.fromisoformat(end["day"])
        first = max(self.start, before - timedelta(self.back - 1))
        days = (last - first).days + 1 if last > before else 0
        return [Days(first + timedelta(k), min(self.per_task, days - k)) for k in range(0, days, self.per_task)]

    def read(self, partition: Days) -> Iterator[tuple]:
        return pages(partition, self.base, self.timeout, self.retries, self.pause)

    def commit(self, end: dict) -> None:
        pass


class QuotePages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quote_pages"

    def schema(self) -> str:
        return "date date, html string"

    def reader(self, schema) -> QuoteReader:
        return QuoteReader(self.options)

    def streamReader(self, schema) -> QuoteStream:
        return QuoteStream(self.options)


def rates(pages: DataFrame, series_id: str = "quotes") -> DataFrame:
    """Plausible rates of daily pages (date, html): series_id, date, value."""
    return pages.select(F.lit(series_id).alias("series_id"), "date", quote_rate(F.col("html")).alias("value")).where("value is not null")
