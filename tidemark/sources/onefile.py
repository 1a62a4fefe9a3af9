"""A data source that writes one named file: CSV with a header, a JSON array, or a JSON object for each line.

    spark.dataSource.register(OneFile)
    df.write.format("one_file").option("kind", "csv").mode("overwrite").save("/shared/reports/summary.csv")

Each task writes a part beside the file under a name of its own attempt; when all are there the driver joins them, in the order of the rows'
partitions, and renames the whole into place.  Until then, and where the job fails, the old file stays as it was; a task that outlives
its job can leave its part behind, under a name that begins with a dot.  For reports
that are small by nature, on a folder that driver and executors share and that can rename; tables that grow are written as Parquet.
"""

from __future__ import annotations

import csv
import io
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

KINDS = ("csv", "json", "lines")


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: its place among the tasks, and its file, None without rows."""

    number: int
    file: str | None


def _plain(v: object) -> object:
    """v with rows as objects and days as ISO text."""
    if isinstance(v, Row):
        return {k: _plain(x) for k, x in v.asDict().items()}
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    if isinstance(v, dict):
        return {str(k): _plain(x) for k, x in v.items()}
    return v.isoformat() if isinstance(v, (date, datetime)) else v


class OneFileWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool) -> None:
        self.path, self.kind, self.names = options["path"].removeprefix("file://"), options.get("kind", "lines"), schema.names
        if self.kind not in KINDS:
            raise ValueError(f"kind is one of {KINDS}, not {self.kind!r}")
        self.keep, self.run = not overwrite, uuid.uuid4().hex

    def _beside(self, name: str) -> str:
        folder, own = os.path.split(self.path)
        return os.path.join(folder, f".{own}.{self.run}.{name}")

    def write(self, iterator: Iterator[Row]) -> Part:
        task = TaskContext.get()
        part, some = self._beside(f"{task.partitionId()}-{task.taskAttemptId()}"), False
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        with open(part, "w", encoding="utf-8", newline="") as f:
            rows = csv.writer(f, lineterminator="\n")
            for row in iterator:
                if self.kind == "csv":
                    rows.writerow([_plain(v) for v in row])
                else:
                    # In an array every row but the file's first follows a comma, which the part before it cannot know of.
                    f.write((",\n" if self.kind == "json" and some else "") + json.dumps(_plain(row), ensure_ascii=False) + ("\n" if self.kind == "lines" else ""))
                some = True
        if not some:
            os.remove(part)
        return Part(task.partitionId(), part if some else None)

    def commit(self, messages: list[Part | None]) -> None:
        parts = [m.file for m in sorted((m for m in messages if m), key=lambda m: m.number) if m.file]
        whole = self._beside("whole")
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        with open(whole, "wb") as f:
            if self.kind == "csv":
                head = io.StringIO()
                csv.writer(head, lineterminator="\n").writerow(self.names)
                f.write(head.getvalue().encode())
            f.write(b"[\n" if self.kind == "json" else b"")
            for k, part in enumerate(parts):
                f.write(b",\n" if self.kind == "json" and k else b"")
                with open(part, "rb") as p:
                    shutil.copyfileobj(p, f, 1 << 20)
            f.write(b"\n]\n" if self.kind == "json" else b"")
            f.flush()
            os.fsync(f.fileno())
        if self.keep:
            os.link(whole, self.path)  # fails where there is one
            os.remove(whole)
        else:
            os.replace(whole, self.path)
        self._clear()

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Remove this run's parts, those of failed attempts too."""
        folder, begin = os.path.dirname(self.path) or ".", os.path.basename(self._beside(""))
        for name in os.listdir(folder) if os.path.isdir(folder) else ():
            if name.startswith(begin):
                os.remove(os.path.join(folder, name))


class OneFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "one_file"

    def writer(self, schema: StructType, overwrite: bool) -> OneFileWriter:
        return OneFileWriter(schema, self.options, overwrite)


def write_one_file(df: DataFrame, path: str, kind: str) -> None:
    """df as the named file, in place of one that may be there."""
    df.sparkSession.dataSource.register(OneFile)
    df.write.format("one_file").option("kind", kind).mode("overwrite").save(path)
