"""A sink for answers in pieces: files of bounded size from each task, and a manifest a batch by which they count.

A batch is seen when its manifest is written, which names its files in the order
of its partitions. A batch that is run again after a failure writes a new manifest
in the place of the same batch's old one, so that no piece is read twice; files
that no manifest names are left over from tasks that failed and aren't read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


#: Bytes after which a task begins another file: one is read as a whole.
FILE_BYTES = 4 << 20


@dataclass
class Written(WriterCommitMessage):
    """A task's first file, without a row None, and those after it."""

    partition: int
    name: str | None
    more: tuple[str, ...] = ()

    def names(self) -> list[str]:
        return [self.name, *self.more] if self.name else []


class EventWriter(DataSourceStreamWriter):
    """Rows as server-sent events, each a line of JSON after ``data:`` and an empty line."""

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path.rstrip("/"), columns

    def write(self, iterator: Iterator[Any]) -> Written:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        store, root = _store(self.path)
        names: list[str] = []
        row = next(iterator, None)
        while row is not None:
            if not names:
                store.create_dir(f"{root}/files")
            names.append(f"{partition:06d}-{uuid.uuid4().hex}.events")
            with store.open_output_stream(f"{root}/files/{names[-1]}") as out:
                size = 0
                while row is not None and size < FILE_BYTES:
                    line = self._line(row)
                    out.write(line)
                    size += len(line)
                    row = next(iterator, None)
        return Written(partition, names[0] if names else None, tuple(names[1:]))

    def _line(self, row: Any) -> bytes:
        return f"data: {json.dumps({c: row[c] for c in self.columns}, ensure_ascii=False, default=str)}\n\n".encode()

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803 - the interface's name
        store, root = _store(self.path)
        store.create_dir(f"{root}/batches")
        names = [name for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition) for name in m.names()]
        # written whole under another name, then moved
        fresh = f"{root}/batches/.{uuid.uuid4().hex}"
        with store.open_output_stream(fresh) as out:
            out.write(json.dumps(names).encode())
        store.move(fresh, f"{root}/batches/{batchId:012d}.json")

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803 - the interface's name
        store, root = _store(self.path)
        for m in messages:
            for name in m.names() if m is not None else ():
                store.delete_file(f"{root}/files/{name}")


class EventSink(DataSource):
    """The data source of this sink; its option ``path`` is a folder that the driver and all executors share."""

    @classmethod
    def name(cls) -> str:
        return "lodeline_events"

    def streamWriter(self, schema: StructType, overwrite: bool) -> EventWriter:  # noqa: N802 - the interface's name
        return EventWriter(self.options["path"], schema.fieldNames())


def send(stream: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Send a stream's rows to the sink: all that is there if ``interval`` is None, else for ever at that pace."""
    stream.sparkSession.dataSource.register(EventSink)
    writer = stream.writeStream.format("lodeline_events").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def sent(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(batch, file, line, and the columns of ``schema``): what whole batches have sent; sorted by the first three it is in the order in which it was sent.

    Manifests are a row for each batch and task, read in the cluster like the events.
    """
    from pyspark.sql import functions as F

    name = lambda n: F.regexp_extract("_metadata.file_path", r"([^/]+)$", n)
    batches = spark.read.schema("value string").option("pathGlobFilter", "*.json").text(f"{path}/batches", wholetext=True)
    files = batches.select(F.regexp_extract("_metadata.file_path", r"([0-9]+)\.json$", 1).cast("bigint").alias("batch"), F.posexplode(F.from_json("value", "array<string>")).alias("file", "name"))
    events = spark.read.option("pathGlobFilter", "*.events").text(f"{path}/files", wholetext=True).select(name(1).alias("name"), F.posexplode(F.filter(F.split("value", "\n\n"), lambda x: x != "")).alias("line", "event"))
    return files.join(events, "name").select("batch", "file", "line", F.from_json(F.substring("event", 7, 1 << 30), schema).alias("e")).select("batch", "file", "line", "e.*")
