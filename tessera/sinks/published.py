"""A sink that publishes a table at once: a Spark data source for lines of text, as CSV or as JSON arrays.

Tasks write parts to a folder of their run beside the target, a part for each task, complete in itself: CSV with the header, or one
JSON array. Only when all tasks have committed does the driver move that folder to the target; a task that fails
takes its part away, and a failed run its folder, so a reader sees the old table, the new one or none. The folders are
in a store that all executors reach, by pyarrow's file systems."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tessera.plans.dataset import Dataset
from tessera.sinks import cells
from tessera.sinks.files import ExportError, contained, file_names, header_of

KINDS = ("csv", "json")


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"\w+://|file:", path) else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    part: str
    rows: int


class LineWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.kind, self.header, self.overwrite = options["path"].rstrip("/"), options["kind"], options.get("header", ""), overwrite
        if self.kind not in KINDS:
            raise ExportError(f"{self.kind!r} is none of {', '.join(KINDS)}")
        self.staging = f"{self.path}.run-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = store_of(self.staging)
        context = TaskContext.get()
        part = f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}.{self.kind}"
        store.create_dir(folder, recursive=True)
        rows = 0
        try:
            with store.open_output_stream(part) as out:
                out.write(b"[" if self.kind == "json" else f"{self.header}\n".encode())
                for batch in iterator:
                    for line in batch.column(0):
                        lead = ("," if rows else "") + "\n" if self.kind == "json" else ""
                        out.write(f"{lead}{line.as_py()}{'' if self.kind == 'json' else chr(10)}".encode())
                        rows += 1
                out.write(b"\n]\n" if self.kind == "json" else b"")
        except BaseException:
            store.delete_file(part)
            raise
        return Written(part, rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, target = store_of(self.path)
        folder = store_of(self.staging)[1]
        if store.get_file_info(target).type != fs.FileType.NotFound:
            if not self.overwrite:
                self.abort(messages)
                raise ExportError(f"{self.path} is there already")
            store.delete_dir(target)
        kept = {m.part for m in messages if m}
        for found in store.get_file_info(fs.FileSelector(folder)):
            if found.path not in kept:  # of an attempt that another one replaced
                store.delete_file(found.path)
        store.move(folder, target)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = store_of(self.staging)
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)


class LineSink(DataSource):
    """Options: path, kind (csv or json), header. The rows' first column has the lines."""

    @classmethod
    def name(cls) -> str:
        return "tessera_lines"

    def writer(self, schema, overwrite: bool) -> LineWriter:
        return LineWriter(dict(self.options), overwrite)


def write_lines(lines: DataFrame, path: str, kind: str, header: str = "", overwrite: bool = False) -> None:
    """lines (value, ..) in their order of partitions."""
    spark: SparkSession = lines.sparkSession
    spark.dataSource.register(LineSink)
    out = lines.select("value").write.format("tessera_lines").option("path", path).option("kind", kind).option("header", header)
    out.mode("overwrite" if overwrite else "append").save()


def publish(data: Dataset, folder: str, kind: str, overwrite: bool = False) -> dict[str, str]:
    """A folder <table>.<kind> for each table, published when it is whole."""
    names = file_names([t.name for t in data.schema.tables], kind)
    for table in data.schema.tables:
        columns, rows = [c.name for c in table.columns], data.rows(table.name)
        line = cells.csv_line(rows, columns) if kind == "csv" else cells.json_object(rows, columns)
        write_lines(rows.select("idx", line.alias("value")).sort(F.col("idx")), contained(folder, names[table.name]), kind, header_of(columns), overwrite)
    return names
