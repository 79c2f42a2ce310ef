"""Writes a generated dataset: CSV or JSON lines per table, or one SQL script. Output is text that Spark
writes in parts, in row order; quarantined rows are never written."""

from __future__ import annotations

import base64
import posixpath
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.dataset import Dataset
from tessera.sinks import cells

_DEVICES = re.compile(r"(con|prn|aux|nul|com\d|lpt\d)", re.I)


class ExportError(ValueError):
    """Rows or names that can't be written as asked."""


def safe_name(table: str) -> str:
    """A file name for a table: letters, digits, - and _ as they are, anything else encoded."""
    if re.fullmatch(r"[a-z0-9_-]+", table) and not _DEVICES.fullmatch(table):
        return table
    return "~" + base64.b32encode(table.encode()).decode().rstrip("=").lower()


def file_names(tables: list[str], suffix: str) -> dict[str, str]:
    names = {t: f"{safe_name(t)}.{suffix}" for t in tables}
    if len({n.lower() for n in names.values()}) < len(names):
        raise ExportError("two tables would share a file name")
    return names


def contained(folder: str, name: str) -> str:
    """The path of a name within a folder; one that leads out of it is an error."""
    top = posixpath.normpath(folder)
    path = posixpath.normpath(posixpath.join(top, name))
    if not name or "\\" in name or "\0" in name or posixpath.dirname(path) != top:
        raise ExportError(f"{name!r} is no name of a file in {folder!r}")
    return path


def header_of(columns: list[str]) -> str:
    return ",".join('"' + c.replace('"', '""') + '"' if re.search('[,"\n\r]', c) else c for c in columns)


def write_csv(data: Dataset, folder: str) -> dict[str, str]:
    """A folder <table>.csv of text parts for each table, each with the header, as readers of such folders expect."""
    names = file_names([t.name for t in data.schema.tables], "csv")
    for table in data.schema.tables:
        columns = [c.name for c in table.columns]
        rows = data.rows(table.name)
        lines = rows.select("idx", cells.csv_line(rows, columns).alias("value"))
        _write_lines(lines, header_of(columns), contained(folder, names[table.name]))
    return names


def _write_lines(lines: DataFrame, header: str, path: str) -> None:
    """Rows in order, in parts that each start with the header; the first part is there without rows, too."""
    head = lines.sparkSession.range(1).select(F.lit(-1).cast("long").alias("idx"), F.lit(header).alias("value"))
    first = F.monotonically_increasing_id().bitwiseAND(2**33 - 1) == 0  # of its partition
    value = F.when(first & (F.col("idx") >= 0), F.concat(F.lit(header + "\n"), F.col("value"))).otherwise(F.col("value"))
    head.unionByName(lines).sort("idx").select(value.alias("value")).write.text(path, lineSep="\n")


def write_json(data: Dataset, folder: str) -> dict[str, str]:
    """A folder <table>.json of JSON lines for each table."""
    names = file_names([t.name for t in data.schema.tables], "json")
    for table in data.schema.tables:
        rows = data.rows(table.name)
        rows.sort("idx").select(cells.json_object(rows, [c.name for c in table.columns]).alias("value")).write.text(contained(folder, names[table.name]))
    return names


def script(data: Dataset, batch: int = 5000) -> DataFrame:
    """(step, part, statement): transactions in load order. Keys that break a cycle are inserted as null
    and updated last. Serial columns are left to the database, so their values must be 1, 2, ..."""
    for table in data.schema.tables:
        for c in table.columns:
            if c.serial and not cells.contiguous(data.rows(table.name), c.name).first()[0]:
                raise ExportError(f"{table.name}.{c.name}: accepted serial values have gaps, so the database would number rows anew")
    spark, out = next(iter(data.accepted.values())).sparkSession, []

    def line(step: int, part: int, text: str) -> DataFrame:
        return spark.range(1).select(F.lit(step).alias("step"), F.lit(part).cast("long").alias("part"), F.lit(text).alias("statement"))

    number = 0
    for step in data.steps:
        out.append(line(number, -1, f"BEGIN; {cells.comment(step.kind + ': ' + ', '.join(step.tables))}" + ("\nSET CONSTRAINTS ALL DEFERRED;" if step.kind == "deferred" else "")))
        for name in step.tables:
            table = data.schema.table(name)
            rows = data.rows(name)
            number += 1
            if step.kind == "update":
                made = cells.update_statements(rows, name, table.primary_key, step.columns)
                out.append(made.select(F.lit(number).alias("step"), F.lit(0).cast("long").alias("part"), "statement"))
                continue
            if step.kind != "deferred":
                rows = rows.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in data.updated.get(name, [])})
            columns = [c.name for c in table.columns if not c.serial]
            if not columns:
                made = rows.select(F.col("idx").alias("part"), F.lit(f"INSERT INTO {cells.identifier(name)} DEFAULT VALUES;").alias("statement"))
            else:
                dense = cells.insert_statements(_dense(rows), name, columns, "__n", batch)
                made = dense.select(F.col("batch").alias("part"), "statement")
            out.append(made.select(F.lit(number).alias("step"), F.col("part").cast("long"), "statement"))
        number += 1
        out.append(line(number, 0, "COMMIT;"))
        number += 1
    return reduce(DataFrame.unionByName, out)


def _dense(rows: DataFrame) -> DataFrame:
    from tessera.operators.ranks import numbered

    return numbered(rows, [F.col("idx")], "__n")


def write_sql(data: Dataset, path: str, batch: int = 5000) -> None:
    script(data, batch).sort("step", "part", "statement").select(F.col("statement").alias("value")).write.text(path)
