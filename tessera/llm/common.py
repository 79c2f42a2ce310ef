"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) of every row; a null text counts as empty. Other columns are left behind,
    so their names can't clash with an operator's own."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def each(column: pa.Array) -> Iterator:
    """The column's values one by one, so that a batch of long texts isn't held twice."""
    return (x.as_py() for x in column)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, so that what is made of one stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def slices_by_size(batch: pa.RecordBatch, column: int, rows: int = 256, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most so many rows, and of so many bytes of a text column or one row."""
    lengths, start, held = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), 0, 0
    for i, n in enumerate(lengths):
        if i > start and (i - start >= rows or held + n > size):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster names in
    spark.checkpoint.dir; only where that is unset (tests in local mode) a temporary one serves."""
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None):
        _own_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _own_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return context.getCheckpointDir()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of joins that shuffle and sort both sides. Spark takes what a Python function or an explode makes for
    as large as their input, so a side that they make many times larger would be broadcast, through the driver."""
    return df.hint("merge")


def look_up(rows: DataFrame, found: DataFrame, key: list[str], row_id: str, leaves: int) -> DataFrame:
    """rows left-joined with found (one row for each key), for keys of which one may hold a large
    part of the rows: rows are dealt to leaves by their id, each leaf asks once for each of its keys,
    and the answers join back inside the leaf."""
    dealt = rows.withColumn("__leaf", F.pmod(F.xxhash64(F.col(row_id)), F.lit(leaves)))
    asked = dealt.select("__leaf", *key).distinct().join(found, key, "left")
    return dealt.join(asked, ["__leaf", *key], "left").drop("__leaf")


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 4; the rows with remainder 2 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    """Whether a row is held out; one without an id is not."""
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def new_path(spark: SparkSession, name: str) -> str:
    """A path that isn't there yet, in the shared folder of spark.checkpoint.dir."""
    top = spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark)
    return f"{top.rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder of spark.checkpoint.dir and read again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
