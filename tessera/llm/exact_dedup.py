"""Exact deduplication by a tree-merge of sorted digest runs.

Every document's normalised text gives a digest. Documents are dealt to leaves by their id; each leaf
collapses its copies and leaves sorted runs with one row per digest. Then partitions exchange runs in rounds
along a binomial tree of fan-in `fan_in`: the runs of neighbouring nodes meet in the task of their parent,
which merges them, keeping for every digest the smallest identifier and the number of copies. A run is cut
into shards by digest, so that no task ever holds more than a shard of the corpus, the root included. A hot
group of copies is one row in each run it takes part in.

A run travels in blocks of up to `BLOCK` rows. A merging task gets its blocks in order of their first digest,
so it opens a block when the merge reaches it, and holds only blocks that overlap the merge's place.
Digests are verified: at every level rows merge only if SHA-256, the length and an independent 64-bit hash
all agree; a SHA-256 that comes with two lengths or hashes makes two groups.

Null texts count as empty, and empty texts are copies of each other. Of rows that repeat both the
smallest doc_id and the text, one stays; a null doc_id is over all others. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

SPACE = r"[\x20\x09-\x0D]+"
DIGEST = ["text_sha256", "check", "length"]
BLOCK = 1024
#: A block of a run: its first digest, and the rows' columns as arrays.
RUN = "shard int, node long, first string, text_sha256 array<string>, check array<long>, length array<long>, keep_id array<long>, group_size array<long>"
MERGED = "text_sha256 string, check long, length long, keep_id long, group_size long"
Row = tuple[str, int, int, int | None, int]  # digest, smallest id, copies


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digest(text: Column) -> list[Column]:
    norm = normalised(text)
    return [F.sha2(norm, 256).alias("text_sha256"), F.xxhash64(norm).alias("check"), F.length(norm).cast("long").alias("length")]


def _batch(blocks: list[tuple[int, int, list[Row]]]) -> pa.RecordBatch:
    lists = [pa.list_(pa.string()), *[pa.list_(pa.int64())] * 4]
    columns = [pa.array([x[0] for x in blocks], pa.int32()), pa.array([x[1] for x in blocks], pa.int64()), pa.array([x[2][0][0] for x in blocks], pa.string())]
    columns += [pa.array([[row[i] for row in x[2]] for x in blocks], t) for i, t in enumerate(lists)]
    return pa.RecordBatch.from_arrays(columns, ["shard", "node", "first", *DIGEST, "keep_id", "group_size"])


def _blocks(rows: Iterator[tuple[int, int, Row]]) -> Iterator[pa.RecordBatch]:
    """Blocks of the rows (shard, node, row) of sorted runs."""
    for (shard, node), run in groupby(rows, key=lambda x: x[:2]):
        block: list[Row] = []
        for *_, row in run:
            block.append(row)
            if len(block) == BLOCK:
                yield _batch([(shard, node, block)])
                block = []
        if block:
            yield _batch([(shard, node, block)])


def collapse(rows: Iterator[Row]) -> Iterator[Row]:
    """One row for each digest of rows in order of digest. Rows are one digest only if hash, check and length
    agree; a missing id is over all others."""
    for digest, same in groupby(rows, key=lambda r: r[:3]):
        keep, copies = None, 0
        for *_, keep_id, n in same:
            copies += n
            if keep is None or keep_id is not None and keep_id < keep:
                keep = keep_id
        yield (*digest, keep, copies)


def merge_blocks(blocks: Iterator[tuple[str, Iterator[Row]]]) -> Iterator[Row]:
    """Multiway merge of sorted blocks (first digest, rows) that come in order of their first digest: a block is
    opened when the merge gets there."""
    heap: list[tuple] = []  # (digest, number of the block, row, rest of the block)
    for number, (first, rows) in enumerate(blocks):
        while heap and heap[0][0][0] < first:
            yield _advance(heap)
        row = next(rows)
        heapq.heappush(heap, (row[:3], number, row, rows))
    while heap:
        yield _advance(heap)


def _advance(heap: list[tuple]) -> Row:
    _, number, row, rows = heap[0]
    following = next(rows, None)
    if following is None:
        heapq.heappop(heap)
    else:
        heapq.heapreplace(heap, (following[:3], number, following, rows))
    return row


def _rows_of(batch: pa.RecordBatch, i: int) -> Iterator[Row]:
    return zip(*(batch.column(c)[i].as_py() for c in [*DIGEST, "keep_id", "group_size"]))


def sorted_runs(rows: DataFrame) -> DataFrame:
    """Blocks of each task's sorted runs; rows: (shard, node, *DIGEST, keep_id, group_size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[int, int, Row]]:
            for batch in batches:
                for shard, node, *row in zip(*(c.to_pylist() for c in batch.columns)):
                    yield shard, node, tuple(row)

        yield from _blocks(each())

    columns = ["shard", "node", *DIGEST, "keep_id", "group_size"]
    return rows.select(*columns).sortWithinPartitions("shard", "node", *DIGEST).mapInArrow(run, RUN)


def merge_round(runs: DataFrame, parts: int, fan_in: int) -> DataFrame:
    """The runs of each parent: those of its fan_in children merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple[int, int, str, Iterator[Row]]]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield batch.column("shard")[i].as_py(), batch.column("node")[i].as_py(), batch.column("first")[i].as_py(), _rows_of(batch, i)

        def merged() -> Iterator[tuple[int, int, Row]]:
            for (shard, node), some in groupby(blocks(), key=lambda x: x[:2]):
                for row in collapse(merge_blocks((first, rows) for *_, first, rows in some)):
                    yield shard, node, row

        yield from _blocks(merged())

    met = runs.withColumn("node", F.floor(F.col("node") / fan_in)).repartition(parts, "shard", "node")
    return met.sortWithinPartitions("shard", "node", "first").mapInArrow(run, RUN)


def merge_runs(rows: DataFrame, leaves: int, fan_in: int = 8) -> DataFrame:
    """rows: (node, *DIGEST, keep_id, group_size), one row for each node and digest.
    Returns (*DIGEST, keep_id, group_size), one row for each digest."""
    parts = max(leaves, common.partitions(rows.sparkSession))
    runs = sorted_runs(rows.withColumn("shard", F.pmod(F.col("check"), F.lit(4 * parts)).cast("int")))
    width = leaves
    while True:  # one round at least: a leaf may have left several runs
        width = -(-width // fan_in)
        runs = merge_round(runs, parts, fan_in)
        if width == 1:
            break
    fields = [f.split()[0] for f in MERGED.split(", ")]
    return runs.select(F.explode(F.arrays_zip(*fields)).alias("row")).select(*[F.col(f"row.{f}") for f in fields])


def exact_groups(docs: DataFrame, leaves: int | None = None, fan_in: int = 8) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs (doc_id, text)."""
    leaves = leaves or max(16, common.partitions(docs.sparkSession))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *digest(F.col("text")))
    rows = common.checkpointed(rows.withColumn("node", F.pmod(F.xxhash64("doc_id"), F.lit(leaves))))
    runs = rows.groupBy("node", *DIGEST).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    merged = merge_runs(runs, leaves, fan_in)
    answers = runs.select("node", *DIGEST).join(merged, DIGEST)
    first = Window.partitionBy("node", *DIGEST, "doc_id").orderBy("doc_id")
    return rows.join(answers, ["node", *DIGEST]).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(first) == 1)).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with docs' own columns. Only survivors' ids and digests join the
    texts, on a key that holds one document, so groups of copies can't pile up."""
    names = docs.columns
    named = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    found = exact_groups(docs).where("kept").select(named.alias("__id"), F.col("text_sha256").alias("__sha"))
    rows = docs.withColumns({"__id": named, "__sha": F.sha2(normalised(F.col("text")), 256)})
    return rows.join(found, ["__id", "__sha"], "left_semi").dropDuplicates(["__id", "__sha"]).select(*names)
