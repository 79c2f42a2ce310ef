"""Packing of token sequences into windows by best-fit decreasing.

A document's ids and an end id are cut: while more than a window is left, a full window comes off;
what remains is packed whole. Pieces are dealt by a hash of their place and their ids' checksum, so that a
null or repeated doc_id doesn't fill one group, to groups of about `group` pieces, and each group arrives at
its task sorted by falling length, ties by place and ids. A segment tree over remaining
capacities 0 to `window` counts the open windows of each; one descent finds the smallest capacity that
holds the piece, the tightest open window. So a task keeps open windows only, no texts or ids, and each
group leaves at most a few windows half empty.

Null and empty texts have one id, the end id. Rows that repeat a doc_id are packed like any others; only rows
equal in doc_id and text are alike in every place, and they share a group, which takes constant memory. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, tokens

WINDOW = 2048
END_ID = 1
GROUP = 2048
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def pieces(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): ids are unsigned 16-bit, little-endian, as the
    vocabulary has fewer than 65,536."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(common.each(batch.column(0)), common.each(batch.column(1))):
                ids = np.array([*tokens.encode(text), end_id], dtype="<u2")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    rows.append((doc_id, start, len(piece), len(ids), piece.tobytes()))
            doc, start, length, total, data = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in (doc, start, length, total)), pa.array(data, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "ids"],
            )

    return common.texts(docs).mapInArrow(run, PIECES)


class OpenWindows:
    """Open windows by remaining capacity: a segment tree of counts over capacities 0..window, and a
    stack of windows for each capacity."""

    def __init__(self, window: int):
        self.window = window
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.stacks: dict[int, list[int]] = {}
        self.opened = 0

    def _change(self, capacity: int, by: int) -> None:
        at = capacity + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The smallest capacity, at least length, of which a window is open."""
        at = length + self.size
        if self.count[at]:
            return length
        while at > 1:  # up to the first right sibling that holds a window, then down its left edge
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset) of a piece."""
        capacity = self.tightest(length)
        if capacity is None:
            capacity, number = self.window, self.opened
            self.opened += 1
        else:
            number = self.stacks[capacity].pop()
            self._change(capacity, -1)
        if left := capacity - length:
            self.stacks.setdefault(left, []).append(number)
            self._change(left, 1)
        return number, self.window - capacity


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, sequence_id, offset), a row for each piece; ids are
    unsigned 32-bit, little-endian. sequence_id holds the group above its low 32 bits."""
    groups = max(1, -(-docs.count() // group))
    cut = pieces(docs, window, end_id).withColumn("group", F.pmod(F.xxhash64("doc_id", "start", F.crc32("ids")), F.lit(groups)))
    dealt = cut.repartition(common.partitions(docs.sparkSession), "group").sortWithinPartitions("group", F.desc("length"), "doc_id", "start", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, windows = None, OpenWindows(window)
        for batch in common.slices(batches):
            sequence, offset = [], []
            for number, length in zip(batch.column("group").to_pylist(), batch.column("length").to_pylist()):
                if number != current:
                    current, windows = number, OpenWindows(window)
                place, at = windows.place(length)
                sequence.append(number << 32 | place)
                offset.append(at)
            wide = [np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in common.each(batch.column("ids"))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(wide, pa.binary()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"],
            )

    return dealt.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def packed_digests(docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
