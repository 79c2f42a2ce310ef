"""Compression of vectors to codes: a codebook of whole-number entries for each part position, refined in rounds.

A round assigns every part to its codebook's nearest entry and moves each entry to the floor of its parts' mean.
The nearest entry is found in a vantage-point tree over the position's entries: a node holds an entry and the
least and greatest distance from it to the entries of each of its two halves, rounded outwards. By the triangle
inequality a half whose nearest possible entry is farther than the best one found can be left out; a half that
might hold an equally near one is visited (comparisons aren't strict). A batch of parts goes down the tree
together, nearer halves first. Distances that decide are squared ones in whole numbers, ties go to the lower index.

The entries, 256 for each position whatever the number of rows, are the only thing that the driver holds; tasks
sum up their parts by entry before anything is sent.

Rows whose vector is null or has a component that is null or not finite are dropped. A null id is kept, and comes
after all others; rows that repeat an id are rows of their own, ordered by components for the first codebooks.
With fewer than 256 rows the codebooks are smaller. Vectors whose length isn't that of the longest one, or no multiple
of the number of parts, are filled up with zeros. Equal labels share a label_error, null ones too. An empty table
gives an empty result. Squared distances must be exact in a double (below 2^53), else the job fails."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, vectors

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
BATCH = 8192  # rows that go down a tree together
LEAF = 16
SLACK = 1e-12  # relative; far above the error of a square root


def squares(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)


class Tree:
    """A vantage-point tree over the rows of a matrix of whole numbers."""

    def __init__(self, entries: np.ndarray, members: np.ndarray | None = None):
        self.members = np.arange(len(entries)) if members is None else members  # by rising index
        self.halves: list[tuple[Tree, float, float]] = []
        if len(self.members) > LEAF:
            self.centre, rest = int(self.members[0]), self.members[1:]
            away = squares(entries[rest] - entries[self.centre])
            near = np.zeros(len(rest), dtype=bool)
            near[np.argsort(away, kind="stable")[: len(rest) // 2]] = True
            for half in (near, ~near):
                least, most = np.sqrt(away[half].min()) * (1 - SLACK), np.sqrt(away[half].max()) * (1 + SLACK)
                self.halves.append((Tree(entries, rest[half]), least, most))
            self.members = self.members[:1]
        self.entries = entries[self.members].astype(np.float64).T
        self.norms = squares(self.entries.T)

    def visit(self, x: np.ndarray, norms: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        """Update best (squared distances) and index for some rows of x."""
        away = norms[rows, None] + self.norms - 2 * (x[rows] @ self.entries)
        place = away.argmin(axis=1)
        least, who = away[np.arange(len(rows)), place], self.members[place]
        better = (least < best[rows]) | (least == best[rows]) & (who < index[rows])
        best[rows[better]], index[rows[better]] = least[better], who[better]
        if not self.halves:
            return
        from_centre = np.sqrt(least)  # an inner node has one entry
        low, high = from_centre * (1 - SLACK), from_centre * (1 + SLACK)
        bounds = [np.maximum(np.maximum(low - most, least_ - high), 0) for _, least_, most in self.halves]
        inner = from_centre <= (self.halves[0][2] + self.halves[1][1]) / 2
        for first in (True, False):
            for k, (half, _, _) in enumerate(self.halves):
                turn = inner == (k == 0) if first else inner != (k == 0)
                turn &= bounds[k] <= np.sqrt(best[rows]) * (1 + SLACK)
                if turn.any():
                    half.visit(x, norms, rows[turn], best, index)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the entry nearest to each row of x."""
        x = x.astype(np.float64)
        best, index = np.full(len(x), np.inf), np.full(len(x), np.iinfo(np.int64).max)
        norms = squares(x)
        if len(x):
            self.visit(x, norms, np.arange(len(x)), best, index)
        return index, best.astype(np.int64)


def exact(x: np.ndarray, width: int) -> np.ndarray:
    if 4 * width * int(np.abs(x).max(initial=0)) ** 2 >= 2**53:
        raise ValueError("squared distances of 2^53 or more aren't exact")
    return x


def parted(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """(rows, parts, width) of a list column."""
    return exact(vectors.padded(vectors.matrix(column), parts * width), width).reshape(len(column), parts, width)


def sums(rows: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(part, entry, n, total) for the entries that are some part's nearest: each task's own sums. codebooks:
    parts x entries x width."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(c) for c in codebooks]
        n, total = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, width), dtype=np.int64)
        for block in vectors.blocks(batches, BATCH):
            x = parted(block.column("v"), parts, width)
            for k, tree in enumerate(trees):
                index, _ = tree.nearest(x[:, k])
                n[k] += np.bincount(index, minlength=entries)
                np.add.at(total[k], index, x[:, k])
        k, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(e), pa.array(n[k, e]), pa.array(list(total[k, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    return rows.select("v").mapInArrow(run, "part long, entry long, n long, total array<long>")


def refined(rows: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after a round: a row for each entry and component goes to the driver."""
    each = sums(rows, codebooks).select("part", "entry", "n", F.posexplode("total").alias("place", "x"))
    found = each.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).toPandas()
    out = codebooks.copy()
    part, entry, place, n, x = (found[c].to_numpy(dtype=np.int64) for c in ("part", "entry", "place", "n", "x"))
    out[part, entry, place] = x // n  # rounds down
    return out


def assigned(rows: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error)."""
    parts, _, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(c) for c in codebooks]
        for block in vectors.blocks(batches, BATCH):
            x = parted(block.column("v"), parts, width)
            found = [tree.nearest(x[:, k]) for k, tree in enumerate(trees)]
            code = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
            error = np.sum([away for _, away in found], axis=0, dtype=np.int64)
            text = pa.array([bytes(c).hex() for c in code], pa.string())
            yield pa.RecordBatch.from_arrays([block.column("vec_id"), block.column("label"), text, pa.array(error)], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "v").mapInArrow(run, "vec_id long, label long, code string, error long")


def first_codebooks(rows: DataFrame, parts: int, width: int, entries: int = ENTRIES) -> np.ndarray:
    """The parts of the rows with the smallest ids."""
    least = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").toArrow()
    x = parted(least.column("v").combine_chunks(), parts, width)
    return np.ascontiguousarray(x.transpose(1, 0, 2))


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x width) over all rows (vec_id, v)."""
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    codebooks = first_codebooks(rows, parts, -(-longest // parts), entries)
    for _ in range(rounds):
        codebooks = refined(rows, codebooks)
    return codebooks


def codes(table: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256). table: vec_id, label, embedding."""
    rows = common.written(vectors.rows_of(table, SCALE), "vectors")
    codebooks = fit(rows)
    found = common.written(assigned(rows, codebooks), "codes")
    keyed = found.select("vec_id", "code", "error", F.col("label").isNull().alias("bare"), F.coalesce("label", F.lit(0)).alias("label"))
    keyed = keyed.withColumn("row", F.monotonically_increasing_id())
    by_label = keyed.groupBy("bare", "label").agg(F.sum("error").alias("label_error"))
    out = common.look_up(keyed, by_label, ["bare", "label"], "row", common.partitions(table.sparkSession))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
