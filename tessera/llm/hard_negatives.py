"""Hard negatives by bit-sliced whole-number products.

Components are whole numbers floor(scale * x); a score is the inner product of a row with an anchor. In two's
complement a component is a sum of bit-planes. A block of rows is multiplied with a block of anchors plane
by plane, the most significant first. With k planes to come, each component can still grow by 0 to 2^k - 1, so
a score lies between what is summed up and that plus 2^k - 1 times the anchor's negative or positive
components. A pair whose interval can't reach the worst score that is still wanted, or lies above the window
that is asked for, is dropped; when few pairs of a block are left, the planes to come are summed for these alone.
Comparisons keep ties, and what survives all planes has its exact score.

Anchors are in blocks, rows in blocks, and each block of anchors goes to each lane of rows, so a task holds two
blocks and the best rows of one block of anchors. The results of lanes meet by anchor, cut to the wanted
number before they are sent. The first pass finds an anchor's positives, the second its negatives in all of
the windows that the positives' scores give.

Rows without a label, an id, a vector or with a component that is null or not finite take no part. Rows equal in
id, label and components are one row; rows that share only their id are different rows, and each may be the
other's positive. Ties go to the smaller id. An anchor without another row of its label, and a window without
rows, have no result. A vector shorter than another counts as filled up with zeros. An empty table gives an empty
result. Scores must be exact in a double (below 2^53); a block that could exceed this is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common, vectors

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
SHARE = (30, 90)  # of a positive's score, per cent
ROWS = 2048  # of a block
ANCHORS = 512
LANE = 16  # blocks of rows in a lane, when there are many
GOLDEN = (5**0.5 - 1) / 2  # steps of this part of a circle are spread evenly
SPARSE = 1 / 16  # with a smaller share of pairs left, they are summed one by one
BLOCK = "lane int, kind string, n int, ids binary, labels binary, v binary"


class Scores:
    """Products of a block of anchors with a block of rows, tightened plane by plane.

    wanted() gives for each anchor the least score that is still of use and the greatest one; pairs beyond these
    are dropped. allowed has the pairs that count at all."""

    def __init__(self, anchors: np.ndarray, rows: np.ndarray, allowed: np.ndarray):
        width = max(anchors.shape[1], rows.shape[1])
        self.q, self.x = vectors.padded(anchors, width), vectors.padded(rows, width)
        self.bits = 1 + max(int(v).bit_length() for v in (self.x.max(initial=0), -1 - self.x.min(initial=0)))
        most = int(np.abs(self.q).sum(axis=1).max(initial=0)) << self.bits
        if most >= 2**53:
            raise ValueError("scores of 2^53 or more aren't exact")
        self.kind = np.float32 if most < 2**24 else np.float64
        self.plus, self.minus = np.maximum(self.q, 0).sum(axis=1), np.minimum(self.q, 0).sum(axis=1)
        self.allowed = allowed

    def plane(self, k: int, rows: np.ndarray | None = None) -> np.ndarray:
        return ((self.x if rows is None else self.x[rows]) >> k) & 1

    def pairs(self, wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all pairs that may be of use, scores exact."""
        q, total, k = self.q.astype(self.kind).T, np.zeros(self.allowed.shape, dtype=self.kind), self.bits
        low, high = wanted()
        alive = self.allowed
        while k:
            k -= 1
            weight = -(1 << k) if k == self.bits - 1 else 1 << k
            total += ((self.plane(k).astype(self.kind) @ q) * self.kind(weight)).T
            rest = (1 << k) - 1
            up, down = low - rest * self.plus, high - rest * self.minus  # what the sum must reach, and not exceed
            if (total.min(axis=1, initial=np.inf) >= up).all() and (total.max(axis=1, initial=-np.inf) <= down).all():
                continue
            alive = self.allowed & (total >= up[:, None]) & (total <= down[:, None])
            if np.count_nonzero(alive) <= SPARSE * alive.size:
                break
        a, r = np.nonzero(alive)
        score = total[a, r].astype(np.int64)
        while k:  # the planes to come, for the pairs that are left
            k -= 1
            for start in range(0, len(a), 65_536):
                cut = slice(start, start + 65_536)
                score[cut] += (self.plane(k, r[cut]) * self.q[a[cut]]).sum(axis=1) << k
            rest = (1 << k) - 1
            keep = (score + rest * self.plus[a] >= low[a]) & (score + rest * self.minus[a] <= high[a])
            a, r, score = a[keep], r[keep], score[keep]
        return a, r, score


class Best:
    """The first `size` rows of each list (an anchor's, or one of its windows), by falling score and rising id."""

    def __init__(self, lists: int, size: int):
        self.size, self.lists = size, lists
        self.at = self.ids = self.scores = np.zeros(0, dtype=np.int64)
        self.least = np.full(lists, -np.inf)

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        at, ids, scores = np.concatenate([self.at, at]), np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        self.at, self.ids, self.scores = (x[place < self.size] for x in (at, ids, scores))
        last = place == self.size - 1
        self.least[at[last]] = scores[last]


def _blocks(rows: DataFrame, lanes: int, size: int, extra: list[str] = []) -> DataFrame:
    """Rows packed in blocks of `size`; blocks are dealt to lanes by their place in their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = int(TaskContext.get().partitionId() * GOLDEN % 1 * lanes)  # else tasks of few blocks all fill the first lanes
        for i, block in enumerate(vectors.blocks(batches, size)):
            kind, data = vectors.packed(vectors.matrix(block.column("v")))
            ids, labels = (block.column(c).to_numpy().astype("<i8").tobytes() for c in ("vec_id", "label"))
            more = [pa.array([vectors.matrix(block.column(c)).astype("<i8").tobytes() if pa.types.is_list(block.column(c).type) else block.column(c).to_numpy().astype("<i8").tobytes()], pa.binary()) for c in extra]
            yield pa.RecordBatch.from_arrays(
                [pa.array([(first + i) % lanes], pa.int32()), pa.array([kind]), pa.array([block.num_rows], pa.int32()), *(pa.array([x], pa.binary()) for x in (ids, labels, data)), *more],
                ["lane", "kind", "n", "ids", "labels", "v", *extra],
            )

    return rows.select("vec_id", "label", "v", *extra).mapInArrow(run, BLOCK + "".join(f", {c} binary" for c in extra))


def _met(rows: DataFrame, anchors: DataFrame, lanes: int, count: int, extra: list[str]) -> DataFrame:
    """Each block of anchors with each block of rows. Both are shuffled to lanes: the copies of the anchors, one
    for each lane, may be large, and a broadcast would hold them in the driver. Lanes keep partitions of their own, as
    a task's work isn't told by its bytes."""
    own = _blocks(anchors.repartition(max(1, -(-count // ANCHORS))), 1, ANCHORS, extra)
    own = own.select(*[F.col(c).alias(f"a_{c}") for c in own.columns if c != "lane"])
    own = own.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    return common.shuffled(own.repartition(lanes, "lane")).join(_blocks(rows, lanes, ROWS).repartition(lanes, "lane"), "lane")


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<i8").astype(np.int64)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, vec_id, score): each block of anchors' best rows of the anchor's label, of the blocks of
    rows that come after one another."""
    now, best, names = None, None, None
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(names[best.at]), pa.array(best.ids), pa.array(best.scores)], ["anchor", "vec_id", "score"])
    for pair in _pairs(batches):
        if pair["a_anchor"] != now:
            if best is not None:
                yield flush()
            now, names = pair["a_anchor"], _longs(pair["a_anchor"])
            best = Best(len(names), POSITIVES)
            q, q_ids, q_labels = vectors.unpacked(pair["a_kind"], pair["a_v"], pair["a_n"]), _longs(pair["a_ids"]), _longs(pair["a_labels"])
        x, ids, labels = vectors.unpacked(pair["kind"], pair["v"], pair["n"]), _longs(pair["ids"]), _longs(pair["labels"])
        for label in np.intersect1d(q_labels, labels):
            mine, theirs = np.flatnonzero(q_labels == label), np.flatnonzero(labels == label)
            allowed = np.ones((len(mine), len(theirs)), dtype=bool)
            for a, r in np.argwhere(q_ids[mine][:, None] == ids[theirs]):  # the anchor itself
                width = max(q.shape[1], x.shape[1])
                allowed[a, r] = (vectors.padded(q[mine[a : a + 1]], width) != vectors.padded(x[theirs[r : r + 1]], width)).any()
            scores = Scores(q[mine], x[theirs], allowed)
            a, r, score = scores.pairs(lambda: (best.least[mine], np.full(len(mine), np.inf)))  # noqa: B023
            best.add(mine[a], ids[theirs[r]], score)
    if best is not None:
        yield flush()


def _negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, goal, vec_id, score): for each score of a positive, the best rows of other labels whose scores
    are in the goal's window. An anchor has POSITIVES goals at most; a goal of -1 is none."""
    now, best, names = None, None, None

    def flush() -> pa.RecordBatch:
        a, j = np.divmod(best.at, goals.shape[1])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (names[a], goals[a, j], best.ids, best.scores)], ["anchor", "goal", "vec_id", "score"])

    for pair in _pairs(batches):
        if pair["a_anchor"] != now:
            if best is not None:
                yield flush()
            now, names = pair["a_anchor"], _longs(pair["a_anchor"])
            q, q_labels = vectors.unpacked(pair["a_kind"], pair["a_v"], pair["a_n"]), _longs(pair["a_labels"])
            goals = _longs(pair["a_goals"]).reshape(len(names), POSITIVES)
            low, high = -(-SHARE[0] * goals // 100), SHARE[1] * goals // 100
            low, high = np.where(goals < 0, 2**60, low), np.where(goals < 0, -(2**60), high)
            best = Best(goals.size, NEGATIVES)

        def wanted() -> tuple[np.ndarray, np.ndarray]:
            return np.maximum(best.least.reshape(goals.shape), low).min(axis=1), high.max(axis=1).astype(float)  # noqa: B023

        x, ids, labels = vectors.unpacked(pair["kind"], pair["v"], pair["n"]), _longs(pair["ids"]), _longs(pair["labels"])
        a, r, score = Scores(q, x, q_labels[:, None] != labels).pairs(wanted)
        for j in range(goals.shape[1]):
            fits = (score >= low[a, j]) & (score <= high[a, j]) & (score >= best.least[a * goals.shape[1] + j])
            best.add(a[fits] * goals.shape[1] + j, ids[r[fits]], score[fits])
    if best is not None:
        yield flush()


def _first(found: DataFrame, key: list[str], size: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= size)


def mine(table: DataFrame, every: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor, a row whose id
    is divisible by `every`, its best POSITIVES rows of the same label, and for each of these the best NEGATIVES
    rows of other labels whose score is within SHARE of the positive's. table: vec_id, label, embedding."""
    spark = table.sparkSession
    rows = vectors.rows_of(table.where("vec_id is not null and label is not null"), SCALE).distinct()
    rows = common.written(rows, "vectors")
    anchors = rows.where(F.col("vec_id") % every == 0).withColumn("anchor", F.monotonically_increasing_id())
    anchors = common.written(anchors, "anchors")
    n, count = rows.count(), anchors.count()
    lanes = max(1, -(-n // (ROWS * LANE)), min(-(-n // ROWS), 4 * spark.sparkContext.defaultParallelism))
    positives = _met(rows, anchors, lanes, count, ["anchor"]).mapInArrow(_positives, "anchor long, vec_id long, score long")
    positives = common.written(_first(positives, ["anchor"], POSITIVES), "positives")
    goals = positives.groupBy("anchor").agg(F.sort_array(F.collect_set("score")).alias("goals"))  # POSITIVES at most
    filled = F.concat("goals", F.array_repeat(F.lit(-1).cast("long"), F.lit(POSITIVES) - F.size("goals")))
    asking = anchors.join(common.shuffled(goals.withColumn("goals", filled)), "anchor")
    negatives = _met(rows, asking, lanes, count, ["anchor", "goals"]).mapInArrow(_negatives, "anchor long, goal long, vec_id long, score long")
    negatives = _first(negatives, ["anchor", "goal"], NEGATIVES)
    named = positives.join(common.shuffled(anchors.select("anchor", F.col("vec_id").alias("anchor_id"))), "anchor")
    named = named.select("anchor", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("goal"))
    return named.join(common.shuffled(negatives), ["anchor", "goal"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("goal").alias("positive_score"), F.col("score").alias("negative_score")
    )


def relabelled(table: DataFrame) -> DataFrame:
    """The rows of the query: where the id is divisible by 7, the label is the next of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return table.select("vec_id", moved.alias("label"), "embedding")
