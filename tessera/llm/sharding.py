"""Shards by fixed virtual slots and a versioned map from slots to shards.

A record's hash gives one of SLOTS virtual slots, which never change. Which shard a slot belongs to is in a map
with a version: version 0 deals slots in turn, and each rebalancing edits the map by the bytes that the slots
hold. Shards above the mean give up the slots that bring them down to it, these go to the lightest shards, the largest
first, and then the heaviest and the lightest shard move or swap slots while that brings them nearer. Only the
rows of an edited slot move. A map has SLOTS rows, whatever the number of records, so it is edited on the driver
and broadcast; it is stored as a table of all versions. Adding a shard (`grown`) moves slots into the new shard only.

The law is `bytes`: sizes are near equal, as near as the largest single record lets them be. The hash covers id, size
and checksum of the text, and for rows equal in all of these their number among themselves, so that a repeated
id or row doesn't fill one slot. A row's place in its shard is the rows of the shard's lower slots plus its rank
in its own, so no task sorts a shard.

A null text has no bytes; a null id is an id like any other; an empty table gives an empty result."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.operators.assign import positions

SLOTS = 8192
SHARDS = 40
RECORD = 16  # bytes of a record besides its text
KEY = ["bare", "id", "size", "text_crc32"]


@dataclass(frozen=True)
class SlotMap:
    version: int
    shards: int
    shard_of: np.ndarray  # by slot

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.shards, slot, int(shard)) for slot, shard in enumerate(self.shard_of)]
        return spark.createDataFrame(rows, "version int, shards int, virtual_slot int, shard int")

    def loads(self, size: np.ndarray) -> np.ndarray:
        return np.bincount(self.shard_of, weights=size, minlength=self.shards).astype(np.int64)


def initial(shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
    return SlotMap(0, shards, np.arange(slots) % shards)


def save(slot_map: SlotMap, spark: SparkSession, path: str) -> None:
    slot_map.frame(spark).coalesce(1).write.mode("append").parquet(path)


def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A version of a stored map, by default the last."""
    stored = spark.read.parquet(path)
    wanted = stored.agg(F.max("version")).first()[0] if version is None else version
    rows = stored.where(F.col("version") == wanted).orderBy("virtual_slot").collect()  # a row for each slot
    return SlotMap(wanted, rows[0]["shards"], np.array([r["shard"] for r in rows]))


def given_up(slots: np.ndarray, size: np.ndarray, excess: float) -> list[int]:
    """Slots that together hold at most `excess` bytes, the largest that still fit first."""
    out = []
    for slot in slots[np.argsort(-size[slots], kind="stable")]:
        if 0 < size[slot] <= excess:
            out.append(int(slot))
            excess -= size[slot]
    return out


def nearer(heavy: np.ndarray, light: np.ndarray, size: np.ndarray, gap: int) -> tuple[int, int | None] | None:
    """A slot of the heavy shard to move, and one of the light shard to take for it or None, so that what
    moves is nearest to half the gap; None if nothing narrows the gap."""
    given = heavy[size[heavy] > 0]
    back = np.concatenate([[-1], light[size[light] > 0]]).astype(np.int64)
    worth = np.where(back < 0, 0, size[back])
    order = np.argsort(worth, kind="stable")
    best, found = gap, None
    at = np.searchsorted(worth[order], size[given] - gap / 2)
    for shift in (-1, 0):
        near = order[np.clip(at + shift, 0, len(order) - 1)]
        moved = size[given] - worth[near]
        left = np.where((moved > 0) & (moved < gap), np.abs(gap - 2 * moved), gap)
        if len(given) and left.min() < best:
            k = int(left.argmin())
            best, found = int(left[k]), (int(given[k]), int(back[near[k]]) if back[near[k]] >= 0 else None)
    return found


def rebalanced(old: SlotMap, size: np.ndarray) -> SlotMap:
    """The next version of a map, its slots' bytes dealt evenly; slots stay where they are if they can."""
    shard_of, loads = old.shard_of.copy(), old.loads(size)
    mean = loads.sum() / old.shards
    loose = []
    for shard in np.flatnonzero(loads > mean):
        out = given_up(np.flatnonzero(shard_of == shard), size, loads[shard] - mean)
        loads[shard] -= size[out].sum()
        loose += out
    heap = [(int(load), shard) for shard, load in enumerate(loads)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda s: (-size[s], s)):
        load, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (load + int(size[slot]), shard))
    loads = SlotMap(0, old.shards, shard_of).loads(size)
    stuck: set[int] = set()
    for _ in range(50 * old.shards):
        free = [s for s in range(old.shards) if s not in stuck]
        if len(free) < 2:
            break
        heavy, light = max(free, key=lambda s: loads[s]), int(loads.argmin())
        pair = nearer(np.flatnonzero(shard_of == heavy), np.flatnonzero(shard_of == light), size, int(loads[heavy] - loads[light])) if heavy != light else None
        if pair is None:
            stuck.add(heavy)
            continue
        moves = [(pair[0], heavy, light)] + ([(pair[1], light, heavy)] if pair[1] is not None else [])
        for slot, a, b in moves:
            shard_of[slot] = b
            loads[a], loads[b] = loads[a] - size[slot], loads[b] + size[slot]
    return SlotMap(old.version + 1, old.shards, shard_of)


def grown(old: SlotMap, size: np.ndarray) -> SlotMap:
    """The next version with one shard more. Each shard gives slots for its share of the new one; no slot moves
    between the old shards."""
    shard_of, loads = old.shard_of.copy(), old.loads(size)
    for shard in range(old.shards):
        out = given_up(np.flatnonzero(shard_of == shard), size, loads[shard] - loads.sum() / (old.shards + 1))
        shard_of[out] = old.shards
    return SlotMap(old.version + 1, old.shards + 1, shard_of)


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, order) of each row; `order` tells the rows of a slot apart."""
    text = F.coalesce("text", F.lit(""))
    records = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + RECORD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    records = common.written(records.withColumn("row", F.monotonically_increasing_id()), "records")  # the texts are read once
    keyed = records.withColumns({"bare": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0))})
    again = positions(keyed, KEY, ["row"], "again").drop("n", "row")
    slot = F.pmod(F.xxhash64(*KEY, "again"), F.lit(slots)).cast("int")
    return again.withColumn("virtual_slot", slot)


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, rows) by slot."""
    size, count = np.zeros(slots, dtype=np.int64), np.zeros(slots, dtype=np.int64)
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("count")).collect():  # a row for each slot
        size[r["virtual_slot"]], count[r["virtual_slot"]] = r["size"], r["count"]
    return size, count


def placed(rows: DataFrame, count: np.ndarray, slot_map: SlotMap) -> DataFrame:
    """rows with shard and slot, the row's place in its shard."""
    order = np.lexsort((np.arange(len(count)), slot_map.shard_of))
    below = np.cumsum(count[order]) - count[order]
    first = np.concatenate([[True], np.diff(slot_map.shard_of[order]) > 0])
    start = np.zeros(len(count), dtype=np.int64)
    start[order] = below - np.repeat(below[first], np.diff(np.append(np.flatnonzero(first), len(order))))
    starts = rows.sparkSession.createDataFrame([(s, int(slot_map.shard_of[s]), int(x)) for s, x in enumerate(start)], "virtual_slot int, shard int, start long")
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(*KEY, "again")) - 1
    return rows.withColumn("rank", rank).join(F.broadcast(starts), "virtual_slot").withColumn("slot", F.col("start") + F.col("rank")).drop("start", "rank")


def shard_rows(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version): docs dealt to shards by
    the second version of a map, which is stored with the first in the shared folder."""
    spark = docs.sparkSession
    rows = common.written(slotted(docs, slots), "slotted")
    size, count = slot_sizes(rows, slots)
    first, path = initial(shards, slots), common.new_path(spark, "slot-map")
    save(first, spark, path)
    save(rebalanced(first, size), spark, path)
    current = load(spark, path)
    return placed(rows, count, current).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(current.version).alias("map_version")
    )
