"""SimHash near-duplicates found by Golay-code fuzzy hashing.

Fingerprint: the text's 3-word shingles (A-Z lower-cased, words between the six ASCII white-space
characters, repeats included) are hashed by XXH64 with seed 42; bit b is 1 if it is set in over half
of the hashes. A text without words has fingerprint zero.

Links: fingerprints that differ in at most 2 of 64 bits. The fingerprint is cut into segments of 22,
21 and 21 bits, each zero-padded to 23, the length of the binary Golay code. Among three segments with
at most 2 errors there always is one without error whose successor has at most one, for
(0,1), (1,2), (2,0): with errors in one segment only, take the two others; with one error each in two
segments, take the clean one and its successor. So each of the three families has keys of the first
segment as it is and of codeword indices near the second: a vector within distance 2 of a codeword has
that codeword's index alone, a vector at distance 3 has that and the five codewords at distance 4. Two
vectors that differ in at most one bit share an index. Candidates with a common key are verified.

Groups: exact copies of a fingerprint are one node. Buckets of up to `bucket` nodes are compared in
place and give a spanning forest of their links. All nodes of larger buckets take an exact path of
linear size: two fingerprints are within 2 bits if and only if their balls of radius one meet, so each
node names its 65 ball points and joins the smallest node of each. Components come from alternating
large-star and small-star rounds, each cut by a checkpoint. All joins shuffle both sides: a node has some 16 keys or 65
points, so what Spark takes for small by the nodes may be large, and nothing of it passes through the driver.

Null texts count as empty. A row's group depends on its text alone: rows that repeat a doc_id may be in
different groups, and rows with a null doc_id are grouped too (component_id is null if all are).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

SEGMENTS = ((0, 22), (22, 21), (43, 21))
FAMILIES = ((0, 1), (1, 2), (2, 0))
#: Generator polynomial of the binary [23, 12, 7] Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
MAX_BITS = 2
BUCKET = 64


def word_hashes(text: str) -> list[int]:
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.encode().lower().split()
    if len(words) < 3:
        return [digest(b" ".join(words), 42)] if words else []
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return [digest(joined[a:b], 42) for a, b in zip(starts[:-2].tolist(), ends[2:].tolist())]


def simhash(text: str) -> int:
    hashes = word_hashes(text)
    if not hashes:
        return 0
    count = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 8192):
        block = np.array(hashes[i : i + 8192], dtype=">u8")
        count += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(t) for t in common.each(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return common.texts(docs).mapInArrow(run, "doc_id long, fp long")


def _remainder(values: np.ndarray) -> np.ndarray:
    values = values.copy()
    for bit in range(22, 10, -1):
        values ^= np.where(values >> bit & 1, GOLAY << (bit - 11), 0)
    return values


@lru_cache(maxsize=1)
def golay_errors() -> np.ndarray:
    """For each of the 2048 syndromes the error patterns to the codewords nearby, padded with -1: one
    of weight up to 2, or one of weight 3 and the five of weight 4 that share its syndrome."""
    from itertools import combinations

    table = np.full((2048, 6), -1, dtype=np.int64)
    used = np.zeros(2048, dtype=np.int64)
    weight = np.zeros(2048, dtype=np.int64)
    for size in range(5):
        patterns = np.array([sum(1 << i for i in c) for c in combinations(range(23), size)], dtype=np.int64)
        for s, p in zip(_remainder(patterns).tolist(), patterns.tolist()):
            if used[s] == 0 or size == 4 and weight[s] == 3:
                table[s, used[s]] = p
                used[s] += 1
                weight[s] = max(weight[s], min(size, 3))
    return table


def golay_indices(vectors: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices near each 23-bit vector, -1 where there are fewer."""
    errors = table[_remainder(vectors)]
    return np.where(errors >= 0, (vectors[:, None] ^ errors) >> 11, -1)


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of each fingerprint (uint64)."""
    table = golay_errors()
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    rows, keys = [], []
    for k, (exact, near) in enumerate(FAMILIES):
        index = golay_indices(parts[near], table)
        row, col = np.nonzero(index >= 0)
        rows.append(row)
        keys.append((k << 34) | (parts[exact][row] << 12) | index[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def keyed(nodes: DataFrame) -> DataFrame:
    """nodes (fp) -> (key, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row, key = bucket_keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])

    return nodes.select("fp").mapInArrow(run, "key long, fp long")


def _forest(fp: list[int]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links within one bucket."""
    f = np.array(fp, dtype=np.int64).view(np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(f[:, None] ^ f[None, :]) <= MAX_BITS, 1))
    root = list(range(len(fp)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    edges = []
    for i, j in zip(a.tolist(), b.tolist()):
        x, y = find(i), find(j)
        if x != y:
            root[y] = x
            edges.append((fp[i], fp[j]))
    return edges


def bucket_links(sorted_keys: DataFrame) -> DataFrame:
    """Links within buckets of bounded size; sorted_keys (key, fp) has each bucket's rows together in one
    partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        for batch in _and_end(batches):
            if batch is not None:
                for column, values in zip(held, batch.columns):
                    column.extend(values.to_pylist())
            key = np.array(held[0], dtype=np.int64)
            cuts = np.flatnonzero(np.diff(key)) + 1
            bounds = [0, *cuts.tolist()] + ([len(key)] if batch is None and len(key) else [])
            edges = [e for i, j in zip(bounds, bounds[1:]) if j - i > 1 for e in _forest(held[1][i:j])]
            if len(bounds) > 1:
                held = tuple(column[bounds[-1] :] for column in held)
            if edges:
                a, b = zip(*edges)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return sorted_keys.mapInArrow(run, "a long, b long")


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def ball_links(nodes: DataFrame) -> DataFrame:
    """Links of the nodes (fp) by common points of their balls of radius one; no pairs are made."""
    points = nodes.select("fp", F.explode(F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return points.join(common.shuffled(least), "point").where("a <> fp").select("a", F.col("fp").alias("b"))


def links(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) whose components are those of all links between the nodes (fp)."""
    parts = common.partitions(nodes.sparkSession)
    keys = keyed(nodes)
    sizes = keys.groupBy("key").count().where("count > 1")
    shared = keys.join(common.shuffled(sizes), "key")
    small = shared.where(F.col("count") <= bucket).select("key", "fp")
    hot = shared.where(F.col("count") > bucket).select("fp").distinct()
    small = small.repartition(parts, "key").sortWithinPartitions("key", "fp")
    return bucket_links(small).union(ball_links(hot))


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (a, b) can reach."""

    def oriented(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def large_star(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # a component's smallest node may have all its edges, so they are dealt by their other end
        told = common.look_up(common.shuffled(both.where("b > a")), least, ["a"], "b", 16)
        return oriented(told.select(F.col("b").alias("a"), F.col("m").alias("b")))

    def small_star(e: DataFrame) -> DataFrame:
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        moved = e.join(common.shuffled(least), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return oriented(moved.union(least.select("a", F.col("m").alias("b"))))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    edges = common.checkpointed(oriented(edges))
    before = state(edges)
    for _ in range(max_rounds):
        edges = common.checkpointed(small_star(large_star(edges)))
        now = state(edges)
        if now == before:
            roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
        before = now
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text)."""
    fps = common.checkpointed(fingerprints(docs))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(nodes)).withColumnRenamed("node", "fp")
    linked = nodes.join(common.shuffled(found), "fp", "left")
    least = linked.where("component is not null").groupBy("component").agg(F.min("first").alias("least"))
    named = linked.join(common.shuffled(least), "component", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    rows = common.look_up(common.shuffled(fps), named, ["fp"], "doc_id", max(64, common.partitions(docs.sparkSession)))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group of docs, that of the smallest doc_id, with docs' columns.
    Rows that repeat a doc_id stay or go together; rows with a null doc_id stay."""
    names = docs.columns
    kept = near_groups(docs).where("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct()
    rows = docs.withColumn("__id", F.col("doc_id").cast("long"))
    named = rows.join(common.shuffled(kept), "__id", "left_semi").select(*names)
    return named.unionByName(docs.where(F.col("doc_id").isNull()))
