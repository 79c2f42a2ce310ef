"""Order MinHash fingerprints of documents.

A text's k-mers are numbered by occurrence, so repeated k-mers are distinct elements. Each of `sketches`
hash functions selects the two smallest elements; their k-mers, kept in text order, are hashed to a
tuple of 16 bits. The share of equal tuples estimates a likeness that is sensitive to edit distance:
moved passages keep their k-mers but lose their order. Texts shorter than k are one k-mer; the empty
text has the fingerprint of no k-mers (all zero), like only to itself.

Each document's successor by (doc_id, hash of the text, text) is found without a global sort in one task: ids
are cut into ranges at approximate quantiles, an id that holds several quantiles again by the hash of the text,
every row goes to its range's partition, and the first row of each range is also sent to the range before it
(that of the first range to the last). Only these rows travel twice. Null texts count as empty; a null doc_id
comes before all others; of rows that repeat a doc_id, the smaller 64-bit hash of the text comes first; a table
of one row is its own successor; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

K = 12
SKETCHES = 64
_BLOCK = 1 << 17  # elements hashed at once


def _seeds(sketches: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229).integers(0, 1 << 32, size=(2, sketches), dtype=np.uint64).astype(np.uint32)
    return draw[0], draw[1] | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def kmers(text: str, k: int) -> np.ndarray:
    """64-bit hashes of the text's k-mers of code points, in text order."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if not len(points):
        return points
    k = min(k, len(points))
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        total = np.zeros(len(points) - k + 1, dtype=np.uint64)
        done, width, run, power = 0, 1, points * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1), base
        while True:  # run holds the hashes of all stretches of `width`
            if k >> (width.bit_length() - 1) & 1:
                total = total * power + run[done : done + len(total)]
                done += width
            if done == k:
                return _mix(total)
            run = run[:-width] * power + run[width:]
            power = power * power
            width *= 2


def occurrences(values: np.ndarray) -> np.ndarray:
    """For each place, how often its value came before."""
    n = len(values)
    bits = np.uint64(max(1, n.bit_length()))
    order = np.sort((values >> bits << bits) | np.arange(n, dtype=np.uint64))
    place = order & ((np.uint64(1) << bits) - np.uint64(1))
    group = order >> bits
    first = np.zeros(n, dtype=np.int64)
    starts = np.flatnonzero(group[1:] != group[:-1]) + 1
    first[starts] = starts
    np.maximum.accumulate(first, out=first)
    out = np.empty(n, dtype=np.uint64)
    out[place.astype(np.int64)] = (np.arange(n) - first).astype(np.uint64)
    return out


def order_minhash(text: str, k: int = K, sketches: int = SKETCHES) -> np.ndarray:
    """`sketches` tuples of 16 bits."""
    mers = kmers(text, k)
    n = len(mers)
    out = np.zeros(sketches, dtype=np.uint16)
    if not n:
        return out
    with np.errstate(over="ignore"):
        element = (_mix(mers + occurrences(mers) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
        masks, factors = _seeds(sketches)
        step = min(sketches, max(1, _BLOCK // n))
        space = np.empty((step, n), dtype=np.uint32)
        for at in range(0, sketches, step):
            some = slice(at, min(sketches, at + step))
            y = space[: some.stop - at]  # elements are mixed already: an odd factor after a mask reorders them
            np.bitwise_xor(element, masks[some, None], out=y)
            np.multiply(y, factors[some, None], out=y)
            rows = np.arange(len(y))
            a = y.argmin(axis=1)
            y[rows, a] = np.uint32(0xFFFFFFFF)
            b = y.argmin(axis=1)
            early, late = mers[np.minimum(a, b)], mers[np.maximum(a, b)]
            out[some] = (_mix(early * np.uint64(3) + _mix(late)) >> np.uint64(48)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """text with its last floor(n/2) code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_ranges(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows (at, h) with the number of their range in order of (at, h), and how many ranges there are: cuts are
    quantiles of `at`, found by binary search, and an id that is several of them is cut again by the hash h."""
    parts = common.partitions(rows.sparkSession)
    cuts = rows.agg(F.percentile_approx("at", [i / parts for i in range(1, parts)] or [0.5], 10000)).first()[0] or []
    held = Counter(float(c) for c in cuts)
    bounds = sorted(held)
    if not bounds:
        return rows.withColumn("range", F.lit(0)), 1
    exact = {float(c): int(c) for c in sorted(cuts, reverse=True)}
    lows = [-(2**63), *(exact[b] for b in bounds)]
    many = [1, *(held[b] for b in bounds)]
    starts = [sum(many[:i]) for i in range(len(many))]
    search = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="__at", outputCol="__found")
    rows = search.transform(rows.withColumn("__at", F.col("at").cast("double"))).withColumn("__found", F.col("__found").cast("int") + 1)
    at_low, starting, cut = (F.array(*[F.lit(x).cast("long") for x in column]) for column in (lows, starts, many))
    # doubles round: an id may lie right under the bound that it was found for
    rows = rows.withColumn("__found", F.col("__found") - (F.col("at") < F.element_at(at_low, F.col("__found"))).cast("int"))
    n = F.element_at(cut, F.col("__found"))
    part = F.least(F.floor((F.col("h") / 2.0**64 + 0.5) * n), n - 1)
    inside = F.when(F.col("at") == F.element_at(at_low, F.col("__found")), part).otherwise(n - 1)
    return rows.withColumn("range", (F.element_at(starting, F.col("__found")) + inside).cast("int")).drop("__at", "__found"), sum(many)


def with_successors(docs: DataFrame) -> DataFrame:
    """(range, extra, at, h, doc_id, text): each partition one range in order of (doc_id, hash of the text, text),
    then the row that follows its last (extra 1). An id that many rows share spans several ranges; rows that share
    the text as well stay together, and only one row travels twice from any range."""
    rows = common.texts(docs).withColumn("at", F.coalesce("doc_id", F.lit(-(2**63)).cast("long"))).withColumn("h", F.xxhash64("text"))
    rows, count = in_ranges(rows)
    firsts = rows.groupBy("range").agg(F.min(F.struct("at", "h", "text", "doc_id")).alias("f"))
    filled = sorted(r["range"] for r in rows.select("range").distinct().collect())  # a row for each range
    before = {b: a for a, b in zip([*filled[-1:], *filled], filled)}
    columns = ["range", "extra", "at", "h", "doc_id", "text"]
    rows = rows.withColumn("extra", F.lit(0)).select(*columns)
    if before:
        prior = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("range"))
        extra = firsts.select(prior.alias("range"), F.lit(1).alias("extra"), "f.at", "f.h", "f.doc_id", "f.text")
        rows = rows.unionByName(extra)
    return rows.repartitionById(count, F.col("range")).sortWithinPartitions("extra", "at", "h", "text")


def fingerprints(docs: DataFrame, k: int = K, sketches: int = SKETCHES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            for extra, doc_id, text in zip(*(common.each(batch.column(c)) for c in ("extra", "doc_id", "text"))):
                mark = order_minhash(text, k, sketches) if last is not None or not extra else None
                if last is not None:
                    old_id, old, own = last
                    changed = edited(old, text)
                    other = order_minhash(changed, k, sketches)
                    digest = hashlib.sha256(changed.encode()).hexdigest()
                    out.append((old_id, len(old), digest, own.tobytes().hex(), other.tobytes().hex(), likeness(own, other), likeness(own, mark)))
                last = None if extra else (doc_id, text, mark)
            columns = zip(*out) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_successors(docs).mapInArrow(run, schema)
