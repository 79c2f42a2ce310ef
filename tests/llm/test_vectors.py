"""Operators on vectors, and sharding, against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessera.llm import entry, hard_negatives, sharding, vector_codes
from tests.llm.conftest import broadcasts, got

SCHEMA = "vec_id long, embedding array<float>, label int, anchor long, lane int, score double, n int, rank int"


def vector_rows(n: int, width: int, seed: int, labels: int = 10) -> list[tuple]:
    rng = random.Random(seed)
    out = [(i, [float(np.float32(rng.gauss(0, 0.2))) for _ in range(width)], rng.randrange(labels)) for i in range(n)]
    out[3] = (3, None, 1)
    out[5] = (5, [0.1] * (width - 1) + [None], 1)
    out[6] = (6, [math.nan] + [0.1] * (width - 1), 1)
    out[8] = (8, [math.inf] + [0.1] * (width - 1), 1)
    out[9] = (9, out[10][1], None)
    for i in range(40, 60):  # ties, an anchor among them, and rows that repeat each other
        out[i] = (i, out[100][1], 4 if i % 2 else 6)
    return [*out, out[100], out[50], (200, out[11][1], 2), (None, out[12][1], 3)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 0.5, 3, 4) for r in rows], SCHEMA).repartition(3)


def plain_negatives(rows: list[tuple]) -> list[tuple]:
    known = {(i, label, tuple(math.floor(256 * x) for x in v)) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in known:
        if a[0] % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in known if b != a), key=lambda s: s[:2])
        for p, positive, _ in [s for s in scored if s[2] == a[1]][:5]:
            fits = [(-s, i) for s, i, label in scored if label != a[1] and 30 * -p <= 100 * -s <= 90 * -p]
            out += [(a[0], positive, rank, i, -p, s) for rank, (s, i) in enumerate(fits[:10], 1)]
    return sorted(out, key=repr)


NEGATIVES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("width", [7, 64])
def test_hard_negatives(spark, monkeypatch, width):
    rows = vector_rows(700, width, width)
    monkeypatch.setattr(hard_negatives, "ROWS", 50)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    want = plain_negatives(rows)
    assert len(want) > 100
    assert got(hard_negatives.mine(frame(spark, rows)), *NEGATIVES) == want


def test_hard_negatives_of_few_rows(spark):
    assert hard_negatives.mine(frame(spark, [])).count() == 0
    alone = [(0, [0.5, 0.5], 1), (1, [0.5, 0.5], 2)]
    assert hard_negatives.mine(frame(spark, alone)).count() == 0  # no positive
    short = [(0, [0.5, 0.5], 1), (1, [0.5], 1), (2, [0.25], 2), (3, [], 2), (4, [-0.5], 2)]
    assert got(hard_negatives.mine(frame(spark, short)), *NEGATIVES) == plain_short()


def plain_short() -> list[tuple]:
    """1's score with 0 is 128 * 128; 2's is half of it, 3's and 4's are below the window."""
    return [(0, 1, 1, 2, 16384, 8192)]


def test_lanes_of_anchors_are_not_broadcast(spark):
    """Anchors are copied for each lane, which Spark takes for as large as the anchors."""
    df = frame(spark, vector_rows(3000, 8, 7))
    assert broadcasts(hard_negatives.mine(df.select("vec_id", "label", "embedding"))) == 0


def test_planes_are_exact():
    rng = np.random.default_rng(3)
    for most in (1, 5, 3000, 2**20):
        q, x = rng.integers(-most, most + 1, (20, 9)), rng.integers(-most, most + 1, (300, 9))
        scores = hard_negatives.Scores(q, x, np.ones((20, 300), dtype=bool))
        want = q @ x.T
        low = np.partition(want, -4, axis=1)[:, -4].astype(float)
        a, r, score = scores.pairs(lambda: (low, np.full(20, np.inf)))  # noqa: B023
        assert (score == want[a, r]).all()
        assert {(i, j) for i, j in zip(a, r)} >= {(i, j) for i, j in np.argwhere(want >= low[:, None])}
        assert len(a) < 20 * 300 / 2 or most < 5
    with pytest.raises(ValueError):
        hard_negatives.Scores(np.full((1, 9), 2**40), np.full((1, 9), 2**30), np.ones((1, 1), dtype=bool))


def plain_codes(rows: list[tuple]):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    longest = max((len(r[1]) for r in kept), default=0)
    width = -(-longest // 4)
    ints = [([math.floor(1024 * x) for x in r[1]] + [0] * (4 * width))[: 4 * width] for r in kept]
    x = np.array(ints, dtype=np.int64).reshape(len(kept), 4, width)
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, ints[i]))[:256]
    books = [[x[i, k] for i in first] for k in range(4)]

    def near(k):
        away = ((x[:, k][:, None, :] - np.array(books[k])[None]) ** 2).sum(axis=2)
        return away.argmin(axis=1), away.min(axis=1)

    for _ in range(4):
        found = [near(k)[0] for k in range(4)]
        for k in range(4):
            for e in range(len(first)):
                if (mine := found[k] == e).any():
                    books[k][e] = x[mine, k].sum(axis=0) // mine.sum()
    last = [near(k) for k in range(4)]
    error = np.sum([a for _, a in last], axis=0)
    by_label = Counter()
    for r, e in zip(kept, error):
        by_label[r[2]] += int(e)
    sha = hashlib.sha256(",".join(str(int(v)) for book in books for e in book for v in e).encode()).hexdigest()
    out = [(r[0], "".join(f"{last[k][0][i]:02x}" for k in range(4)), int(error[i]), by_label[r[2]], sha) for i, r in enumerate(kept)]
    return sorted(out, key=repr)


CODES = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


@pytest.mark.parametrize(("n", "width"), [(900, 64), (300, 8), (120, 10)])
def test_vector_codes(spark, monkeypatch, n, width):
    rows = vector_rows(n, width, n)
    monkeypatch.setattr(vector_codes, "BATCH", 100)
    assert got(vector_codes.codes(frame(spark, rows)), *CODES) == plain_codes(rows)


def test_vector_codes_of_few_rows(spark):
    assert vector_codes.codes(frame(spark, [])).count() == 0
    short = [(0, [0.5, 0.5, 0.1], 1), (1, [0.5], 1), (None, [], None)]
    assert got(vector_codes.codes(frame(spark, short)), *CODES) == plain_codes(short)


def test_tree_finds_the_nearest_of_clustered_and_equal_entries():
    rng = np.random.default_rng(1)
    centres = rng.integers(-5000, 5000, (12, 6))
    entries = np.concatenate([centres[rng.integers(0, 12, 200)] + rng.integers(-40, 40, (200, 6)), np.repeat(centres[:4], 14, axis=0)])
    x = np.concatenate([entries[rng.integers(0, 256, 500)] + rng.integers(-60, 60, (500, 6)), entries, rng.integers(-9000, 9000, (300, 6))])
    away = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    index, best = vector_codes.Tree(entries).nearest(x)
    assert (best == away.min(axis=1)).all() and (index == away.argmin(axis=1)).all()
    visited = []
    plain_visit = vector_codes.Tree.visit
    try:
        vector_codes.Tree.visit = lambda self, x, n, rows, *a: (visited.append(len(rows) * len(self.members)), plain_visit(self, x, n, rows, *a))[1]
        vector_codes.Tree(entries).nearest(x[:500])
    finally:
        vector_codes.Tree.visit = plain_visit
    assert sum(visited) < 500 * 256 / 2  # most of a clustered codebook is never looked at


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_vector_codes"])
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    df = entry.queries()[name](spark, sf)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert got(df, *df.columns) == sorted(want.project(", ".join(df.columns)).fetchall(), key=repr)


def test_sharding(spark, docs, rows, empty):
    many = docs.unionByName(docs.limit(1).crossJoin(spark.range(3000)).drop("id"))  # one row makes up most of the table
    out = sharding.shard_rows(many, shards=7).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    hot = docs.limit(1).collect()[0]
    want[hot["doc_id"], len((hot["text"] or "").encode()) + 16, zlib.crc32((hot["text"] or "").encode())] += 3000
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    assert {(r["law"], r["grown_shard"], r["map_version"]) for r in out} == {("bytes", None, 1)}
    loads = Counter()
    for shard in range(7):
        mine = [r for r in out if r["shard"] == shard]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        loads[shard] = sum(r["size"] for r in mine)
    *others, heaviest = sorted(loads.values())
    assert others[-1] - others[0] <= 64 and heaviest - others[0] <= max(64, max(r["size"] for r in out))  # one text is longer than the mean
    assert len({(r["virtual_slot"], r["shard"]) for r in out}) == len({r["virtual_slot"] for r in out})
    assert sharding.shard_rows(empty).count() == 0
    turned = sharding.shard_rows(many.repartition(5), shards=7)
    assert Counter(tuple(r) for r in turned.collect()) == Counter(tuple(r) for r in out)  # however the table is cut


def test_slot_maps(spark, tmp_path):
    rng = np.random.default_rng(2)
    size = (rng.lognormal(7, 1.5, 2000)).astype(np.int64)
    size[:50] = 0
    first = sharding.initial(11, 2000)
    second = sharding.rebalanced(first, size)
    mean = size.sum() / 11
    assert second.loads(size).max() <= max(mean * 1.001, size.max())
    assert (first.shard_of == second.shard_of).sum() > 1200  # most slots stay
    third = sharding.grown(second, size)
    moved = second.shard_of != third.shard_of
    assert moved.any() and (third.shard_of[moved] == 11).all()
    assert abs(third.loads(size)[11] - size.sum() / 12) < 0.05 * size.sum() / 12
    for m in (first, second, third):
        sharding.save(m, spark, str(tmp_path / "map"))
    assert (sharding.load(spark, str(tmp_path / "map")).shard_of == third.shard_of).all()
    old = sharding.load(spark, str(tmp_path / "map"), 1)
    assert (old.shard_of == second.shard_of).all() and (old.version, old.shards) == (1, 11)
    again = sharding.rebalanced(second, size)
    assert (again.shard_of == second.shard_of).mean() > 0.99  # what is even stays
