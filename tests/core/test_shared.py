"""Keys that share columns: groups chosen jointly, strategies with capacities, null masks."""

from __future__ import annotations

import random
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from tessera.functions.draws import Cell, permuted
from tessera.operators import assign, ranks, shared
from tessera.plans.dataset import generate
from tessera.sources.config import read_config_text
from tessera.sources.ddl import read_ddl

TWO = """
CREATE TABLE a (tenant_id int NOT NULL, id int NOT NULL, PRIMARY KEY (tenant_id, id));
CREATE TABLE b (tenant_id int NOT NULL, id int NOT NULL, PRIMARY KEY (tenant_id, id));
CREATE TABLE c (id int PRIMARY KEY, tenant_id int NOT NULL, a_id int {a}, b_id int {b},
  FOREIGN KEY (tenant_id, a_id) REFERENCES a(tenant_id, id), FOREIGN KEY (tenant_id, b_id) REFERENCES b(tenant_id, id));
"""


def made(spark, c: str, a: str = "rows: 2", b: str = "rows: 2", null_a: str = "NOT NULL", null_b: str = "NOT NULL", seed: int = 7, tenants_a="{generator: sequence}", tenants_b="{generator: sequence}"):
    table = lambda rows, tenants: f"{{{rows}, columns: {{tenant_id: {tenants}, id: {{generator: sequence, params: {{start: 10}}}}}}}}"
    text = f"seed: {seed}\ntables:\n  a: {table(a, tenants_a)}\n  b: {table(b, tenants_b)}\n  c: {{{c}}}\n"
    return generate(spark, read_ddl(TWO.format(a=null_a, b=null_b)), read_config_text(text))


def right(data, n: int) -> list:
    """All rows there, and both keys of each row of its tenant."""
    rows = data.rows("c").collect()
    assert len(rows) == n and data.quarantine["c"].count() == 0
    for name in "ab":
        keys = {(r["tenant_id"], r["id"]) for r in data.rows(name).collect()}
        assert all(r[f"{name}_id"] is None or (r["tenant_id"], r[f"{name}_id"]) in keys for r in rows)
    return rows


def test_all_rows_fall_into_groups_that_every_key_has(spark):
    """b has parents in few of a's tenants."""
    some = "{generator: choice, params: {values: [3, 4]}}"
    right(made(spark, "rows: 60", a="rows: 20", b="rows: 6", tenants_b=some), 60)
    with pytest.raises(assign.InfeasibleError, match="no group"):
        made(spark, "rows: 10", a="rows: 2", b="rows: 3", tenants_b="{generator: choice, params: {values: [9]}}")


@pytest.mark.parametrize("seed", [2])
def test_two_quotas_are_met_jointly(spark, seed):
    rows = right(made(spark, "rows: 2, fk: {a_id: {strategy: quota, min: 1, max: 1}, b_id: {strategy: quota, min: 1, max: 1}}", seed=seed), 2)
    assert len({(r["tenant_id"], r["a_id"]) for r in rows}) == len({(r["tenant_id"], r["b_id"]) for r in rows}) == 2
    rows = right(made(spark, "rows: 2, fk: {a_id: {strategy: quota, min: 0, max: 2}, b_id: {strategy: unique_subset}}", seed=seed), 2)
    assert {r["tenant_id"] for r in rows} == {1, 2}


def test_one_to_one_and_quotas_hold_within_tenants(spark):
    """Tenants of several parents; each strategy keeps its promise over all of them."""
    three = "{generator: choice, params: {values: [1, 2, 3]}}"
    data = made(spark, "rows: 30, fk: {a_id: {strategy: unique_subset}, b_id: {strategy: quota, min: 1, max: 4}}", a="rows: 40", b="rows: 14", tenants_a=three, tenants_b=three)
    rows = right(data, 30)
    assert max(Counter((r["tenant_id"], r["a_id"]) for r in rows).values()) == 1
    degrees = Counter((r["tenant_id"], r["b_id"]) for r in rows)
    assert len(degrees) == 14 and set(degrees.values()) <= {1, 2, 3, 4}
    tenants = made(spark, "rows: 90, fk: {a_id: {strategy: zipf, s: 1.5}}", a="rows: 60", b="rows: 9", tenants_a=three, tenants_b=three)
    popular = Counter((r["tenant_id"], r["a_id"]) for r in right(tenants, 90)).most_common()
    assert popular[0][1] >= 10 and len(popular) > 10


def test_infeasible_quotas_are_named_before_any_row(spark):
    one = "{generator: choice, params: {values: [1]}}"
    quota = "rows: 2, fk: {a_id: {strategy: quota, min: 1, max: 1}, b_id: {strategy: quota, min: 1, max: 1}}"
    with pytest.raises(assign.InfeasibleError, match="c: 2 rows with keys that share tenant_id.*quota.*tenant_id = 2"):
        made(spark, quota, b="rows: 1", tenants_b=one)
    with pytest.raises(assign.InfeasibleError, match="c: 5 rows"):
        made(spark, quota.replace("rows: 2", "rows: 5"))


def test_nulls_of_one_key_keep_the_tenant(spark):
    rows = right(made(spark, "rows: 40, fk: {b_id: {strategy: uniform, null_ratio: 0.5}}", a="rows: 4", b="rows: 4", null_b=""), 40)
    assert 8 < sum(r["b_id"] is None for r in rows) < 32 and all(r["a_id"] is not None for r in rows)


@pytest.mark.parametrize("seed", [18])
def test_masks_of_two_nullable_quotas(spark, seed):
    quota = "{{strategy: quota, min: {}, max: {}, null_ratio: {}}}"
    fk = lambda low, high, ra=0.5, rb=0.5: f"fk: {{a_id: {quota.format(low, high, ra)}, b_id: {quota.format(low, high, rb)}}}"
    both = {"null_a": "", "null_b": "", "seed": seed}
    rows = right(made(spark, f"rows: 20, {fk(0, 20)}", **both), 20)
    assert any((r["a_id"] is None) != (r["b_id"] is None) for r in rows)
    rows = right(made(spark, f"rows: 20, {fk(0, 20, 0.0, 1.0)}", **both), 20)
    assert all(r["a_id"] is not None and r["b_id"] is None for r in rows) and {r["tenant_id"] for r in rows} == {1, 2}
    rows = right(made(spark, f"rows: 20, {fk(1, 20)}", **both), 20)
    for name in "ab":
        degrees = Counter((r["tenant_id"], r[f"{name}_id"]) for r in rows if r[f"{name}_id"] is not None)
        assert len(degrees) == 2 and max(degrees.values()) <= 20


def test_nullable_quota_beside_one_to_one(spark):
    """As many children as one-to-one parents, one for each tenant, and a quota that half of the rows have."""
    fk = "fk: {a_id: {strategy: quota, min: 0, max: 2, null_ratio: 0.5}, b_id: {strategy: unique_subset}}"
    rows = right(made(spark, f"rows: 200, {fk}", a="rows: 200", b="rows: 200", null_a=""), 200)
    assert {r["tenant_id"] for r in rows} == set(range(1, 201))
    assert 50 <= sum(r["a_id"] is not None for r in rows) <= 150
    with pytest.raises(assign.InfeasibleError, match="unique_subset"):
        made(spark, f"rows: 20, {fk}", a="rows: 20", b="rows: 19", null_a="")


def test_components_are_apart(spark):
    data = generate(spark, read_ddl("""
    CREATE TABLE a (x int NOT NULL, id int NOT NULL, PRIMARY KEY (x, id)); CREATE TABLE b (x int NOT NULL, id int NOT NULL, PRIMARY KEY (x, id));
    CREATE TABLE d (y int NOT NULL, id int NOT NULL, PRIMARY KEY (y, id)); CREATE TABLE e (y int NOT NULL, id int NOT NULL, PRIMARY KEY (y, id));
    CREATE TABLE c (id int PRIMARY KEY, x int NOT NULL, a_id int NOT NULL, b_id int NOT NULL, y int NOT NULL, d_id int NOT NULL, e_id int NOT NULL,
      FOREIGN KEY (x, a_id) REFERENCES a(x, id), FOREIGN KEY (x, b_id) REFERENCES b(x, id), FOREIGN KEY (y, d_id) REFERENCES d(y, id), FOREIGN KEY (y, e_id) REFERENCES e(y, id));
    """), read_config_text("tables: {" + ", ".join(f"{t}: {{rows: 2, columns: {{{g}: {{generator: sequence}}}}}}" for t, g in zip("abde", "xxyy")) + ", c: {rows: 2, fk: {a_id: {strategy: quota, min: 1, max: 1}, b_id: {strategy: quota, min: 1, max: 1}, d_id: {strategy: quota, min: 1, max: 1}, e_id: {strategy: quota, min: 1, max: 1}}}}"))  # fmt: skip
    rows = data.rows("c").collect()
    assert len(rows) == 2 and {r["x"] for r in rows} == {r["y"] for r in rows} and len({r["x"] for r in rows}) == 2
    assert shared.components([["x", "a"], ["y", "d"], ["x", "b"], ["y", "e"], ["z"]]) == [([0, 2], ["x"]), ([1, 3], ["y"]), ([4], ["z"])]


def counts_exist(groups, both: int, a: int, b: int) -> bool:
    """By trying all divisions: groups are ((la, ha), (lb, hb))."""
    reach = {(0, 0, 0)}
    for (la, ha), (lb, hb) in groups:
        own = [(w, x, y) for w, x, y in product(range(both + 1), range(a + 1), range(b + 1)) if la <= w + x <= ha and lb <= w + y <= hb]
        reach = {(w + u, x + v, y + z) for w, x, y in reach for u, v, z in own if w + u <= both and x + v <= a and y + z <= b}
    return (both, a, b) in reach


def test_masks_against_all_divisions(spark):
    """Small cases with limits: an assignment is found exactly where one exists."""
    rng, outcomes = random.Random(5), Counter()
    for _ in range(18):
        groups = []
        for _ in range(rng.randrange(1, 4)):
            la, lb = rng.randrange(0, 3), rng.randrange(0, 3)
            groups.append(((la, la + rng.randrange(0, 3)), (lb, lb + rng.randrange(0, 3))))
        both, a, b = rng.randrange(0, 5), rng.randrange(0, 3), rng.randrange(0, 3)
        table = spark.createDataFrame([(i, *x, *y) for i, (x, y) in enumerate(groups)], "gid long, la long, ha long, lb long, hb long")
        joint = shared._Joint.__new__(shared._Joint)
        joint.seed, joint.table, joint.n, joint.group, joint.sides = 1, "t", both + a + b, ["g"], []
        try:
            found = joint.two(table, (F.col("la"), F.col("ha")), (F.col("lb"), F.col("hb")), both, a, b).collect()
        except assign.InfeasibleError:
            found = None
        assert (found is not None) == counts_exist(groups, both, a, b), (groups, both, a, b)
        outcomes[found is not None] += 1
        if found:
            assert (sum(r["__w"] for r in found), sum(r["__a"] for r in found), sum(r["__b"] for r in found)) == (both, a, b)
            assert all(r["la"] <= r["__w"] + r["__a"] <= r["ha"] and r["lb"] <= r["__w"] + r["__b"] <= r["hb"] for r in found)
    assert min(outcomes.values()) >= 3


def test_apportioned(spark):
    rng = random.Random(1)
    for n, most in ((1, 3), (5, 9), (40, 10**9)):
        rows = [(i, low := rng.randrange(0, most), low + rng.randrange(0, most)) for i in range(n)]
        groups = spark.createDataFrame(rows, "gid long, low long, high long")
        least, top = sum(r[1] for r in rows), sum(r[2] for r in rows)
        for total in (least, top, (least + top) // 2, least + (top > least)):
            out = shared.apportioned(groups, F.col("low"), F.col("high"), total, Cell(1, "t", "g", F.col("gid")).u(), "n", "no").collect()
            assert sum(r["n"] for r in out) == total and all(r["low"] <= r["n"] <= r["high"] for r in out)
            inner = [r["n"] for r in out if r["low"] < r["n"] < r["high"]]
            assert not inner or max(inner) - min(inner) <= 1
        for total in (least - 1, top + 1):
            with pytest.raises(assign.InfeasibleError):
                shared.apportioned(groups, F.col("low"), F.col("high"), total, F.col("gid"), "n", "no")


def compound(spark, keys: str, rows: int, sizes=(6, 6, 6), more: str = "", null: str = "NOT NULL"):
    tables = " ".join(f"CREATE TABLE {t} (id serial PRIMARY KEY);" for t in "abc")
    sql = f"{tables} CREATE TABLE x (id serial PRIMARY KEY, a_id int {null} REFERENCES a(id), b_id int NOT NULL REFERENCES b(id), c_id int NOT NULL REFERENCES c(id), note text, {keys});"
    config = f"seed: 11\ntables: {{a: {{rows: {sizes[0]}}}, b: {{rows: {sizes[1]}}}, c: {{rows: {sizes[2]}}}, x: {{rows: {rows}{more}}}}}"
    data = generate(spark, read_ddl(sql), read_config_text(config))
    assert data.quarantine["x"].count() == 0
    return data.rows("x").collect()


def test_keys_that_overlap(spark):
    """Two keys in one of them, and three that are pairwise, up to the last tuple."""
    rows = compound(spark, "UNIQUE (a_id, b_id), UNIQUE (b_id, a_id), UNIQUE (b_id, c_id)", 30)
    assert len(rows) == 30 == len({(r["a_id"], r["b_id"]) for r in rows}) == len({(r["b_id"], r["c_id"]) for r in rows})
    assert min(len({r[c] for r in rows}) for c in ("a_id", "b_id", "c_id")) > 4
    side = lambda i, n: shared.Side(spark.range(n).select(F.lit(0).alias("g"), F.col("id").alias("pidx"), F.col("id").alias(f"v{i}")), f"s{i}")
    pairs = [[0, 1], [1, 2], [0, 2]]
    out = shared.distinct_in_keys(spark.range(36).withColumnRenamed("id", "idx"), 36, [side(i, 6) for i in range(3)], ["g"], pairs, 1, "t").collect()
    assert all(len({(r[f"v{i}"], r[f"v{j}"]) for r in out}) == 36 for i, j in pairs)
    with pytest.raises(assign.InfeasibleError, match=r"t: 5 rows need distinct tuples of \(s1\), \(s2\), there are 4"):
        shared.distinct_in_keys(spark.range(5).withColumnRenamed("id", "idx"), 5, [side(0, 9), side(1, 2), side(2, 2)], ["g"], pairs[:2], 1, "t")


def test_nulls_in_a_compound_key(spark):
    rows = compound(spark, "UNIQUE (a_id, b_id)", 36, more=", fk: {a_id: {strategy: uniform, null_ratio: 0.5}}", null="")
    known = [(r["a_id"], r["b_id"]) for r in rows if r["a_id"] is not None]
    assert len(rows) == 36 and len(known) == len(set(known)) and 8 < len(known) < 28


def test_keys_in_rounds(spark):
    """Four sides, all pairs of which are keys: no grid has enough cells."""
    sides = [shared.Side(spark.range(5).select(F.lit(0).alias("g"), F.col("id").alias("pidx"), F.col("id").alias(f"v{i}")), f"s{i}") for i in range(4)]
    keys = [[i, j] for i in range(4) for j in range(i)]
    assert not shared.grids(4, keys) and shared.grids(3, keys[:3])
    out = shared.distinct_in_keys(spark.range(3).withColumnRenamed("id", "idx"), 3, sides, ["g"], keys, 1, "t").collect()
    assert len(out) == 3 and all(len({(r[f"v{i}"], r[f"v{j}"]) for r in out}) == 3 for i, j in keys)


def test_keys_that_overlap_within_tenants(spark):
    tables = " ".join(f"CREATE TABLE {t} (tenant_id int NOT NULL, id int NOT NULL, PRIMARY KEY (tenant_id, id));" for t in "abc")
    fks = ", ".join(f"FOREIGN KEY (tenant_id, {t}_id) REFERENCES {t}(tenant_id, id)" for t in "abc")
    sql = f"{tables} CREATE TABLE x (id serial PRIMARY KEY, tenant_id int NOT NULL, a_id int NOT NULL, b_id int NOT NULL, c_id int NOT NULL, UNIQUE (tenant_id, a_id, b_id), UNIQUE (tenant_id, b_id, c_id), {fks});"
    tenants = "columns: {tenant_id: {generator: choice, params: {values: [1, 2, 3]}}}"
    data = generate(spark, read_ddl(sql), read_config_text(f"seed: 2\ntables: {{a: {{rows: 12, {tenants}}}, b: {{rows: 12, {tenants}}}, c: {{rows: 12, {tenants}}}, x: {{rows: 30}}}}"))
    rows = data.rows("x").collect()
    assert len(rows) == 30 == len({(r["tenant_id"], r["a_id"], r["b_id"]) for r in rows}) == len({(r["tenant_id"], r["b_id"], r["c_id"]) for r in rows})
    for t in "abc":
        assert {(r["tenant_id"], r[f"{t}_id"]) for r in rows} <= {(r["tenant_id"], r["id"]) for r in data.rows(t).collect()}


def test_permutations(spark):
    """One-to-one for any size, the size and the key may differ by row, and all places are about equally likely."""
    sizes = [*range(1, 40), 97, 1000, 1024]
    rows = spark.createDataFrame([(n, i) for n in sizes for i in range(n)], "n long, x long")
    cell = lambda seed: Cell(seed, "t", "c", F.col("x"))
    out = rows.withColumn("y", permuted(cell(3), F.col("x"), F.col("n"), "p", F.col("n").cast("string")))
    assert out.groupBy("n").agg(F.count_distinct("y").alias("d"), F.min("y").alias("a"), F.max("y").alias("b")).where("d <> n or a <> 0 or b <> n - 1").count() == 0
    seeds = 600
    for n in (3, 5, 12):
        pairs = spark.range(seeds * n).select(F.col("id") % n, F.expr(f"id div {n}")).toDF("x", "s")
        out = pairs.withColumn("y", permuted(cell(1), F.col("x"), n, "p", F.col("s").cast("string"))).groupBy("x", "y").count().collect()
        seen = {(r["x"], r["y"]): r["count"] for r in out}
        chi = sum((seen.get((x, y), 0) - seeds / n) ** 2 / (seeds / n) for x in range(n) for y in range(n))
        assert chi < (n - 1) ** 2 + 5 * (2 * (n - 1) ** 2) ** 0.5, (n, chi)


def test_tuples_beyond_a_long(spark):
    rows = spark.range(2000).withColumnRenamed("id", "idx")
    out = assign.tuples(rows, [10**6] * 3, ["a", "b", "c"], 1, "t").collect()
    assert len({(r["a"], r["b"], r["c"]) for r in out}) == 2000 and max(r["a"] for r in out) > 900_000 > 100_000 > min(r["b"] for r in out)
    wide = assign.tuples(rows, [10**9, 10**9, 10**9, 3], ["a", "b", "c", "d"], 1, "t").collect()
    assert len({(r["a"], r["b"], r["c"], r["d"]) for r in wide}) == 2000 and len({r["a"] for r in wide}) > 1900 and {r["d"] for r in wide} == {0, 1, 2}
    assert all(0 <= r[c] < 10**9 for r in wide for c in "abc")
    full = assign.tuples(spark.range(24).withColumnRenamed("id", "idx"), [2, 3, 4], ["a", "b", "c"], 1, "t").collect()
    assert len({(r["a"], r["b"], r["c"]) for r in full}) == 24


def test_points_stay_spread_however_few_the_ranges(spark, monkeypatch):
    """A few points' bytes may be much work: they aren't gathered in the task of the ranges."""
    ranges = spark.range(0, 5, 1, 1).select((F.col("id") * 200).alias("low"), (F.col("id") * 200 + 200).alias("high"), F.col("id").alias("g"))
    points = spark.range(0, 1000, 1, 8).withColumnRenamed("id", "at")
    for few in (ranks.FEW, 1):
        monkeypatch.setattr(ranks, "FEW", few)
        found = ranks.range_lookup(points, "at", ranges, 1000)
        assert sorted((r["at"], r["g"]) for r in found.collect()) == [(i, i // 200) for i in range(1000)]
        assert found.select(F.spark_partition_id()).distinct().count() >= 4
