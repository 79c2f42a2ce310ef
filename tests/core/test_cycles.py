"""Cycles of foreign keys: which keys break them, and the rows that come of it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.plans.dataset import generate
from tessera.plans.schema import SchemaError, load_steps
from tessera.sources.config import read_config_text
from tessera.sources.ddl import read_ddl

RING = """
CREATE TABLE p (id serial PRIMARY KEY, q_id int NOT NULL REFERENCES q(id) {d});
CREATE TABLE q (id serial PRIMARY KEY, r_id int NOT NULL REFERENCES r(id) {d});
CREATE TABLE r (id serial PRIMARY KEY, p_id int NOT NULL REFERENCES p(id) {d});
"""
SHARED = """
CREATE TABLE hub (id serial PRIMARY KEY, left_id int REFERENCES lefts(id), right_id int REFERENCES rights(id));
CREATE TABLE lefts (id serial PRIMARY KEY, hub_id int NOT NULL REFERENCES hub(id));
CREATE TABLE rights (id serial PRIMARY KEY, hub_id int NOT NULL REFERENCES hub(id));
"""
FULL = """
CREATE TABLE a (t int NOT NULL, id int, b_id int NOT NULL, PRIMARY KEY (t, id), FOREIGN KEY (t, b_id) REFERENCES b (t, id) {m});
CREATE TABLE b (t int NOT NULL, id int, a_id int, PRIMARY KEY (t, id), FOREIGN KEY (t, a_id) REFERENCES a (t, id) {m});
"""


def closed(data) -> bool:
    for t in data.schema.tables:
        for fk in t.foreign_keys:
            parents = data.rows(fk.ref_table).select(*[F.col(r).alias(c) for r, c in zip(fk.ref_columns, fk.columns)])
            known = data.rows(t.name).where(" and ".join(f"{c} is not null" for c in fk.columns))
            if known.join(parents, fk.columns, "left_anti").count():
                return False
    return True


def test_a_deferrable_ring_of_three(spark):
    (step,) = load_steps(read_ddl(RING.format(d="DEFERRABLE INITIALLY DEFERRED")))
    assert step.kind == "deferred" and sorted(step.tables) == ["p", "q", "r"] and step.broken == [("p", ["q_id"])]
    data = generate(spark, read_ddl(RING.format(d="DEFERRABLE INITIALLY DEFERRED")), read_config_text("rows: 12"))
    assert all(data.rows(t).count() == 12 and data.quarantine[t].count() == 0 for t in "pqr") and closed(data)
    assert data.rows("p").where("q_id is null").count() == 0
    with pytest.raises(SchemaError, match=r"cycle p -> q -> r: .*q\(r_id\) to r"):
        load_steps(read_ddl(RING.format(d="")))


def test_two_cycles_that_share_a_table(spark):
    steps = load_steps(read_ddl(SHARED))
    assert [(s.kind, s.tables, s.columns) for s in steps] == [("insert", ["hub"], []), ("insert", ["lefts"], []), ("insert", ["rights"], []), ("update", ["hub"], ["left_id"]), ("update", ["hub"], ["right_id"])]
    data = generate(spark, read_ddl(SHARED), read_config_text("rows: 10"))
    assert all(data.rows(t).count() == 10 for t in ("hub", "lefts", "rights")) and closed(data)
    assert data.rows("hub").where("left_id is null or right_id is null").count() == 0 and sorted(data.updated["hub"]) == ["left_id", "right_id"]


def test_the_fewest_keys_break_a_cycle():
    """One key of a is on both cycles, so it breaks them alone."""
    steps = load_steps(read_ddl("""
    CREATE TABLE a (id serial PRIMARY KEY, b_id int REFERENCES b(id)); CREATE TABLE c (id serial PRIMARY KEY, a_id int REFERENCES a(id)); CREATE TABLE d (id serial PRIMARY KEY, a_id int REFERENCES a(id));
    CREATE TABLE b (id serial PRIMARY KEY, c_id int REFERENCES c(id), d_id int REFERENCES d(id));
    """))  # fmt: skip
    assert [(s.tables, s.columns) for s in steps if s.kind == "update"] == [(["a"], ["b_id"])] and len(steps) == 5


def test_match_full(spark):
    """A key that may be null in a part breaks a cycle, unless MATCH FULL wants all of it or nothing."""
    assert [(s.kind, s.columns) for s in load_steps(read_ddl(FULL.format(m="")))][-1] == ("update", ["a_id"])
    with pytest.raises(SchemaError, match="cycle a -> b"):
        load_steps(read_ddl(FULL.format(m="MATCH FULL")))
    sql = """CREATE TABLE a (t int NOT NULL, id int NOT NULL, PRIMARY KEY (t, id));
    CREATE TABLE b (id serial PRIMARY KEY, t int NOT NULL, a_id int, FOREIGN KEY (t) REFERENCES u(id), FOREIGN KEY (t, a_id) REFERENCES a(t, id) MATCH FULL); CREATE TABLE u (id serial PRIMARY KEY)"""
    data = generate(spark, read_ddl(sql), read_config_text("tables: {u: {rows: 3}, a: {rows: 6, columns: {t: {generator: choice, params: {values: [1, 2, 3]}}}}, b: {rows: 40, fk: {a_id: {strategy: uniform, null_ratio: 0.4}}}}"))
    bad = data.quarantine["b"].select("issues").collect()
    assert data.rows("b").where("a_id is null").count() == 0 and len(bad) + data.rows("b").count() == 40
    assert len(bad) > 5 and all(r["issues"][0]["reason"] == "match full" for r in bad)
