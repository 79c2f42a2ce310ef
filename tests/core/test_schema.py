from __future__ import annotations

from decimal import Decimal

import pytest

from tessera.functions.generators import GeneratorError
from tessera.plans.choices import choose
from tessera.plans.schema import SchemaError, check_bounds, load_steps
from tessera.sources.config import ConfigError, read_config_text
from tessera.sources.ddl import read_ddl

SHOP = """
-- comment ; with a semicolon
CREATE TABLE lineas (pedido_id int NOT NULL REFERENCES pedidos, producto_id int REFERENCES productos(id),
  cantidad int NOT NULL CHECK (cantidad > 0), PRIMARY KEY (pedido_id, producto_id));
CREATE TYPE estado AS ENUM ('nuevo', 'it''s done');
CREATE TABLE pedidos (id serial PRIMARY KEY, "Mixed Name" varchar(20) UNIQUE, e estado DEFAULT 'nuevo'::estado,
  total numeric(12,2) CHECK (total >= 0 AND total < 500), tags text[], creado timestamp with time zone);
CREATE TABLE productos (id bigserial, nombre text NOT NULL, raro geometry, CONSTRAINT pk PRIMARY KEY (id));
ALTER TABLE pedidos ADD CONSTRAINT u UNIQUE (id, e);
COMMENT ON TABLE pedidos IS 'Orders';
COMMENT ON COLUMN pedidos.total IS 'sum';
CREATE INDEX i ON pedidos (id);
"""


def test_ddl():
    s = read_ddl(SHOP)
    pedidos, lineas = s.table("pedidos"), s.table("lineas")
    assert [c.name for c in pedidos.columns] == ["id", "Mixed Name", "e", "total", "tags", "creado"]
    assert pedidos.column("id").serial and not pedidos.column("id").nullable
    assert pedidos.column("e").values == ["nuevo", "it's done"] and pedidos.column("Mixed Name").length == 20
    assert (pedidos.column("total").precision, pedidos.column("total").scale) == (12, 2)
    assert pedidos.column("tags").array and pedidos.column("creado").with_timezone
    assert pedidos.comment == "Orders" and pedidos.column("total").comment == "sum" and ["id", "e"] in pedidos.uniques
    assert lineas.foreign_keys[0].ref_columns == ["id"] and not lineas.column("producto_id").nullable
    assert lineas.kind() == "bridge" and s.table("productos").column("raro").kind == "text"
    assert any("geometry" in w for w in s.warnings) and any("ignored" in w for w in s.warnings)
    assert pedidos.spark_schema()["total"].dataType.simpleString() == "decimal(12,2)"
    assert s.hash() == read_ddl(SHOP).hash() != read_ddl(SHOP.replace("12,2", "12,3")).hash()


def test_bounds():
    assert check_bounds("x BETWEEN 1 AND 5") == {"x": {"low": 1, "low_exclusive": False, "high": 5, "high_exclusive": False}}
    assert check_bounds("x > 0 AND 10 >= x")["x"] == {"low": 0, "low_exclusive": True, "high": Decimal(10), "high_exclusive": False}
    assert check_bounds("t IN ('a', 'b')") == {"t": {"values": ["a", "b"]}}
    assert check_bounds("t NOT IN ('a') AND t <> 'c'")["t"]["excluded"] == ["a", "c"]
    assert check_bounds("x >= 3 and x > 3")["x"]["low_exclusive"]
    for text in ("x > 0 OR x < -5", "length(x) > 2", "x > y", "x LIKE 'a%'", "x > 1 AND y > 2"):
        assert check_bounds(text) == {}


def test_steps():
    assert [x.tables for x in load_steps(read_ddl(SHOP))][-1] == ["lineas"]
    cycle = "CREATE TABLE a (id serial PRIMARY KEY, b_id int {} REFERENCES b(id) {}); CREATE TABLE b (id serial PRIMARY KEY, a_id int NOT NULL REFERENCES a(id));"
    assert [x.kind for x in load_steps(read_ddl(cycle.format("", "")))] == ["insert", "insert", "update"]
    assert [x.kind for x in load_steps(read_ddl(cycle.format("NOT NULL", "DEFERRABLE INITIALLY DEFERRED")))] == ["deferred"]
    with pytest.raises(SchemaError, match="cycle"):
        load_steps(read_ddl(cycle.format("NOT NULL", "")))
    tree = read_ddl("CREATE TABLE t (id serial PRIMARY KEY, up int REFERENCES t(id))")
    assert [x.kind for x in load_steps(tree)] == ["leveled"]


def test_bad_ddl():
    for text in ("CREATE TABLE t (id int", "CREATE TABLE t (id int REFERENCES nowhere(id))"):
        with pytest.raises(SchemaError):
            read_ddl(text)


def test_config_and_choices():
    config = read_config_text("seed: 7\ntables:\n  pedidos:\n    rows: 5\n    columns:\n      total: {generator: numeric_range, params: {low: 5}}\n")
    chosen = choose(read_ddl(SHOP), config)
    assert chosen["pedidos"]["total"].params == {"low": 5, "high": 500.0, "max_exclusive": True}
    for given in ("generator: numeric_range, params: {low: -5, high: 9}", "generator: numeric_range, params: {low: 5, high: 900}", "generator: choice, params: {values: [1, 501]}"):
        with pytest.raises(SchemaError, match="pedidos.total: .* beyond"):
            choose(read_ddl(SHOP), read_config_text(f"tables: {{pedidos: {{columns: {{total: {{{given}}}}}}}}}"))
    assert chosen["productos"]["nombre"].source == "heuristic" and chosen["pedidos"]["e"].generator == "choice"
    assert chosen["lineas"]["cantidad"].params["low"] == 0 and chosen["lineas"]["cantidad"].params["min_exclusive"]
    with pytest.raises(ConfigError, match="tables.pedidos.colums"):
        read_config_text("tables: {pedidos: {colums: {}}}")
    assert read_config_text("refs: {a: on, b: true}").refs == {"a": "on", "b": True}
    with pytest.raises(SchemaError, match="NOT NULL"):
        choose(read_ddl(SHOP), read_config_text("tables: {productos: {columns: {nombre: {null_ratio: 0.5}}}}"))


def test_long_form_of_a_configuration():
    config = read_config_text("""
version: 1
locale: es_ES
llm: {enabled: true, min_confidence: 0.8}
defaults: {rows: 7, null_ratio: 0.1}
tables:
  pedidos:
    rows: 5
    fk: {cliente_id: {strategy: zipf, s: 1.3}}
    columns: {total: {generator: numeric_range, params: {min: 1, max: 9, distribution: {family: normal, params: {mean: 4, std: 1}}}}, dir: {generator: faker, params: {provider: city}}}
output: {batch_size: 10, on_error: abort, max_repair_retries: 3}
""")
    t = config.tables["pedidos"]
    assert (config.rows, config.null_ratio, config.min_confidence, config.batch_size, config.on_error) == (7, 0.1, 0.8, 10, "abort")
    assert t.foreign_keys["cliente_id"].s == 1.3 and t.columns["total"].generator == "normal" and t.columns["total"].params == {"low": 1, "high": 9, "mean": 4, "std": 1}
    assert t.columns["dir"].generator == "fake"
    for text in ("defaults: {seed: 1}", "seed: 1\ndefaults: {rows: 1}\nrows: 2", "tables: {t: {columns: {c: {generator: x, params: {distribution: {family: cauchy}}}}}}"):
        with pytest.raises(ConfigError):
            read_config_text(text)


def test_errors_name_their_place():
    with pytest.raises(SchemaError, match="line 3, column 1"):
        read_ddl("CREATE TABLE a (id int);\n-- two\nCREATE TABLE b id int);")
    with pytest.raises(SchemaError, match="line 2"):
        read_ddl("CREATE TABLE a (id int,\n  FOREIGN KEY (id) REFERENCED b(id))")


def test_names_and_actions():
    t = read_ddl("CREATE TABLE a (id int PRIMARY KEY); CREATE TABLE b (id int CONSTRAINT pos CHECK (id > 0), x int, CONSTRAINT one UNIQUE (id, x), CONSTRAINT f FOREIGN KEY (x) REFERENCES a ON DELETE SET NULL (x) ON UPDATE CASCADE)").table("b")
    assert t.names == {"id > 0": "pos", "id,x": "one", "x": "f"}
    assert (t.foreign_keys[0].on_delete, t.foreign_keys[0].on_update, t.foreign_keys[0].set_null) == ("set null", "cascade", ["x"])


def test_more_heuristics():
    sql = """CREATE TABLE productos (nombre text, precio int, cantidad numeric(8,1), provincia text, titulo text, fecha_alta date, activo boolean, ref_uuid uuid, longitud numeric(9,6), codigo_pais text, left text)"""
    schema = read_ddl(sql)
    chosen = choose(schema, read_config_text(""))["productos"]
    assert {c: x.source for c, x in chosen.items() if c != "left"} == {c.name: "heuristic" for c in schema.tables[0].columns if c.name != "left"}
    assert chosen["nombre"].params == {"provider": "catch_phrase"} and chosen["codigo_pais"].params == {"provider": "country_code"}
    from tessera.sinks.cells import identifier as quoted

    assert quoted("left") == '"left"' and quoted("authorization") == '"authorization"' and quoted("price") == "price"


def test_kinds_and_doubts():
    schema = read_ddl("""CREATE TABLE kinds (id serial PRIMARY KEY, name text); CREATE TABLE a (id serial PRIMARY KEY, kind int REFERENCES kinds(id), n int CHECK (n IN (1, 2)) CHECK (n IN (3)));
        CREATE TABLE ab (x int REFERENCES a(id), y int REFERENCES a(id), z int, w int, PRIMARY KEY (x, z)); CREATE TABLE lone (id int PRIMARY KEY, postal_code int, state text CHECK (state IN ('x', 'y')))""")
    assert schema.kinds() == {"kinds": "lookup", "a": "regular", "ab": "regular", "lone": "regular"}
    warnings = []
    choose(schema, read_config_text("tables: {lone: {columns: {state: {generator: template, params: {text: q}}}}}"), warnings)
    assert len(warnings) == 3 and all(any(w.startswith(c) for w in warnings) for c in ("a.n", "lone.postal_code", "lone.state"))


def test_one_strategy_for_a_compound_key():
    schema = read_ddl("CREATE TABLE p (a int, b int, PRIMARY KEY (a, b)); CREATE TABLE c (a int, b int, FOREIGN KEY (a, b) REFERENCES p)")
    choose(schema, read_config_text("tables: {c: {fk: {a: {strategy: zipf}, b: {strategy: zipf}}}}"))
    with pytest.raises(SchemaError, match="c: a and b"):
        choose(schema, read_config_text("tables: {c: {fk: {a: {strategy: zipf}, b: {strategy: uniform}}}}"))


def test_parameters_of_generators_and_distributions():
    schema = read_ddl("CREATE TABLE t (x int)")
    with pytest.raises(GeneratorError, match="t.x: normal has no parameter 'sigma'"):
        choose(schema, read_config_text("tables: {t: {columns: {x: {generator: normal, params: {sigma: 2}}}}}"))
    with pytest.raises(ConfigError, match="distribution.std: zipf"):
        read_config_text("tables: {t: {columns: {x: {generator: numeric_range, params: {distribution: {family: zipf, params: {std: 1}}}}}}}")


def test_negated_comparisons_are_bounds():
    assert check_bounds("NOT (x < 0)") == {"x": {"low": 0, "low_exclusive": False}} and check_bounds("not x >= 5 and x > 1") == {"x": {"high": 5, "high_exclusive": True, "low": 1, "low_exclusive": True}}
    assert check_bounds("(NOT (x = 3))") == {"x": {"excluded": [3]}} and check_bounds("NOT (0 > x)") == {"x": {"low": 0, "low_exclusive": False}}
    assert check_bounds("NOT (x < 0 AND y > 1)") == {} and check_bounds("NOT (lower(x) = 'a')") == {}
