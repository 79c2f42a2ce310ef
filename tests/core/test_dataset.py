from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.functions import rules
from tessera.operators import assign
from tessera.plans.dataset import generate
from tessera.sinks import files
from tessera.sources.config import read_config_text
from tessera.sources.ddl import read_ddl

ESTATE = """
CREATE TABLE clientes (id serial PRIMARY KEY, nombre text NOT NULL, email text UNIQUE, fecha_alta date NOT NULL);
CREATE TABLE viviendas (id serial PRIMARY KEY, direccion text, tipo text CHECK (tipo IN ('piso', 'casa')), superficie_m2 numeric(7,2) NOT NULL CHECK (superficie_m2 > 0),
  anio int CHECK (anio BETWEEN 1900 AND 2026), propietario_id int NOT NULL REFERENCES clientes(id));
CREATE TABLE compraventas (id serial PRIMARY KEY, vivienda_id int NOT NULL REFERENCES viviendas(id), comprador_id int NOT NULL REFERENCES clientes(id), fecha date NOT NULL, precio numeric(12,2) CHECK (precio > 0));
CREATE TABLE pagos (id serial PRIMARY KEY, compraventa_id int NOT NULL REFERENCES compraventas(id), num_plazo int NOT NULL, importe numeric(12,2), UNIQUE (compraventa_id, num_plazo));
"""
CONFIG = """
seed: 42
tables:
  clientes: {rows: 40}
  viviendas: {rows: 60, columns: {superficie_m2: {generator: lognormal, params: {low: 35, high: 450, median: 90, sigma: 0.45}}}}
  compraventas:
    rows: 50
    foreign_keys: {vivienda_id: {strategy: quota, min: 0, max: 2}, comprador_id: {strategy: zipf, s: 1.3}}
    rules: ["fecha >= date(2019,1,1)", "precio = parent(vivienda_id).superficie_m2 * ref('precio_m2') * noise(0.1)"]
  pagos: {rows: 100, foreign_keys: {compraventa_id: {strategy: quota, min: 1, max: 12}}}
refs: {precio_m2: 2350}
"""


def orphans(data, child, column, parent, ref="id"):
    parents = data.rows(parent).select(F.col(ref).alias(column))
    return data.rows(child).where(F.col(column).isNotNull()).select(column).join(parents, column, "left_anti").count()


def test_estate(spark, tmp_path):
    schema = read_ddl(ESTATE)
    data = generate(spark, schema, read_config_text(CONFIG))
    assert {t: data.rows(t).count() for t in data.accepted} == {"clientes": 40, "viviendas": 60, "compraventas": 50, "pagos": 100}
    assert not any(q.count() for q in data.quarantine.values())
    for child, column, parent in (("viviendas", "propietario_id", "clientes"), ("compraventas", "vivienda_id", "viviendas"), ("pagos", "compraventa_id", "compraventas")):
        assert orphans(data, child, column, parent) == 0
    assert data.rows("compraventas").groupBy("vivienda_id").count().agg(F.max("count")).first()[0] <= 2
    low, high = data.rows("pagos").groupBy("compraventa_id").count().agg(F.min("count"), F.max("count")).first()
    assert low >= 1 and high <= 12 and data.rows("pagos").select("compraventa_id", "num_plazo").distinct().count() == 100
    assert data.rows("compraventas").where("fecha < date'2019-01-01'").count() == 0
    assert data.rows("viviendas").where("tipo not in ('piso', 'casa') or superficie_m2 < 35 or anio not between 1900 and 2026").count() == 0
    before = [sorted(map(str, data.rows(t).collect())) for t in data.accepted]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = generate(spark, schema, read_config_text(CONFIG))
        assert before == [sorted(map(str, again.rows(t).collect())) for t in again.accepted]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    files.write_csv(data, str(tmp_path / "csv"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "csv" / "pagos.csv")).collect()]
    assert len(lines) == 101 and "id,compraventa_id,num_plazo,importe" in lines
    files.write_json(data, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json" / "clientes.json")).count() == 40
    statements = [r["statement"] for r in files.script(data, 30).sort("step", "part").collect()]
    assert statements[0].startswith("BEGIN;") and statements[-1] == "COMMIT;" and sum(s.startswith("INSERT INTO pagos") for s in statements) == 4


def test_bridge_tree_and_cycle(spark):
    data = generate(spark, read_ddl("""
    CREATE TABLE a (id serial PRIMARY KEY); CREATE TABLE b (id serial PRIMARY KEY, code varchar(4) UNIQUE);
    CREATE TABLE ab (a_id int REFERENCES a(id), b_id int REFERENCES b(id), n int, PRIMARY KEY (a_id, b_id));
    CREATE TABLE e (id serial PRIMARY KEY, jefe_id int REFERENCES e(id), tags text[]);
    CREATE TABLE p (id serial PRIMARY KEY, f_id int REFERENCES f(id)); CREATE TABLE f (id serial PRIMARY KEY, p_id int NOT NULL REFERENCES p(id));
    """), read_config_text("seed: 3\nrows: 30\ntables: {ab: {rows: 200}, b: {columns: {code: {generator: choice, params: {values: [" + ",".join(f"v{i}" for i in range(60)) + "]}}}}}\nhierarchy: {e.jefe_id: {branching: 3}}"))  # fmt: skip
    assert data.rows("ab").select("a_id", "b_id").distinct().count() == 200 == data.rows("ab").count()
    assert data.rows("b").select("code").distinct().count() == 30
    assert data.rows("e").where("jefe_id is null").count() == 1 and orphans(data, "e", "jefe_id", "e") == 0
    assert data.rows("p").where("f_id is null").count() == 0 and orphans(data, "p", "f_id", "f") == 0 and orphans(data, "f", "p_id", "p") == 0
    statements = [r["statement"] for r in files.script(data).sort("step", "part").collect()]
    assert any(s.startswith("UPDATE p SET f_id = ") for s in statements)


def test_tenants(spark):
    data = generate(spark, read_ddl("""
    CREATE TABLE tenants (id serial PRIMARY KEY);
    CREATE TABLE ops (tenant_id int REFERENCES tenants(id), id serial, PRIMARY KEY (tenant_id, id));
    CREATE TABLE offers (id serial PRIMARY KEY, tenant_id int NOT NULL, op_id int NOT NULL, prev_id int, UNIQUE (tenant_id, id),
      FOREIGN KEY (tenant_id, op_id) REFERENCES ops(tenant_id, id), FOREIGN KEY (tenant_id) REFERENCES tenants(id), FOREIGN KEY (tenant_id, prev_id) REFERENCES offers(tenant_id, id));
    """), read_config_text("rows: 40\ntables: {tenants: {rows: 4}}"))  # fmt: skip
    rows = data.rows("offers")
    assert rows.count() == 40
    up = rows.select(F.col("id").alias("prev_id"), F.col("tenant_id").alias("t"))
    assert rows.join(up, "prev_id").where("t <> tenant_id").count() == 0
    assert rows.join(data.rows("ops").select(F.col("id").alias("op_id"), F.col("tenant_id").alias("t")), "op_id").where("t <> tenant_id").count() == 0


def test_arrays_hold_what_the_columns_generator_makes(spark):
    """Each element type, with bounds, null ratio and UNIQUE."""
    kinds = {"i": "int", "n": "numeric(6,2)", "f": "double precision", "o": "boolean", "d": "date", "t": "timestamp", "u": "uuid", "x": "text", "v": "varchar(3)", "e": "mood"}
    sql = "CREATE TYPE mood AS ENUM ('a', 'b'); CREATE TABLE r (id serial PRIMARY KEY, " + ", ".join(f"{c} {kind}[]" for c, kind in kinds.items()) + ", q numeric(4,1)[] UNIQUE, w int[])"
    data = generate(spark, read_ddl(sql), read_config_text("""
seed: 5
rows: 120
tables: {r: {columns: {w: {generator: integer_range, params: {low: 5, high: 7}, null_ratio: 0.4}}}}
"""))  # fmt: skip
    rows = data.rows("r").collect()
    assert len(rows) == 120
    for c in kinds:
        assert {len(r[c]) for r in rows} == set(range(6)) and all(x is not None for r in rows for x in r[c])
        assert c == "v" or len({x for r in rows for x in r[c]}) > (1 if c in "oe" else 20)  # v: three characters of a longer value
    assert {x for r in rows for x in r["e"]} == {"a", "b"} and max(len(x) for r in rows for x in r["v"]) <= 3
    assert {x for r in rows for x in r["w"] or []} == {5, 6, 7} and 20 < sum(r["w"] is None for r in rows) < 80
    alone = generate(spark, read_ddl("CREATE TABLE s (id serial PRIMARY KEY, q boolean[] UNIQUE)"), read_config_text("rows: 40"))
    assert len({tuple(r["q"]) for r in alone.rows("s").collect()}) == 40 and len({tuple(r["q"]) for r in rows}) == 120


def test_last_columns_of_keys_are_drawn_within_their_group(spark):
    sql = """CREATE TABLE p (id serial PRIMARY KEY); CREATE TABLE c (p_id int NOT NULL REFERENCES p(id), kind text CHECK (kind IN ('a', 'b', 'c', 'd')), PRIMARY KEY (p_id, kind))"""
    data = generate(spark, read_ddl(sql), read_config_text("tables: {p: {rows: 10}, c: {rows: 30, foreign_keys: {p_id: {strategy: quota, min: 3, max: 3}}}}"))
    assert data.rows("c").select("p_id", "kind").distinct().count() == 30 and data.quarantine["c"].count() == 0
    more = generate(spark, read_ddl(sql), read_config_text("tables: {p: {rows: 1}, c: {rows: 6}}"))
    assert more.rows("c").count() == 4 and more.quarantine["c"].count() == 2


def test_abort_and_infeasible(spark):
    from tessera.operators.assign import InfeasibleError
    from tessera.plans.dataset import GenerationError

    sql = "CREATE TABLE t (id serial PRIMARY KEY, a int, b int, CHECK (a > b))"
    assert generate(spark, read_ddl(sql), read_config_text("rows: 50")).quarantine["t"].count() > 0
    with pytest.raises(GenerationError, match="t, row"):
        generate(spark, read_ddl(sql), read_config_text("rows: 50\non_error: abort"))
    one = "CREATE TABLE p (id serial PRIMARY KEY); CREATE TABLE c (id serial PRIMARY KEY, p_id int NOT NULL UNIQUE REFERENCES p(id))"
    with pytest.raises(InfeasibleError, match="c.p_id"):
        generate(spark, read_ddl(one), read_config_text("tables: {p: {rows: 3}, c: {rows: 4}}"))


def test_cli(spark, tmp_path, capsys):
    sql = tmp_path / "s.sql"
    sql.write_text(ESTATE)
    assert cli.main(["analyze", str(sql)]) == 0 and cli.main(["plan", str(sql)]) == 0
    assert cli.main(["analyze", str(tmp_path / "none.sql")]) == 3
    (tmp_path / "bad.sql").write_text("CREATE TABLE t (")
    assert cli.main(["analyze", str(tmp_path / "bad.sql")]) == 1
    (tmp_path / "c.yaml").write_text("nope: 1")
    assert cli.main(["plan", str(sql), "-c", str(tmp_path / "c.yaml")]) == 4
    assert cli.main(["export", str(sql), "-o", str(tmp_path / "seed")]) in (0, 4)


TENANTS = """
CREATE TABLE tenants (id int PRIMARY KEY);
CREATE TABLE users (tenant_id int NOT NULL REFERENCES tenants(id), id int NOT NULL, PRIMARY KEY (tenant_id, id));
CREATE TABLE groups (tenant_id int NOT NULL REFERENCES tenants(id), id int NOT NULL, PRIMARY KEY (tenant_id, id));
CREATE TABLE members (tenant_id int NOT NULL, user_id int NOT NULL, group_id int NOT NULL, note text, PRIMARY KEY (tenant_id, user_id, group_id),
  FOREIGN KEY (tenant_id, user_id) REFERENCES users(tenant_id, id), FOREIGN KEY (tenant_id, group_id) REFERENCES groups(tenant_id, id),
  FOREIGN KEY (tenant_id) REFERENCES tenants(id));
"""


@pytest.mark.parametrize("seed", [1, 2])
def test_bridge_that_shares_a_tenant(spark, seed):
    """Distinct pairs, none in quarantine, both keys of one tenant; more than there are is an error before any row."""
    config = f"seed: {seed}\ntables: {{tenants: {{rows: 5}}, users: {{rows: 20}}, groups: {{rows: 15}}, members: {{rows: ROWS}}}}"
    schema = read_ddl(TENANTS)
    data = generate(spark, schema, read_config_text(config.replace("ROWS", "40")))
    assert data.rows("members").count() == 40 and data.quarantine["members"].count() == 0
    assert data.rows("members").select("tenant_id", "user_id", "group_id").distinct().count() == 40
    for parent, column in (("users", "user_id"), ("groups", "group_id")):
        keys = data.rows(parent).select("tenant_id", F.col("id").alias(column))
        assert data.rows("members").join(keys, ["tenant_id", column], "left_anti").count() == 0
    with pytest.raises(assign.InfeasibleError):
        generate(spark, schema, read_config_text(config.replace("ROWS", "4000")))


def test_keys_that_share_a_column_draw_apart(spark):
    sql = TENANTS.replace("PRIMARY KEY (tenant_id, user_id, group_id),", "")
    data = generate(spark, read_ddl(sql), read_config_text("seed: 3\ntables: {tenants: {rows: 2}, users: {rows: 20}, groups: {rows: 20}, members: {rows: 100}}"))
    assert data.rows("members").select("tenant_id", "user_id", "group_id").distinct().count() > 40


def test_bounded_pairs_depend_on_the_seed(spark):
    rows = spark.range(30).withColumnRenamed("id", "idx")
    a, b = (sorted(tuple(r) for r in assign.bounded_pairs(rows, 10, 8, (1, 1), (5, 5), seed, "t").collect()) for seed in (1, 2))
    assert a != b and len({x[1:] for x in a}) == 30


@pytest.mark.parametrize("high", [None, 1000, 3])
def test_quota_without_a_near_bound_makes_no_spare_slots(spark, high):
    slots = assign.quota(spark.range(120).withColumnRenamed("id", "idx"), 50, 1, high, 7, "t", "k").collect()
    counts = [sum(r["pidx"] == p for r in slots) for p in range(50)]
    assert sorted(r["idx"] for r in slots) == list(range(120)) and min(counts) >= 1 and max(counts) <= (high or 120)


RULED = """
CREATE TABLE items (id serial PRIMARY KEY, a int, b int, c int CHECK (c BETWEEN 0 AND 50), low int CHECK (low BETWEEN 0 AND 90), v int CHECK (v BETWEEN 0 AND 100), name text);
"""


def test_rules_follow_their_dependencies(spark):
    config = """
seed: 1
refs: {who: "O'Neil"}
tables: {items: {rows: 300, rules: ["a = b + 1", "b = c + 1", "v > low", "name = ref('who')", "c * noise(0.1) < 1000 * noise(0.1)"]}}
"""
    data = generate(spark, read_ddl(RULED), read_config_text(config))
    rows = data.rows("items").collect()
    assert len(rows) == 300 and all(r["a"] == r["b"] + 1 == r["c"] + 2 and r["v"] > r["low"] and r["name"] == "O'Neil" for r in rows)
    beside = sum(r["v"] == r["low"] + 1 for r in rows)  # drawn between the bound and the edge, not all on the bound
    assert beside < 40
    with pytest.raises(rules.RuleError, match="a -> b -> a"):
        generate(spark, read_ddl(RULED), read_config_text('tables: {items: {rules: ["a = b + 1", "b = a + 1"]}}'))


def test_rows_are_checked_again_after_the_rules(spark):
    """A bound on a derived column moves it off its derivation."""
    data = generate(spark, read_ddl(RULED), read_config_text('tables: {items: {rows: 60, rules: ["a = c + 1", "a <= 30"]}}'))
    assert 0 < data.quarantine["items"].count() < 60 and data.rows("items").where("a <> c + 1 or a > 30").count() == 0


@pytest.mark.parametrize("text", [
    "a = try_reflect('java.lang.System', 'getProperty', 'user.home')", "a = java_method('x', 'y')", "a = `reflect`('x', 'y')", "a = (select 1)",
    "a = r'\\' || reflect('x', 'y') || ''", "a = 'x", "a = current_user()", "a = system.builtin.reflect('x', 'y')", "a = input_file_name()",
])
def test_rules_call_known_functions_only(spark, text):
    from tessera.operators import validate

    with pytest.raises(rules.RuleError):
        rules.Rule(text)
    with pytest.raises(rules.RuleError):
        validate.check(text)


def test_two_noises_of_a_rule_differ(spark):
    from tessera.functions.draws import Cell

    df = rules.evaluate(spark.range(50).withColumnRenamed("id", "idx"), "x", "noise(0.5) - noise(0.5)", Cell(1, "t", "x", F.col("idx")))
    assert df.where("abs(x) > 1e-9").count() == 50


def test_lookup_buckets_stay_small(spark):
    """A long tail of narrow ranges: no bucket holds many of them."""
    from tessera.operators import ranks

    n = 200_000
    weights = spark.range(n).select(F.col("id").alias("pidx")).withColumn("w", F.expr("greatest(1, floor(1e9 / pow(pidx + 1, 1.3) + 0.5))"))
    ranges = ranks.cumulative(weights, "w", "pidx").select("pidx", "low", "high")
    total = ranges.agg(F.max("high")).first()[0]
    points = ranges.select("pidx", F.expr("low + (high - low) div 2").alias("at")).withColumnRenamed("pidx", "want")
    found = ranks.range_lookup(points, "at", ranges, total)
    assert found.where("want <> pidx").count() == 0 and found.count() == n


def test_every_guess_makes_values(spark):
    """A column for each of the patterns, of each of its kinds."""
    from tessera.plans import choices

    names = {"password": "clave", "email": "correo", "iban": "iban", "national id": "dni", "postcode": "zip", "user": "login", "ip": "ip", "image": "foto", "url": "web", "uuid": "guid", "first name": "first_name",
             "last name": "surname", "company": "company", "job": "puesto", "name": "nombre", "phone": "tel", "address": "address", "city": "ciudad", "region": "provincia", "country code": "country_iso", "country": "pais",
             "currency": "moneda", "color": "color", "plate": "matricula", "title": "titulo", "slug": "slug", "code": "codigo", "identifier": "numero", "description": "notas", "age": "edad", "year": "anio", "percent": "pct",
             "latitude": "lat", "longitude": "lng", "price": "precio", "quantity": "stock", "capacity": "aforo", "area": "metros", "birth": "nacimiento", "registration": "fecha_alta", "flag": "activo", "expiry": "expires"}
    assert set(names) == {g[0] for g in choices.GUESSES}
    types = {"text": "text", "integer": "int", "numeric": "numeric(12,2)", "date": "date", "boolean": "boolean", "uuid": "uuid"}
    columns = {}
    for name, _, kinds, *_ in choices.GUESSES:
        for kind in kinds.split():
            columns.setdefault(kind, []).append(f"{names[name]} {types[kind]} NOT NULL")
    sql = " ".join(f"CREATE TABLE t_{kind} (id serial PRIMARY KEY, {', '.join(some)});" for kind, some in columns.items())
    schema = read_ddl(sql)
    data = generate(spark, schema, read_config_text("rows: 20"))
    chosen = choices.choose(schema, read_config_text(""))
    for t in schema.tables:
        assert {c.name for c in t.columns if chosen[t.name][c.name].source not in ("heuristic", "serial")} == set()
        assert data.rows(t.name).count() == 20 and data.quarantine[t.name].count() == 0


DISTRIBUTED = """CREATE TABLE t (id serial PRIMARY KEY, ranks int NOT NULL, age int NOT NULL CHECK (age > 17), price numeric(6,2) NOT NULL CHECK (price > 0), share double precision NOT NULL CHECK (share > 0 AND share < 1),
  size int NOT NULL CHECK (size > 0), born date NOT NULL CHECK (born > '2000-01-01'), hits int NOT NULL)"""


def test_distributions_fit_types_and_bounds(spark):
    config = """
tables:
  t:
    rows: 4000
    columns:
      ranks: {generator: numeric_range, params: {min: 5, max: 2000000000, distribution: {family: zipf, params: {s: 1.5}}}}
      age: {generator: normal, params: {low: 18, high: 90, mean: 20, std: 10}}
      price: {generator: lognormal, params: {high: 3, median: 0.02, sigma: 2}}
      size: {generator: choice, params: {values: [1, 2]}}
      hits: {generator: zipf, params: {low: 1, high: 3, s: 1}}
"""
    data = generate(spark, read_ddl(DISTRIBUTED), read_config_text(config))
    assert data.quarantine["t"].count() == 0
    r = data.rows("t").selectExpr(
        "min(ranks)", "avg(int(ranks = 5))", "avg(int(ranks = 6))", "max(ranks) > 1000", "min(age)", "min(price)", "max(price)", "max(share) < 1", "max(size)", "min(born) > '2000-01-01'", "avg(int(hits = 1))", "max(hits)"
    ).first()
    zeta = 2.612375  # of 1.5
    assert r[0] == 5 and abs(r[1] - 1 / zeta) < 0.03 and abs(r[2] - 2**-1.5 / zeta) < 0.03 and r[3]
    assert r[4] >= 18 and float(r[5]) >= 0.01 and float(r[6]) <= 3 and r[7] and r[8] == 2 and r[9]
    assert abs(r[10] - 6 / 11) < 0.03 and r[11] == 3


def test_registered_generator(spark):
    from tessera.functions import generators as g

    g.register("thirds", lambda cell, of=3: g.pick(cell.u(), of) * 10)
    try:
        data = generate(spark, read_ddl("CREATE TABLE t (id serial PRIMARY KEY, x int)"), read_config_text("tables: {t: {rows: 60, columns: {x: {generator: thirds}}}}"))
        assert {r[0] for r in data.rows("t").select("x").collect()} == {0, 10, 20}
        with pytest.raises(g.GeneratorError, match="registered"):
            g.register("thirds", lambda cell: cell.u())
    finally:
        del g.REGISTRY["thirds"]


def test_every_csv_part_has_the_header(spark, tmp_path):
    data = generate(spark, read_ddl("CREATE TABLE t (id serial PRIMARY KEY, x int); CREATE TABLE none (id int PRIMARY KEY)"), read_config_text("tables: {t: {rows: 500}, none: {rows: 0}}"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        files.write_csv(data, str(tmp_path / "csv"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(list((tmp_path / "csv" / "t.csv").glob("part-*"))) > 1
    back = spark.read.csv(str(tmp_path / "csv" / "t.csv"), header=True)
    assert back.columns == ["id", "x"] and back.count() == 500 and back.where("id = 'id'").count() == 0
    assert [r[0] for r in spark.read.text(str(tmp_path / "csv" / "none.csv")).collect()] == ["id"]


def test_updates_name_only_what_is_set(spark):
    from tessera.sinks import cells

    df = spark.createDataFrame([(1, 5, None), (2, None, None), (3, None, 7), (4, 8, 9)], "id int, a int, b int")
    made = {r[0] for r in cells.update_statements(df, "t", ["id"], ["a", "b"]).collect()}
    assert made == {"UPDATE t SET a = 5 WHERE id = 1;", "UPDATE t SET b = 7 WHERE id = 3;", "UPDATE t SET a = 8, b = 9 WHERE id = 4;"}


def test_plan_shows_rules_and_summary(tmp_path, capsys):
    import json

    (tmp_path / "s.sql").write_text(ESTATE)
    (tmp_path / "c.yaml").write_text(CONFIG)
    assert cli.main(["plan", str(tmp_path / "s.sql"), "-c", str(tmp_path / "c.yaml"), "--json"]) == 0
    plan = json.loads(capsys.readouterr().out)
    assert [r["kind"] for r in plan["rules"]["compraventas"]] == ["bound", "derivation"] and plan["summary"]["user"] == 1
    (tmp_path / "c.yaml").write_text('tables: {clientes: {rules: ["id = len(email)", "email = id"]}}')
    assert cli.main(["plan", str(tmp_path / "s.sql"), "-c", str(tmp_path / "c.yaml")]) == 4


def test_runs_are_loaded_without_their_summary(spark, tmp_path):
    from tessera.operators.reports import load_runs

    (tmp_path / "a.json").write_text('{"model": "m",\n "seconds": 2.5}')
    (tmp_path / "b.json").write_text('[{"model": "n", "seconds": 1.0}]')
    (tmp_path / "_summary.json").write_text('{"model": "all"}')
    assert {tuple(r) for r in load_runs(spark, str(tmp_path), "model string, seconds double").collect()} == {("m", 2.5), ("n", 1.0)}


def test_names_by_locale(spark):
    """Over a thousand names in each locale, with the shares that the weights say."""
    from collections import Counter

    from tessera.functions import generators, names
    from tessera.functions.draws import Cell

    rows = spark.range(6000).withColumnRenamed("id", "idx")
    for locale in names.SYLLABLES:
        found = [r[0] for r in rows.select(generators.fake(Cell(1, "t", locale, F.col("idx")), "name", locale)).collect()]
        assert len(set(found)) > 3000
    weights = {"a": 1, "b": 2, "c": 5, "d": 0.5}
    drawn = Counter(r[0] for r in rows.select(names.Alias.of(weights).drawn(Cell(1, "t", "x", F.col("idx")).u())).collect())
    assert all(abs(drawn[k] / 6000 - w / 8.5) < 0.03 for k, w in weights.items())
    data = generate(spark, read_ddl("CREATE TABLE p (id serial PRIMARY KEY, first_name text, email text UNIQUE)"), read_config_text("rows: 300\nlocale: en_US"))
    assert data.rows("p").select("first_name").distinct().count() > 150 and not data.warnings
    with pytest.raises(generators.GeneratorError, match="locale"):
        generators.fake(Cell(1, "t", "x", F.col("idx")), "name", "xx")


def test_two_sided_bounds_keep_the_distribution(spark):
    """Bounds on both sides, of dates, timestamps, integers and lognormal numbers: none is broken, and no value piles
    up on a bound."""
    sql = """CREATE TABLE t (id serial PRIMARY KEY, a int NOT NULL CHECK (a BETWEEN 0 AND 100), n int NOT NULL CHECK (n BETWEEN 0 AND 300), x numeric(9,2) NOT NULL, d date NOT NULL, e date NOT NULL, s timestamp NOT NULL, f double precision NOT NULL);"""
    config = """
seed: 4
tables:
  t:
    rows: 800
    columns:
      x: {generator: lognormal, params: {low: 1, high: 500, median: 60, sigma: 0.5}}
      f: {generator: normal, params: {low: 0, high: 200, mean: 100, std: 30}}
    rules: ["n > a", "n <= a + 20", "x >= a", "x < a + 50", "e > d", "e <= date_add(d, 30)", "s >= d", "s < date_add(d, 2)", "f > a", "f < a + 60"]
"""
    data = generate(spark, read_ddl(sql), read_config_text(config))
    rows = data.rows("t")
    assert rows.count() == 800 and data.quarantine["t"].count() == 0
    assert rows.where("n <= a or n > a + 20 or x < a or x >= a + 50 or e <= d or e > date_add(d, 30) or s < d or s >= date_add(d, 2) or f <= a or f >= a + 60").count() == 0
    on = rows.agg(*[F.count_if(F.expr(c)) for c in ("x = a", "f = a or f = a + 60", "n = a + 1", "n = a + 20", "e = date_add(d, 1)", "s = d")]).first()
    assert on[0] <= 8 and on[1] == 0 and max(on[2:5]) < 110 and on[5] <= 2
    middle = rows.where("a between 40 and 50").agg(F.avg(F.expr("x - a"))).first()[0]
    assert 15 < middle < 25  # the density falls beyond the median: below the bounds' middle
