"""Fourteen schemas: the order in which each is loaded, the exit codes of their analysis, and rows of the harder ones."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.plans.dataset import generate
from tessera.plans.schema import SchemaError, load_steps
from tessera.sources.config import read_config_text
from tessera.sources.ddl import read_ddl

TENANT = """
CREATE TABLE tenants (id uuid PRIMARY KEY);
CREATE TABLE operations (tenant_id uuid NOT NULL REFERENCES tenants(id), id uuid NOT NULL, PRIMARY KEY (tenant_id, id));
CREATE TABLE customers (tenant_id uuid NOT NULL REFERENCES tenants(id), id uuid NOT NULL, PRIMARY KEY (tenant_id, id));
CREATE TABLE offers (id uuid PRIMARY KEY, tenant_id uuid NOT NULL, operation_id uuid NOT NULL, customer_id uuid, previous_id uuid {0}, UNIQUE (tenant_id, id),
  FOREIGN KEY (tenant_id, operation_id) REFERENCES operations (tenant_id, id), FOREIGN KEY (tenant_id, customer_id) REFERENCES customers (tenant_id, id),
  FOREIGN KEY (tenant_id, previous_id) REFERENCES offers (tenant_id, id));"""
PAIR = "CREATE TABLE pedidos (id serial PRIMARY KEY, fecha date NOT NULL, factura_id int {0} REFERENCES facturas(id) {1}); CREATE TABLE facturas (id serial PRIMARY KEY, numero varchar(20) UNIQUE, pedido_id int NOT NULL REFERENCES pedidos(id) {1});"
SELF = "CREATE TABLE empleados (id serial PRIMARY KEY, nombre text NOT NULL, puesto text, fecha_contratacion date, manager_id int {0} REFERENCES empleados(id));"

#: Name: (declarations, kinds of the steps, exit code).
SCHEMAS = {
    "estate": ("""CREATE TABLE clientes (id serial PRIMARY KEY, nombre text NOT NULL, email text UNIQUE, fecha_alta date NOT NULL);
CREATE TABLE viviendas (id serial PRIMARY KEY, direccion text, tipo text CHECK (tipo IN ('piso', 'casa', 'local')), superficie_m2 numeric(7,2) CHECK (superficie_m2 > 0), anio_construccion int CHECK (anio_construccion BETWEEN 1900 AND 2026), propietario_id int NOT NULL REFERENCES clientes(id));
CREATE TABLE compraventas (id serial PRIMARY KEY, vivienda_id int NOT NULL REFERENCES viviendas(id), comprador_id int NOT NULL REFERENCES clientes(id), fecha date NOT NULL, precio numeric(12,2) CHECK (precio > 0));
CREATE TABLE pagos (id serial PRIMARY KEY, compraventa_id int NOT NULL REFERENCES compraventas(id), num_plazo int NOT NULL, fecha date, importe numeric(12,2) CHECK (importe > 0), UNIQUE (compraventa_id, num_plazo));""", ["insert"] * 4, 0),
    "graves": ("""CREATE TABLE personas (id serial PRIMARY KEY, nombre text, fecha_nacimiento date, fecha_fallecimiento date, CHECK (fecha_fallecimiento > fecha_nacimiento));
CREATE TABLE sepulturas (id serial PRIMARY KEY, codigo varchar(20) UNIQUE, tipo text CHECK (tipo IN ('nicho', 'panteon', 'fosa', 'columbario')), capacidad int CHECK (capacidad > 0));
CREATE TABLE entierros (id serial PRIMARY KEY, persona_id int NOT NULL UNIQUE REFERENCES personas(id), sepultura_id int NOT NULL REFERENCES sepulturas(id), fecha_entierro date, responsable text);
COMMENT ON TABLE entierros IS 'one for each person';""", ["insert"] * 3, 0),
    "garage": ("""CREATE TABLE clientes (id serial PRIMARY KEY, nombre text, telefono varchar(20));
CREATE TABLE vehiculos (id serial PRIMARY KEY, cliente_id int NOT NULL REFERENCES clientes(id), matricula varchar(10) UNIQUE, marca text, modelo text, anio int CHECK (anio BETWEEN 1980 AND 2026));
CREATE TABLE piezas (id serial PRIMARY KEY, nombre text, precio_unitario numeric(10,2) CHECK (precio_unitario > 0));
CREATE TABLE reparaciones (id serial PRIMARY KEY, vehiculo_id int NOT NULL REFERENCES vehiculos(id), fecha_entrada date NOT NULL, fecha_salida date, descripcion text, CHECK (fecha_salida IS NULL OR fecha_salida >= fecha_entrada));
CREATE TABLE reparacion_piezas (reparacion_id int REFERENCES reparaciones(id), pieza_id int REFERENCES piezas(id), cantidad int CHECK (cantidad > 0), precio_aplicado numeric(10,2) CHECK (precio_aplicado > 0), PRIMARY KEY (reparacion_id, pieza_id));""", ["insert"] * 5, 0),
    "shop": ("""CREATE TABLE clientes (id serial PRIMARY KEY, nombre text, email text UNIQUE, fecha_alta date); CREATE TABLE categorias (id serial PRIMARY KEY, nombre text UNIQUE);
CREATE TABLE productos (id serial PRIMARY KEY, categoria_id int NOT NULL REFERENCES categorias(id), nombre text, precio numeric(10,2) CHECK (precio > 0), stock int DEFAULT 0 CHECK (stock >= 0));
CREATE TABLE pedidos (id serial PRIMARY KEY, cliente_id int NOT NULL REFERENCES clientes(id), fecha timestamp, estado text CHECK (estado IN ('a', 'b', 'c', 'd', 'e')), total numeric(12,2) CHECK (total >= 0));
CREATE TABLE lineas_pedido (id serial PRIMARY KEY, pedido_id int NOT NULL REFERENCES pedidos(id), producto_id int NOT NULL REFERENCES productos(id), cantidad int CHECK (cantidad > 0), precio_unitario numeric(10,2) CHECK (precio_unitario > 0), UNIQUE (pedido_id, producto_id));""", ["insert"] * 5, 0),
    "staff": (SELF.format(""), ["leveled"], 0),
    "staff_not_null": (SELF.format("NOT NULL"), ["leveled"], 0),
    "cycle_null": (PAIR.format("", ""), ["insert", "insert", "update"], 0),
    "cycle_deferrable": (PAIR.format("NOT NULL", "DEFERRABLE INITIALLY DEFERRED"), ["deferred"], 0),
    "cycle_unbreakable": (PAIR.format("NOT NULL", ""), None, 2),
    "opaque": ("CREATE TABLE t1 (c1 serial PRIMARY KEY, c2 varchar(50), c3 int, c7 numeric(10,2), cod_x char(2)); CREATE TABLE t2 (c1 serial PRIMARY KEY, ref_t1 int NOT NULL REFERENCES t1(c1), c4 date, c5 boolean DEFAULT false, val numeric(12,4));", ["insert"] * 2, 0),
    "agency": ("""CREATE TABLE inmobiliarias (id bigint PRIMARY KEY, nombre text NOT NULL);
CREATE TABLE clientes (inmobiliaria_id bigint NOT NULL REFERENCES inmobiliarias(id), id bigint NOT NULL, roles text[] NOT NULL, match_id bigint, PRIMARY KEY (inmobiliaria_id, id),
  FOREIGN KEY (inmobiliaria_id, match_id) REFERENCES matches (inmobiliaria_id, id) ON DELETE SET NULL (match_id));
CREATE TABLE matches (inmobiliaria_id bigint NOT NULL REFERENCES inmobiliarias(id), id bigint NOT NULL, cliente_id bigint NOT NULL, PRIMARY KEY (inmobiliaria_id, id), FOREIGN KEY (inmobiliaria_id, cliente_id) REFERENCES clientes (inmobiliaria_id, id));""", ["insert"] * 3 + ["update"], 0),
    "offers": (TENANT.format(""), ["insert", "insert", "insert", "leveled"], 0),
    "offers_not_null": (TENANT.format("NOT NULL"), ["insert", "insert", "insert", "leveled"], 0),
    "unique_targets": ("""CREATE TABLE parent (id serial PRIMARY KEY, code int NOT NULL UNIQUE CHECK (code BETWEEN 1 AND 9999)); CREATE TABLE child (id serial PRIMARY KEY, parent_code int NOT NULL REFERENCES parent(code));
CREATE TABLE grandchild (id serial PRIMARY KEY, child_id int NOT NULL REFERENCES child(id));
CREATE TABLE parent_composite (id serial PRIMARY KEY, a int NOT NULL, b int NOT NULL, UNIQUE (a, b)); CREATE TABLE child_composite (id serial PRIMARY KEY, a int NOT NULL, b int NOT NULL, FOREIGN KEY (a, b) REFERENCES parent_composite (a, b));
CREATE TABLE parent_reordered (a int, b int, PRIMARY KEY (a, b)); CREATE TABLE child_reordered (id serial PRIMARY KEY, x int NOT NULL, y int NOT NULL, FOREIGN KEY (x, y) REFERENCES parent_reordered (b, a));
CREATE TABLE pedidos_uk (id serial PRIMARY KEY, num int NOT NULL UNIQUE, factura_num int NOT NULL REFERENCES facturas_uk(num) DEFERRABLE); CREATE TABLE facturas_uk (id serial PRIMARY KEY, num int NOT NULL UNIQUE, pedido_num int NOT NULL REFERENCES pedidos_uk(num) DEFERRABLE);
CREATE TABLE detalle_uk (id serial PRIMARY KEY, pedido_num int NOT NULL REFERENCES pedidos_uk(num));""", None, 0),
}


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_steps_and_exit_codes(tmp_path, name, capsys):
    sql, kinds, code = SCHEMAS[name]
    (tmp_path / "s.sql").write_text(sql)
    assert cli.main(["analyze", str(tmp_path / "s.sql")]) == code
    if code:
        with pytest.raises(SchemaError):
            load_steps(read_ddl(sql))
        return
    steps = load_steps(read_ddl(sql))
    if kinds:
        assert sorted(s.kind for s in steps) == sorted(kinds)
    seen: set[str] = set()
    broken = {(s.tables[0], c) for s in steps if s.kind == "update" for c in s.columns} | {(t, c) for s in steps for t, columns in s.broken for c in columns}
    schema = read_ddl(sql)
    for step in steps:
        for t in step.tables if step.kind != "update" else []:
            for fk in schema.table(t).foreign_keys:
                assert fk.ref_table in seen | {t} or any((t, c) in broken for c in fk.columns)
            seen.add(t)
    assert seen == {t.name for t in schema.tables}


@pytest.mark.parametrize("name", ["agency", "garage", "offers_not_null", "unique_targets"])
def test_rows(spark, name):
    """Every table has rows, and every key finds its parent."""
    few = {"agency": "inmobiliarias: {rows: 3}", "garage": "reparacion_piezas: {rows: 60}", "offers_not_null": "tenants: {rows: 3}"}
    data = generate(spark, read_ddl(SCHEMAS[name][0]), read_config_text(f"seed: 5\nrows: 14\ntables: {{{few.get(name, '')}}}"))
    for t in data.schema.tables:
        rows = data.rows(t.name)
        assert rows.count() > 0
        for fk in t.foreign_keys:
            parents = data.rows(fk.ref_table).select(*[F.col(r).alias(c) for r, c in zip(fk.ref_columns, fk.columns)])
            known = rows.where(" and ".join(f"{c} is not null" for c in fk.columns))
            assert known.join(parents, fk.columns, "left_anti").count() == 0
    if name == "offers_not_null":
        assert data.rows("offers").where("previous_id is null").count() == 0 and data.rows("offers").where("previous_id = id").count() > 0
