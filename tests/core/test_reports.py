"""What the reader of declarations finds, and what is planned for it."""

from __future__ import annotations

from tessera.plans.choices import choose
from tessera.plans.schema import load_steps
from tessera.sources.config import read_config_text
from tessera.sources.ddl import read_ddl

SHOP = """
CREATE TYPE state AS ENUM ('open', 'sent', 'closed');
CREATE TABLE shops (id serial PRIMARY KEY, name varchar(40) NOT NULL, email text UNIQUE, city text);
CREATE TABLE goods (shop_id int NOT NULL REFERENCES shops(id) ON DELETE CASCADE, sku text NOT NULL, price numeric(8,2) CHECK (price > 0 AND price <= 500),
  stock int DEFAULT 0 CONSTRAINT stock_kept CHECK (stock >= 0), PRIMARY KEY (shop_id, sku));
CREATE TABLE sales (id bigserial PRIMARY KEY, shop_id int NOT NULL, sku text NOT NULL, status state, sold date, prior bigint REFERENCES sales(id), tags text[]);
ALTER TABLE ONLY sales ADD CONSTRAINT sold_good FOREIGN KEY (shop_id, sku) REFERENCES goods(shop_id, sku) MATCH FULL;
COMMENT ON COLUMN sales.sold IS 'day of sale';
"""
SHOP_CONFIG = """
version: 1
defaults: {rows: 50}
tables:
  goods: {columns: {price: {generator: numeric_range, params: {min: 1, max: 500, distribution: {family: lognormal, params: {median: 20, sigma: 0.4}}}}}}
  sales: {fk: {shop_id: {strategy: zipf, s: 1.3}}}
"""
_ANALYZED = """
('shops', 'id', 'integer', false, 'primary', NULL, NULL), ('shops', 'name', 'text', false, NULL, NULL, NULL), ('shops', 'email', 'text', true, 'unique', NULL, NULL), ('shops', 'city', 'text', true, NULL, NULL, NULL),
('goods', 'shop_id', 'integer', false, 'primary', 'shops.id', NULL), ('goods', 'sku', 'text', false, 'primary', NULL, NULL), ('goods', 'price', 'numeric', true, NULL, NULL, NULL), ('goods', 'stock', 'integer', true, NULL, NULL, NULL),
('sales', 'id', 'integer', false, 'primary', NULL, NULL), ('sales', 'shop_id', 'integer', false, NULL, 'goods.shop_id', NULL), ('sales', 'sku', 'text', false, NULL, 'goods.sku', NULL), ('sales', 'status', 'enum', true, NULL, NULL, NULL),
('sales', 'sold', 'date', true, NULL, NULL, 'day of sale'), ('sales', 'prior', 'integer', true, NULL, 'sales.id', NULL), ('sales', 'tags', 'text[]', true, NULL, NULL, NULL)"""


def analyzed() -> list[tuple]:
    """What the reader of declarations finds: a row for each column."""
    found = []
    for t in read_ddl(SHOP).tables:
        for c in t.columns:
            part = "primary" if c.name in t.primary_key else "unique" if any(c.name in k for k in t.uniques) else None
            refers = next((f"{fk.ref_table}.{r}" for fk in t.foreign_keys for own, r in zip(fk.columns, fk.ref_columns) if own == c.name), None)
            found.append((t.name, c.name, c.kind + "[]" * c.array, c.nullable, part, refers, c.comment))
    return found


_PLANNED = """
(1, 'shops', 'id', 'serial', 'serial'), (1, 'shops', 'name', 'fake', 'heuristic'), (1, 'shops', 'email', 'fake', 'heuristic'), (1, 'shops', 'city', 'fake', 'heuristic'),
(2, 'goods', 'shop_id', 'key', 'key'), (2, 'goods', 'sku', 'fallback', 'fallback'), (2, 'goods', 'price', 'lognormal', 'user'), (2, 'goods', 'stock', 'integer_range', 'heuristic'),
(3, 'sales', 'id', 'serial', 'serial'), (3, 'sales', 'shop_id', 'key', 'key'), (3, 'sales', 'sku', 'key', 'key'), (3, 'sales', 'status', 'choice', 'schema'), (3, 'sales', 'sold', 'fallback', 'fallback'),
(3, 'sales', 'prior', 'key', 'key'), (3, 'sales', 'tags', 'fallback', 'fallback')"""


def planned() -> list[tuple]:
    """The load order and the generator chosen for each column, with where the choice comes from."""
    schema, config = read_ddl(SHOP), read_config_text(SHOP_CONFIG)
    chosen, found = choose(schema, config), []
    for number, step in enumerate(load_steps(schema), 1):
        for name in step.tables:
            found += [(number, name, column, c.generator, c.source) for column, c in chosen[name].items()]
    return found


def rows_of(text: str) -> list[tuple]:
    return list(eval("[" + text.replace("NULL", "None").replace("false", "False").replace("true", "True") + "]"))  # noqa: S307  the constants above


def test_reports():
    assert analyzed() == rows_of(_ANALYZED) and planned() == rows_of(_PLANNED)
