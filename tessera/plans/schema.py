"""A relational schema as plain values, its Spark types, load order and bounds."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field
from decimal import Decimal
from itertools import combinations

from pyspark.sql import types as T


class SchemaError(ValueError):
    """A schema that can't be loaded in any order, or names what isn't there."""


@dataclass
class Column:
    name: str
    kind: str = "text"  # integer numeric text date timestamp boolean uuid enum json bytea
    nullable: bool = True
    bits: int = 32
    precision: int | None = None
    scale: int | None = None
    length: int | None = None
    with_timezone: bool = False
    serial: bool = False
    array: bool = False
    values: list[str] = field(default_factory=list)
    default: str | None = None
    checks: list[str] = field(default_factory=list)
    comment: str | None = None

    def spark_type(self) -> T.DataType:
        one: T.DataType = T.StringType()
        if self.kind == "integer":
            one = {16: T.ShortType(), 32: T.IntegerType(), 64: T.LongType()}[self.bits]
        elif self.kind == "numeric":
            one = T.DecimalType(min(38, self.precision), self.scale or 0) if self.precision else T.DoubleType()
        elif self.kind in ("date", "boolean", "bytea"):
            one = {"date": T.DateType(), "boolean": T.BooleanType(), "bytea": T.BinaryType()}[self.kind]
        elif self.kind == "timestamp":
            one = T.TimestampType() if self.with_timezone else T.TimestampNTZType()
        return T.ArrayType(one, containsNull=False) if self.array else one


@dataclass
class ForeignKey:
    columns: list[str]
    ref_table: str
    ref_columns: list[str] = field(default_factory=list)
    deferrable: bool = False
    match_full: bool = False
    set_null: list[str] = field(default_factory=list)
    on_delete: str | None = None
    on_update: str | None = None


@dataclass
class Table:
    name: str
    columns: list[Column] = field(default_factory=list)
    primary_key: list[str] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    uniques: list[list[str]] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    comment: str | None = None
    names: dict[str, str] = field(default_factory=dict)  # of constraints, by their columns or text

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise SchemaError(f"{self.name} has no column {name}")

    def spark_schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type(), c.nullable, {"comment": c.comment} if c.comment else {}) for c in self.columns])

    def keys(self) -> list[list[str]]:
        return ([self.primary_key] if self.primary_key else []) + self.uniques

    def kind(self, referenced: bool = False) -> str:
        """bridge: a key made of the columns of two foreign keys or more, and at most two other columns.
        lookup: a table of at most three columns without foreign keys that another refers to."""
        shared = {c for fk in self.foreign_keys for c in fk.columns}
        joins = lambda key: set(key) <= shared and sum(bool(set(fk.columns) & set(key)) for fk in self.foreign_keys) >= 2
        if any(map(joins, self.keys())) and len([c for c in self.columns if c.name not in shared]) <= 2:
            return "bridge"
        return "lookup" if referenced and not self.foreign_keys and len(self.columns) <= 3 else "regular"

    def one_to_one(self, fk: ForeignKey) -> bool:
        return sorted(fk.columns) in [sorted(k) for k in self.keys()]


@dataclass
class Schema:
    tables: list[Table] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def table(self, name: str) -> Table:
        for t in self.tables:
            if name in (t.name, t.name.rpartition(".")[2]):
                return t
        raise SchemaError(f"no table {name}")

    def kinds(self) -> dict[str, str]:
        """The kind of each table: bridge, lookup or regular."""
        referenced = {self.table(fk.ref_table).name for t in self.tables for fk in t.foreign_keys}
        return {t.name: t.kind(t.name in referenced) for t in self.tables}

    def hash(self) -> str:
        """SHA-256 of the schema, without warnings; the order of tables doesn't count."""
        plain = sorted((asdict(t) for t in self.tables), key=lambda t: t["name"])
        return hashlib.sha256(json.dumps(plain, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def finish(self) -> Schema:
        """Keys are not null; a foreign key without columns takes the parent's primary key."""
        for t in self.tables:
            for c in t.primary_key:
                t.column(c).nullable = False
            t.uniques = [u for u in t.uniques if sorted(u) != sorted(t.primary_key)]
            for fk in t.foreign_keys:
                parent = self.table(fk.ref_table)
                fk.ref_columns = fk.ref_columns or list(parent.primary_key)
                if len(fk.ref_columns) != len(fk.columns):
                    raise SchemaError(f"{t.name}({', '.join(fk.columns)}) and {parent.name}({', '.join(fk.ref_columns)}) differ in length")
                [t.column(c) for c in fk.columns]
                [parent.column(c) for c in fk.ref_columns]
        return self


_ATOM = re.compile(r"^\(*\s*(\w+)\s*(>=|<=|<>|!=|=|>|<)\s*('[^']*'|-?\d+(?:\.\d+)?)\s*\)*$", re.S)
_FLIPPED = re.compile(r"^\(*\s*('[^']*'|-?\d+(?:\.\d+)?)\s*(>=|<=|>|<)\s*(\w+)\s*\)*$", re.S)
_BETWEEN = re.compile(r"^\(*\s*(\w+)\s+between\s+('[^']*'|-?[\d.]+)\s+and\s+('[^']*'|-?[\d.]+)\s*\)*$", re.I | re.S)
_IN = re.compile(r"^\(*\s*(\w+)\s+(not\s+)?in\s*\(([^()]*)\)\s*\)*$", re.I | re.S)
_NOT = re.compile(r"^\(*\s*not\s*\(\s*([^()]+?)\s*\)\s*\)*$|^\(*\s*not\s+([^()]+?)\s*\)*$", re.I | re.S)
_INVERSE = {">": "<=", ">=": "<", "<": ">=", "<=": ">", "=": "<>", "<>": "=", "!=": "="}
_TURN = {">=": "<=", "<=": ">=", ">": "<", "<": ">"}


def _value(text: str):
    return text[1:-1] if text.startswith("'") else Decimal(text)


def check_bounds(check: str) -> dict[str, dict]:
    """Bounds by column that a CHECK of simple comparisons joined by AND gives; {} where it is more than
    that (it is still validated as a predicate)."""
    text = check.strip()
    if re.search(r"\bor\b|\blike\b|\w\s*\(", re.sub(r"\b(?:in|not)\s*\(", "", re.sub(r"'[^']*'", "''", text), flags=re.I), re.I):
        return {}
    parts = re.split(r"\band\b", re.sub(r"(\bbetween\s+\S+\s+)and\b", r"\1\0", text, flags=re.I), flags=re.I)
    out: dict[str, dict] = {}
    for part in (p.replace("\0", "and").strip() for p in parts):
        if m := _BETWEEN.match(part):
            found = [(m[1], "low", _value(m[2]), False), (m[1], "high", _value(m[3]), False)]
        elif m := _IN.match(part):
            values = [_value(v.strip()) for v in m[3].split(",")]
            found = [(m[1], "excluded" if m[2] else "values", values, False)]
        else:
            negated = _NOT.match(part)
            part = (negated[1] or negated[2]) if negated else part
            m = _ATOM.match(part)
            name, op, value = m.groups() if m else (None, None, None)
            if not m:
                if not (m := _FLIPPED.match(part)):
                    return {}
                value, op, name = m[1], _TURN[m[2]], m[3]
            op = _INVERSE[op] if negated else op
            value = _value(value)
            found = {
                ">": [(name, "low", value, True)], ">=": [(name, "low", value, False)], "<": [(name, "high", value, True)], "<=": [(name, "high", value, False)],
                "=": [(name, "values", [value], False)], "<>": [(name, "excluded", [value], False)], "!=": [(name, "excluded", [value], False)],
            }[op]
        for name, bound, value, exclusive in found:
            tighten(out.setdefault(name, {}), bound, value, exclusive)
    return out if len(out) == 1 else {}


def tighten(bounds: dict, bound: str, value, exclusive: bool = False) -> None:
    """Add a bound; of two the tighter stays, of equal ones the exclusive."""
    if bound == "values":
        bounds["values"] = [v for v in bounds["values"] if v in value] if "values" in bounds else list(value)
    elif bound == "excluded":
        bounds["excluded"] = list(dict.fromkeys([*bounds.get("excluded", []), *value]))
    else:
        old, flag = bounds.get(bound), f"{bound}_exclusive"
        if old is None or (value > old if bound == "low" else value < old):
            bounds[bound], bounds[flag] = value, exclusive
        elif value == old:
            bounds[flag] = bounds.get(flag, False) or exclusive


def column_bounds(table: Table, column: str) -> dict:
    out: dict = {}
    for check in [*table.checks, *table.column(column).checks]:
        found = check_bounds(check).get(column, {})
        for bound in ("low", "high"):
            if bound in found:
                tighten(out, bound, found[bound], found[f"{bound}_exclusive"])
        for bound in ("values", "excluded"):
            if bound in found:
                tighten(out, bound, found[bound])
    return out


def components(edges: dict[str, set[str]]) -> list[list[str]]:
    """Groups of nodes that depend on each other, each after those that it depends on."""
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    out: list[list[str]] = []

    def visit(node: str) -> None:
        number[node] = low[node] = len(number)
        stack.append(node)
        for other in sorted(edges[node]):
            if other not in number:
                visit(other)
            if other in stack:
                low[node] = min(low[node], low[other])
        if low[node] == number[node]:
            at = stack.index(node)
            out.append(sorted(stack[at:]))
            del stack[at:]

    for node in sorted(edges):
        if node not in number:
            visit(node)
    return out


@dataclass
class Step:
    """insert, leveled (a table that refers to itself), update (fills keys left null) or deferred: tables in an order
    in which all keys but the broken ones (table, columns) find their parents."""

    kind: str
    tables: list[str]
    columns: list[str] = field(default_factory=list)
    broken: list[tuple[str, list[str]]] = field(default_factory=list)


def breakable(table: Table, fk: ForeignKey) -> list[str]:
    """The columns that may be null to leave a key open; under MATCH FULL all of them or none."""
    free = [c for c in fk.columns if table.column(c).nullable]
    return free if not fk.match_full or len(free) == len(fk.columns) else []


#: Sets of keys up to so many in number are tried in full; beyond, keys are broken one by one.
TRIED = 4096


def broken_keys(schema: Schema, group: list[str], inner: list[tuple[str, ForeignKey]], allowed: list[tuple[str, ForeignKey]]) -> tuple[list[tuple[str, ForeignKey]], list[str]] | None:
    """A smallest set of the allowed keys without which the tables of a cycle can be ordered, and that order; the
    first such set in the order of tables and keys."""

    def order(without: list) -> list[str] | None:
        gone = {id(fk) for _, fk in without}
        rest = {n: {schema.table(fk.ref_table).name for m, fk in inner if m == n and id(fk) not in gone} for n in group}
        found = components(rest)
        return [c[0] for c in found] if all(len(c) == 1 for c in found) else None

    tried = 0
    for size in range(1, len(allowed) + 1):
        for some in combinations(allowed, size):
            if (found := order(list(some))) is not None:
                return list(some), found
            tried += 1
            if tried > TRIED:
                break
        if tried > TRIED:
            break
    if order(allowed) is None:
        return None
    kept = list(allowed)
    for one in allowed:  # drop what isn't needed
        rest = [x for x in kept if x is not one]
        if order(rest) is not None:
            kept = rest
    return kept, order(kept)


def load_steps(schema: Schema) -> list[Step]:
    """The order in which tables are filled. A cycle is broken by the fewest foreign keys that may be null and
    are filled afterwards, else, with keys that are deferrable, loaded in one transaction, else it is an error."""
    edges = {t.name: {schema.table(fk.ref_table).name for fk in t.foreign_keys} - {t.name} for t in schema.tables}
    steps, updates = [], []
    for group in components(edges):
        if len(group) == 1:
            steps.append(_single(schema, group[0]))
            continue
        inner = [(n, fk) for n in group for fk in schema.table(n).foreign_keys if schema.table(fk.ref_table).name in group and schema.table(fk.ref_table).name != n]
        free = [(n, fk) for n, fk in inner if breakable(schema.table(n), fk)]
        open_ = [(n, fk) for n, fk in inner if fk.deferrable and (n, fk) not in free]
        if found := broken_keys(schema, group, inner, free):
            steps += [_single(schema, name) for name in found[1]]
            updates += [Step("update", [name], breakable(schema.table(name), fk)) for name, fk in found[0]]
        elif open_ and (found := broken_keys(schema, group, inner, open_) or broken_keys(schema, group, inner, [*free, *open_])):
            broken = [(name, breakable(schema.table(name), fk) or _own(schema.table(name), fk)) for name, fk in found[0]]
            steps.append(Step("deferred", found[1], broken=broken))
        else:
            named = "; ".join(f"{n}({', '.join(fk.columns)}) to {fk.ref_table}" for n, fk in inner)
            raise SchemaError(f"cycle {' -> '.join(group)}: no foreign keys that may be null or are deferrable break it: {named}")
    return steps + updates


def _own(table: Table, fk: ForeignKey) -> list[str]:
    """A key's columns that no other key has; all of them if there are none."""
    return [c for c in fk.columns if not any(c in other.columns for other in table.foreign_keys if other is not fk)] or fk.columns


def _single(schema: Schema, name: str) -> Step:
    table = schema.table(name)
    own = [fk for fk in table.foreign_keys if schema.table(fk.ref_table) is table]
    return Step("leveled", [name], own[0].columns) if own else Step("insert", [name])
