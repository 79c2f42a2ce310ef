"""Generates the rows of a whole schema: one DataFrame per table, filled in load order, validated, split
into accepted and quarantined rows, and closed under foreign keys."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import generators as g
from tessera.functions import rules
from tessera.functions.draws import Cell
from tessera.functions.names import SYLLABLES
from tessera.operators import assign, validate
from tessera.operators import shared as shared_keys
from tessera.operators.ranks import numbered
from tessera.plans.choices import Choice, choose
from tessera.plans.schema import Column, ForeignKey, Schema, Step, Table, breakable, column_bounds, load_steps
from tessera.sources.config import Config, KeyConfig, TableConfig

DISTINCT = {"sequence", "uuid", "template"}
DISTINCT_PROVIDERS = {"email", "url", "image_url", "slug"}


class GenerationError(ValueError):
    """The run was told to stop at the first broken row, or can't be carried out."""


@dataclass
class Dataset:
    schema: Schema
    steps: list[Step]
    accepted: dict[str, DataFrame] = field(default_factory=dict)
    quarantine: dict[str, DataFrame] = field(default_factory=dict)
    updated: dict[str, list[str]] = field(default_factory=dict)  # columns that are null at first and then set
    warnings: list[str] = field(default_factory=list)

    def rows(self, table: str) -> DataFrame:
        """Accepted rows in schema column order, with idx."""
        return self.accepted[table].select("idx", *[c.name for c in self.schema.table(table).columns])


class _Run:
    def __init__(self, spark: SparkSession, schema: Schema, config: Config):
        self.spark, self.schema, self.config = spark, schema, config
        self.out = Dataset(schema, load_steps(schema), warnings=list(schema.warnings))
        self.choices = choose(schema, config, self.out.warnings)
        self.pending: dict[str, list[list[str]]] = {}
        self.locale = config.locale if config.locale in SYLLABLES else None
        if not self.locale:
            self.out.warnings.append(f"locale {config.locale}: no syllables, names come from short lists")
        self.rules = {t.name: [rules.Rule(text, i) for i, text in enumerate(self.of(t).rules)] for t in schema.tables}

    def of(self, table: Table) -> TableConfig:
        return self.config.tables.get(table.name) or TableConfig()

    def count(self, table: Table) -> int:
        n = self.of(table).rows
        return self.config.rows if n is None else n

    def key_config(self, table: Table, fk: ForeignKey) -> KeyConfig:
        found = [self.of(table).foreign_keys[c] for c in fk.columns if c in self.of(table).foreign_keys]
        config = found[0] if found else KeyConfig()
        if config.null_ratio and not any(table.column(c).nullable for c in fk.columns):
            raise GenerationError(f"{table.name}.{fk.columns[0]}: a null ratio on a key that is NOT NULL")
        if config.strategy is None:
            config = KeyConfig("unique_subset" if table.one_to_one(fk) else "uniform", config.s, config.min, config.max, config.null_ratio)
        return config

    def run(self) -> Dataset:
        for step in self.out.steps:
            for name, columns in step.broken or [(step.tables[0], step.columns)] * (step.kind == "update"):
                self.pending.setdefault(name, []).append(columns)
        for step in self.out.steps:
            if step.kind == "update":
                self.fill(self.schema.table(step.tables[0]), step.columns)
                continue
            for name in step.tables:
                self.table(self.schema.table(name))
            for name, columns in step.broken:
                self.fill(self.schema.table(name), columns)
        self.close()
        return self.out

    def later(self, table: Table) -> list[str]:
        """Columns that wait until other tables have rows."""
        return [c for columns in self.pending.get(table.name, []) for c in columns]

    # foreign keys

    def parent(self, fk: ForeignKey, extra: list[str]) -> DataFrame:
        """Accepted rows of the parent with dense numbers, under names of the child's side."""
        rows = self.out.accepted[self.schema.table(fk.ref_table).name]
        label = fk.columns[0]
        columns = [F.col(r).alias(f"__v_{c}") for r, c in zip(fk.ref_columns, fk.columns)]
        columns += [F.col(c).alias(rules.parent_column(label, c)) for c in extra]
        return numbered(rows.select("idx", *columns), [F.col("idx")], "pidx").drop("idx")

    def extra(self, table: Table, fk: ForeignKey) -> list[str]:
        return sorted({c for r in self.rules[table.name] for name, c in r.parents if name in fk.columns})

    def keys(self, rows: DataFrame, table: Table, n: int, later: list[str]) -> DataFrame:
        waiting = [fk for fk in table.foreign_keys if set(fk.columns) & set(later)]
        own = [fk for fk in table.foreign_keys if self.schema.table(fk.ref_table) is table]
        todo = [fk for fk in table.foreign_keys if fk not in waiting and fk not in own]
        todo.sort(key=lambda fk: (any(table.column(c).nullable for c in fk.columns), -len(fk.columns)))
        parents = {id(fk): self.parent(fk, self.extra(table, fk)) for fk in todo}
        contract: list[ForeignKey] = []
        for parts, shared, keys in self.contracts(table, todo):
            contract += parts
            rows = self.distinct_keys(rows, table, parts, shared, keys, n, parents)
            for fk in parts:
                rows = self.coined(rows, table, fk, [c for c in fk.columns if c not in shared])
        rest = [fk for fk in table.foreign_keys if fk in todo and fk not in contract]
        for members, group in shared_keys.components([fk.columns for fk in rest]):
            fks = [rest[i] for i in members]
            if len(fks) > 1 and group and not set(group) & set(rows.columns) and not self.orphaned(table, fks, parents):
                rows = self.joint(rows, table, fks, group, n, parents)
            else:
                for fk in sorted(fks, key=todo.index):
                    rows = self.assign(rows, table, fk, parents[id(fk)])
        for fk in waiting:
            for c in fk.columns:
                if c not in rows.columns:
                    rows = rows.withColumn(c, F.lit(None).cast(table.column(c).spark_type()))
        return rows

    def orphaned(self, table: Table, fks: list[ForeignKey], parents: dict[int, DataFrame]) -> bool:
        """Whether a key that must not be null has no parents at all."""
        return any(not any(table.column(c).nullable for c in fk.columns) and parents[id(fk)].isEmpty() for fk in fks)

    def side(self, table: Table, fk: ForeignKey, parent: DataFrame, group: list[str]) -> shared_keys.Side:
        config = self.key_config(table, fk)
        members = parent.withColumnsRenamed({f"__v_{c}": c for c in group})
        rest = [c for c in fk.columns if c not in group]
        limits = {"low": config.min, "high": config.max} if config.strategy == "quota" else {}
        if config.null_ratio and not rest:
            self.out.warnings.append(f"{table.name}.{','.join(fk.columns)}: no null ratio, as other keys need these columns")
        ratio = config.null_ratio if any(table.column(c).nullable for c in rest) else 0.0
        return shared_keys.Side(members, ",".join(fk.columns), config.strategy, config.s, null_ratio=ratio, nullable=any(table.column(c).nullable for c in rest), **limits)

    def joint(self, rows: DataFrame, table: Table, fks: list[ForeignKey], group: list[str], n: int, parents: dict[int, DataFrame]) -> DataFrame:
        """Keys that share the columns of `group`, chosen together."""
        sides = [self.side(table, fk, parents[id(fk)], group) for fk in fks]
        rows = shared_keys.assigned(rows, n, sides, group, self.config.seed, table.name)
        return rows.withColumnsRenamed({f"__v_{c}": c for fk in fks for c in fk.columns if c not in group})

    def distinct_keys(self, rows: DataFrame, table: Table, fks: list[ForeignKey], shared: list[str], keys: list[list[int]], n: int, parents: dict[int, DataFrame]) -> DataFrame:
        """rows with foreign keys whose tuples are distinct in each of the keys (numbers of fks)."""
        limits = [self.key_config(table, fk) for fk in fks]
        quotas = len(fks) == 2 and len(keys) == 1 and not shared
        for fk, limit in zip(fks, limits):
            if limit.strategy not in ("uniform", "quota" if quotas else "uniform"):
                self.out.warnings.append(f"{table.name}.{','.join(fk.columns)}: {limit.strategy} isn't kept, as the key's tuples must be distinct")
        if len(keys) > 1:
            group = shared or ["__g"]
            sides = [self.side(table, fk, parents[id(fk)].withColumn("__g", F.lit(0)) if not shared else parents[id(fk)], shared) for fk in fks]
            rows = shared_keys.distinct_in_keys(rows, n, sides, group, keys, self.config.seed, table.name)
            return rows.drop("__g").withColumnsRenamed({f"__v_{c}": c for fk in fks for c in fk.columns if c not in shared})
        if shared:
            return self.shared_tuples(rows, table, fks, shared, n, parents)
        sizes, names = [parents[id(fk)].count() for fk in fks], [f"__p{i}" for i in range(len(fks))]
        if quotas and any(k.strategy == "quota" for k in limits):
            low = tuple(k.min if k.strategy == "quota" else 0 for k in limits)
            high = tuple(k.max if k.strategy == "quota" and k.max is not None else max(n, 1) for k in limits)
            pairs = assign.bounded_pairs(rows, *sizes, low, high, self.config.seed, table.name).withColumnsRenamed({"lpos": "__p0", "rpos": "__p1"})
            rows = rows.join(pairs, "idx")
        else:
            rows = assign.tuples(rows, sizes, names, self.config.seed, table.name)
        for fk, name in zip(fks, names):
            rows = self.take(rows.withColumnRenamed(name, "pidx"), parents[id(fk)], fk, table)
        return rows

    def coined(self, rows: DataFrame, table: Table, fk: ForeignKey, columns: list[str]) -> DataFrame:
        """rows with some of a key's columns null by the key's null ratio."""
        ratio = self.key_config(table, fk).null_ratio
        free = [c for c in columns if table.column(c).nullable]
        drop = Cell(self.config.seed, table.name, ",".join(fk.columns), F.col("idx")).u("null") < ratio
        return rows.withColumns({c: F.when(~drop, F.col(c)) for c in free}) if ratio and free else rows

    def contracts(self, table: Table, fks: list[ForeignKey]) -> list[tuple[list[ForeignKey], list[str], list[list[int]]]]:
        """(fks, shared, keys): foreign keys that make up whole keys, so that their tuples must be distinct, the
        columns that all of them share (none, or a tenant's), and each key as numbers of fks. Keys that have a foreign
        key or shared columns in common are one contract; a key that follows from another one is left out."""
        found: list[tuple[list[ForeignKey], list[str]]] = []
        for key in table.keys():
            parts = [fk for fk in fks if set(fk.columns) <= set(key)]
            parts = [fk for fk in parts if not any(set(fk.columns) < set(other.columns) for other in parts)]
            if len(parts) < 2 or {c for fk in parts for c in fk.columns} != set(key):
                continue
            shared = [c for c in parts[0].columns if all(c in fk.columns for fk in parts)]
            own = [c for fk in parts for c in fk.columns if c not in shared]
            if len(own) == len(set(own)) and all(len(fk.columns) > len(shared) for fk in parts):
                found.append((parts, shared))
        same = lambda a, b: {id(fk) for fk in a} <= {id(fk) for fk in b}
        found = [(a, s) for i, (a, s) in enumerate(found) if not any(same(b, a) and (j < i or not same(a, b)) for j, (b, _) in enumerate(found) if j != i)]
        out = []
        for members, _ in shared_keys.components([[str(id(fk)) for fk in parts] + shared for parts, shared in found]):
            shared = found[members[0]][1]
            for i in members:
                if sorted(found[i][1]) != sorted(shared):
                    self.out.warnings.append(f"{table.name}: a key that shares other columns than ({', '.join(shared)}) isn't chosen jointly")
            members = [i for i in members if sorted(found[i][1]) == sorted(shared)]
            parts = [fk for fk in fks if any(fk in found[i][0] for i in members)]
            out.append((parts, shared, [[parts.index(fk) for fk in found[i][0]] for i in members]))
        return out

    def shared_tuples(self, rows: DataFrame, table: Table, fks: list[ForeignKey], shared: list[str], n: int, parents: dict[int, DataFrame]) -> DataFrame:
        """rows with keys that agree on the shared columns, each combination once: distinct tuples of members
        of the same group."""
        names, members = [f"__p{i}" for i in range(len(fks))], []
        for fk in fks:
            one = parents[id(fk)].withColumnsRenamed({f"__v_{c}": c for c in shared}).where(" and ".join(f"`{c}` is not null" for c in shared))
            members.append(one)
        sides = [m.groupBy(*shared).agg(F.count(F.lit(1)).alias("n")) for m in members]
        rows = rows.join(assign.group_tuples(sides, shared, names, n, self.config.seed, table.name), "idx")
        for fk, one, name in zip(fks, members, names):
            placed = assign.positions(one, shared, ["pidx"], name).drop("n", "pidx")
            rows = rows.join(placed, [*shared, name]).drop(name)
            rows = rows.withColumnsRenamed({f"__v_{c}": c for c in fk.columns if c not in shared})
        return rows

    def take(self, rows: DataFrame, parent: DataFrame, fk: ForeignKey, table: Table) -> DataFrame:
        """rows with the key of the parent that pidx names."""
        rows = rows.join(parent, "pidx", "left").drop("pidx")
        for c in fk.columns:
            rows = rows.drop(f"__v_{c}") if c in rows.columns else rows.withColumnRenamed(f"__v_{c}", c)
        return rows

    def assign(self, rows: DataFrame, table: Table, fk: ForeignKey, parent: DataFrame) -> DataFrame:
        seed, name, label, config = self.config.seed, table.name, ",".join(fk.columns), self.key_config(table, fk)
        shared = [c for c in fk.columns if c in rows.columns]
        count = parent.count()
        if shared:
            rows = shared_keys.completed(rows, self.side(table, fk, parent, shared), shared, seed, name)
            return rows.withColumnsRenamed({f"__v_{c}": c for c in fk.columns if c not in shared})
        nullable = any(table.column(c).nullable for c in fk.columns)
        if not count:
            if not nullable:
                self.out.warnings.append(f"{name}.{label}: no accepted parent rows")
            for c in fk.columns:
                rows = rows.withColumn(c, F.lit(None).cast(table.column(c).spark_type()))
            return rows
        chosen = rows.select("idx")
        drop = Cell(seed, name, label, F.col("idx")).u("null") < config.null_ratio
        holders = chosen.where(~drop) if config.null_ratio else chosen
        if config.strategy in ("unique_subset", "quota"):
            dense = numbered(holders.withColumnRenamed("idx", "row"), [F.col("row")], "idx")
            if config.strategy == "quota":
                given = assign.quota(dense, count, config.min, config.max, seed, name, label)
            else:
                given = assign.unique_subset(dense, count, seed, name, label)
            given = given.select(F.col("row").alias("idx"), "pidx")
        elif config.strategy == "zipf":
            given = assign.zipf(holders, count, seed, name, label, config.s).select("idx", "pidx")
        else:
            given = assign.uniform(holders, count, seed, name, label)
        return self.take(rows.join(given, "idx", "left"), parent, fk, table)

    def tree(self, rows: DataFrame, table: Table, fk: ForeignKey) -> DataFrame:
        """Keys to other rows of the table: a tree by levels, or one within each group of shared columns.
        Roots have null, or themselves where the key is NOT NULL."""
        level = self.config.hierarchy.get(f"{table.name}.{fk.columns[-1]}")
        branching, depth = (level.branching, level.max_depth) if level else (5, None)
        shared = [c for c in fk.columns if c in rows.columns]
        mine = [c for c in fk.columns if c not in shared]
        refs = dict(zip(fk.columns, fk.ref_columns))
        if shared:
            placed = assign.positions(rows, shared, ["idx"], "__pos", "__n").drop("__n")
            up = placed.select(*shared, F.col("__pos").alias("__up"), *[F.col(refs[c]).alias(f"__v_{c}") for c in mine])
            placed = placed.withColumn("__up", F.when(F.col("__pos") > 0, F.expr(f"(__pos - 1) div {branching}")))
            rows = placed.join(up, [*shared, "__up"], "left").drop("__pos", "__up")
        else:
            placed = assign.leveled(rows, rows.count(), branching, self.config.seed, table.name, fk.columns[0], depth)
            up = rows.select(F.col("idx").alias("parent_idx"), *[F.col(refs[c]).alias(f"__v_{c}") for c in mine])
            rows = placed.join(up, "parent_idx", "left").drop("parent_idx", "level")
        free = breakable(table, fk)
        for c in mine:
            value = F.col(f"__v_{c}") if c in free else F.coalesce(f"__v_{c}", refs[c])
            rows = rows.withColumn(c, value).drop(f"__v_{c}")
        if any(c not in free for c in mine):
            self.out.warnings.append(f"{table.name}: roots refer to themselves")
        return rows

    # columns

    def value(self, table: Table, column: Column, choice: Choice, cell: Cell):
        if choice.generator == "serial":
            return (F.col("idx") + 1).cast(column.spark_type())
        if choice.generator == "fallback":
            made = g.fallback(cell, column.kind, scale=column.scale or 0 if column.precision else 2, precision=column.precision or 10, values=column.values, length=column.length)
        else:
            params = dict(choice.params)
            if choice.generator == "fake":
                params.setdefault("locale", self.locale)
            if choice.generator == "integer_range":
                params.setdefault("bits", column.bits)
            if choice.generator == "numeric_range":
                params.setdefault("scale", column.scale if column.precision else 2)
                params.setdefault("precision", column.precision or 18)
            if column.kind == "integer" and choice.generator == "numeric_range":
                params = {k: v for k, v in params.items() if k not in ("scale", "precision")} | {"bits": column.bits}
                made = g.integer_range(cell, **params)
            elif choice.generator in ("normal", "lognormal"):
                exclusive = {k: params.pop(k) for k in ("min_exclusive", "max_exclusive") if k in params}
                made = g.resolve(choice.generator)(cell, **params)
                scale = 0 if column.kind == "integer" else column.scale or 0 if column.precision else None
                if scale is not None and (column.precision or 18) <= 18:
                    made = g.snapped(made, params["low"], params["high"], scale, column.precision or 18, **exclusive)
            else:
                if choice.generator == "zipf" and column.kind == "integer":
                    params.setdefault("bits", column.bits)
                made = g.resolve(choice.generator)(cell, **params)
        if column.kind == "text" and column.length:
            made = F.substring(made, 1, column.length)
        return made.cast(column.spark_type())

    def cell(self, table: Table, column: str) -> Cell:
        return Cell(self.config.seed, table.name, column, F.col("idx"))

    def columns(self, rows: DataFrame, table: Table) -> DataFrame:
        derived = {r.column: r for r in self.rules[table.name] if r.kind == "derivation"}
        free = {key[-1] for key in table.keys() if len(key) > 1 and self.choices[table.name][key[-1]].source != "key" and not table.column(key[-1]).serial}
        free = {c for c in free if table.column(c).kind == "integer" and not table.column(c).array or not self.choices[table.name][c].unique} - derived.keys()
        for column in table.columns:
            choice = self.choices[table.name][column.name]
            if column.name in rows.columns or choice.source == "key" or column.name in derived or column.name in free:
                continue
            cell = self.cell(table, column.name)
            certain = not column.array and (choice.generator in DISTINCT | {"serial"} or choice.params.get("provider") in DISTINCT_PROVIDERS)
            if choice.unique and not column.array and (column.kind, choice.generator) in (("integer", "integer_range"), ("integer", "fallback")):
                params = {"bits": column.bits} | (choice.params if choice.generator == "integer_range" else {})
                made = g.distinct_integers(cell, self.count(table), **params).cast(column.spark_type())
                rows = rows.withColumn(column.name, g.nullable(cell, choice.null_ratio, made) if choice.null_ratio else made)
            elif choice.unique and not certain:
                made = validate.distinct_values(rows.select("idx"), self.draw(table, column, choice), column.name, "idx")
                rows = rows.join(made, "idx")
                if choice.null_ratio:
                    rows = rows.withColumn(column.name, g.nullable(cell, choice.null_ratio, F.col(column.name)))
            else:
                made = self.made(table, column, choice, cell)
                rows = rows.withColumn(column.name, g.nullable(cell, choice.null_ratio, made) if choice.null_ratio else made)
        for key in table.keys():
            if key[-1] in free and key[-1] not in rows.columns:  # the last column counts or is drawn within the others
                column, choice, others = table.column(key[-1]), self.choices[table.name][key[-1]], key[:-1]
                if column.kind == "integer" and not column.array:
                    low = int(column_bounds(table, key[-1]).get("low", 1))
                    rows = assign.positions(rows, others, ["idx"], "__pos", "__n").drop("__n")
                    rows = rows.withColumn(key[-1], (F.col("__pos") + low).cast(column.spark_type())).drop("__pos")
                    continue
                if set(others) <= set(rows.columns):
                    made = validate.distinct_values(rows.select("idx", *others), self.draw(table, column, choice), key[-1], "idx", within=others)
                    rows = rows.join(made.select("idx", key[-1]), "idx")
                else:  # the others come later, from a rule or from the table itself
                    rows = rows.withColumn(key[-1], self.made(table, column, choice, self.cell(table, key[-1])))
                if choice.null_ratio:
                    rows = rows.withColumn(key[-1], g.nullable(self.cell(table, key[-1]), choice.null_ratio, F.col(key[-1])))
        return rows

    def made(self, table: Table, column: Column, choice: Choice, cell: Cell):
        """A value of the column's type: for an array, 0 to 5 elements of the column's generator."""
        if not column.array:
            return self.value(table, column, choice, cell)
        one, longest = replace(column, array=False), 5
        element = lambda k: self.value(table, one, choice, Cell(cell.seed, cell.table, cell.column, cell.idx * longest + k))
        size = g.pick(cell.u("len"), longest + 1).cast("int")
        return F.slice(F.array(*map(element, range(longest))), F.lit(1), size)

    def draw(self, table: Table, column: Column, choice: Choice):
        return lambda k: self.made(table, column, choice, self.cell(table, f"{column.name}~{k}"))

    def apply_rules(self, rows: DataFrame, table: Table) -> DataFrame:
        """Derivations and bounds, each after those it reads; all bounds of a column at once, by its last one."""
        steps = rules.ordered(self.rules[table.name])
        derived = {r.column for r in steps if r.kind == "derivation"}
        for k, rule in enumerate(steps):
            column = table.column(rule.column)
            cell = self.cell(table, column.name)
            if rule.kind == "bound" and column.name not in derived and not column.array and column.kind in ("integer", "numeric", "date", "timestamp"):
                same = [r for r in steps if r.kind == "bound" and r.column == rule.column]
                if rule is same[-1]:
                    rows = self.bound(rows, table, column, same)
                continue
            rows = rules.evaluate(rows, "__rule", rule.right, cell, self.config.refs, rule.number)
            value = F.col("__rule").cast(column.spark_type())
            if rule.kind == "bound":
                if rule.op in (">", "<") and column.kind in ("integer", "numeric", "date"):
                    value = F.date_add(value, 1 if rule.op == ">" else -1) if column.kind == "date" else value + (1 if rule.op == ">" else -1)
                low, high = (value, None) if rule.op.startswith(">") else (None, value)
                value = g.bounded(F.col(column.name), low, high)
            rows = rows.withColumn(column.name, value.cast(column.spark_type())).drop("__rule")
        return rows

    def bound(self, rows: DataFrame, table: Table, column: Column, bounds: list[rules.Rule]) -> DataFrame:
        """A column within all of its row's bounds and its generator's own edges, by the generator's distribution."""
        cell, choice = self.cell(table, column.name), self.choices[table.name][column.name]
        epoch = {"date": F.lit(dt.date(1970, 1, 1)), "timestamp": F.lit("1970-01-01 00:00:00").cast("timestamp" if column.with_timezone else "timestamp_ntz")}.get(column.kind)

        def number(c):
            """A value on the scale that is drawn on: days, seconds or the number itself."""
            if column.kind == "date":
                return F.datediff(c.cast("date"), epoch).cast("double")
            if column.kind == "timestamp":
                return F.timestamp_diff("SECOND", epoch, c.cast(column.spark_type())).cast("double")
            return c.cast("double")

        lows, highs, names = [], [], []
        for i, rule in enumerate(bounds):
            rows = rules.evaluate(rows, f"__b{i}", rule.right, cell, self.config.refs, rule.number)
            names.append(f"__b{i}")
            (lows if rule.op.startswith(">") else highs).append((number(F.col(f"__b{i}")), len(rule.op) == 1))
        edges = dict(choice.params)
        if choice.generator == "fallback" and column.kind in ("date", "timestamp"):
            edges = {"low": g.DECADE[0], "high": g.DECADE[1]}
        elif choice.generator == "fallback":
            edges = {"low": 0, "high": 1000}
        for side, name in ((lows, "low"), (highs, "high")):
            if edges.get(name) is not None:
                plain = isinstance(edges[name], (dt.date, str))
                side.append((number(F.lit(edges[name])) if plain else F.lit(float(edges[name])), bool(edges.get(f"{'min' if name == 'low' else 'max'}_exclusive"))))
        unit = {"integer": 1.0, "date": 1.0, "timestamp": 1.0}.get(column.kind, 10.0 ** -(column.scale or 0) if column.precision else None)
        own = number(F.col(column.name))
        made = g.within_bounds(rows.withColumn("__own", own), cell, "__own", lows, highs, unit, g.shape_of(choice.generator, choice.params))
        back = {"date": lambda: F.date_add(epoch, F.col("__made").cast("int")), "timestamp": lambda: F.timestamp_add("SECOND", F.col("__made").cast("bigint"), epoch)}.get(column.kind, lambda: F.col("__made"))()
        kept = F.when(F.col("__made") == F.col("__own"), F.col(column.name)).otherwise(back.cast(column.spark_type()))
        return made.withColumn(column.name, kept).drop("__made", "__own", *names)

    # validation

    def checks(self, rows: DataFrame, table: Table, later: list[str]) -> list:
        out = [validate.not_null(c.name) for c in table.columns if not c.nullable and c.name not in later]
        for c in table.columns:
            if c.length and not c.array:
                out.append(validate.width(c.name, c.length))
            if c.values and not c.array:
                out.append(validate.bounds(c.name, values=c.values))
        for fk in table.foreign_keys:
            if fk.match_full and len(fk.columns) > 1 and not set(fk.columns) & set(later):
                out.append(validate.match_full(fk.columns))
        for text in [*table.checks, *[x for c in table.columns for x in c.checks]]:
            try:
                check = validate.check(text, name=table.names.get(text))
                rows.select(check)
                out.append(check)
            except (AnalysisException, ParseException, rules.RuleError):
                self.out.warnings.append(f"{table.name}: check not understood: {text}")
        return out

    def rule_checks(self, table: Table) -> tuple[dict, list]:
        """Every rule as a check of the finished row, and the helper columns that they name: assertions, and
        again derivations and bounds, as a later rule, a cast or a CHECK may have moved a value. What is unknown
        breaks an assertion, but no derivation or bound."""
        helpers, out = {}, []
        for rule in self.rules[table.name]:
            cell = self.cell(table, rule.column or f"rule{rule.number}")
            sql, own = rules.compile_text(rule.text if rule.kind == "assertion" else rule.right, cell, self.config.refs, rule.number)
            helpers |= own
            if rule.kind == "assertion":
                out.append(validate.rule(F.expr(rules.two_valued(sql)), [], rule.text))
                continue
            column, op = table.column(rule.column), rule.op
            wanted = F.expr(sql).cast(column.spark_type()) if op == "=" else F.expr(sql)
            made = F.col(column.name)
            kept = {"=": made.eqNullSafe(wanted), ">=": made >= wanted, "<=": made <= wanted, ">": made > wanted, "<": made < wanted}[op]
            out.append(validate.rule(F.coalesce(kept, F.lit(True)), [column.name], rule.text))
        return helpers, out

    def split(self, rows: DataFrame, table: Table, later: list[str]) -> None:
        """Broken rows go to quarantine first; of the rest, rows that repeat a key."""
        helpers, again = self.rule_checks(table)
        checked = validate.with_issues(rows.withColumns(helpers), [*self.checks(rows, table, later), *again]).drop(*helpers)
        checked = validate.checkpointed(checked)
        bad = validate.quarantined(checked)
        good = validate.accepted(checked)
        keys = [key for key in table.keys() if not set(key) & set(later)]
        for key in validate.repeated_keys(good, keys):
            repeated = validate.duplicates(good, key, ["idx"]).select("idx").withColumn("__repeated", F.lit(True))
            marked = validate.checkpointed(good.join(repeated, "idx", "left"))
            name = table.names.get(",".join(key))
            issue = F.array(F.struct(F.lit(",".join(key)).alias("columns"), F.lit(f"not unique: {name}" if name else "not unique").alias("reason")))
            bad = bad.unionByName(marked.where("__repeated").drop("__repeated").withColumn("issues", issue), allowMissingColumns=True)
            good = marked.where("__repeated is null").drop("__repeated")
        if self.config.on_error == "abort" and (first := bad.orderBy("idx").first()):
            raise GenerationError(f"{table.name}, row {first['idx']}: {first['issues'][0]['reason']} ({first['issues'][0]['columns']})")
        if table.name in self.out.quarantine:  # of the time before a key was filled
            bad = self.out.quarantine[table.name].unionByName(bad, allowMissingColumns=True)
        self.out.accepted[table.name], self.out.quarantine[table.name] = good, bad

    def table(self, table: Table) -> None:
        n, later = self.count(table), self.later(table)
        rows = self.spark.range(n).withColumnRenamed("id", "idx")
        rows = self.keys(rows, table, n, later)
        rows = self.columns(rows, table)
        for fk in table.foreign_keys:
            if self.schema.table(fk.ref_table) is table:
                rows = self.tree(rows, table, fk)
        self.split(self.apply_rules(rows, table), table, later)

    def fill(self, table: Table, columns: list[str]) -> None:
        """Keys that were left null to break a cycle get a parent that agrees on the other columns."""
        for fk in table.foreign_keys:
            if not set(columns) <= set(fk.columns) or self.schema.table(fk.ref_table) is table:
                continue
            rows = self.out.accepted[table.name]
            mine = [c for c in fk.columns if c in columns]
            shared = [c for c in fk.columns if c not in columns]
            parent = self.parent(fk, [])
            if shared:
                filled = shared_keys.completed(rows.drop(*mine), self.side(table, fk, parent, shared), shared, self.config.seed, table.name)
            else:
                filled = self.assign(rows.drop(*mine), table, fk, parent)
            filled = filled.withColumnsRenamed({f"__v_{c}": c for c in mine if c not in filled.columns})
            self.out.updated.setdefault(table.name, []).extend(mine)
            self.pending[table.name] = [c for c in self.pending.get(table.name, []) if c != columns]
            self.split(filled, table, self.later(table))
            return

    def close(self) -> None:
        keys = [(t.name, fk.columns, self.schema.table(fk.ref_table).name, fk.ref_columns) for t in self.schema.tables for fk in t.foreign_keys]
        before = self.out.accepted
        self.out.accepted = validate.closure(before, keys)
        for name, kept in self.out.accepted.items():
            lost = before[name].join(kept.select("idx"), "idx", "left_anti")
            issue = F.array(F.struct(F.lit("").alias("columns"), F.lit("parent quarantined").alias("reason")))
            self.out.quarantine[name] = self.out.quarantine[name].unionByName(lost.withColumn("issues", issue), allowMissingColumns=True)


def generate(spark: SparkSession, schema: Schema, config: Config) -> Dataset:
    return _Run(spark, schema, config).run()
