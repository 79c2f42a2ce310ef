"""Constraint checks over rows, quarantine, and referential closure.

Every check yields an array of issues (columns, reason); a row with any issue is quarantined."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.rules import check_text

ISSUES = "array<struct<columns:string,reason:string>>"


def issue(broken: Column, columns: str | Iterable[str], reason: str) -> Column:
    names = columns if isinstance(columns, str) else ",".join(columns)
    return F.when(broken, F.struct(F.lit(names).alias("columns"), F.lit(reason).alias("reason")))


def not_null(column: str) -> Column:
    return issue(F.col(column).isNull(), column, "null")


def check(predicate: str, columns: Iterable[str] = (), name: str | None = None) -> Column:
    """An SQL CHECK: a row breaks it only if it is false, not if it is unknown. It may call what rules may."""
    return issue(~F.coalesce(F.expr(check_text(predicate)), F.lit(True)), columns, f"check {name}: {predicate}" if name else f"check {predicate}")


def rule(predicate: Column, columns: Iterable[str], text: str) -> Column:
    """A rule of two values: unknown is broken."""
    return issue(~F.coalesce(predicate, F.lit(False)), columns, f"rule {text}")


def bounds(column: str, *, low=None, high=None, low_exclusive: bool = False, high_exclusive: bool = False, values=None, excluded=None) -> Column:
    """The bounds of a CHECK as one test; for an array column each element is tested."""

    def broken(c: Column) -> Column:
        bad = F.lit(False)
        if low is not None:
            bad = bad | ((c <= low) if low_exclusive else (c < low))
        if high is not None:
            bad = bad | ((c >= high) if high_exclusive else (c > high))
        if values is not None:
            bad = bad | ~c.isin(*values)
        if excluded:
            bad = bad | c.isin(*excluded)
        return F.coalesce(bad, F.lit(False))

    return issue(broken(F.col(column)), column, "out of bounds")


def element_bounds(column: str, low=None, high=None) -> Column:
    bad = F.exists(column, lambda e: F.coalesce(~e.between(low, high), F.lit(False)))
    return issue(F.coalesce(bad, F.lit(False)), column, "out of bounds")


def width(column: str, length: int) -> Column:
    return issue(F.char_length(column) > length, column, f"longer than {length}")


def castable(column: str, type_name: str) -> Column:
    """For rows from outside: the text must be a value of the type."""
    return issue(F.col(column).isNotNull() & F.col(column).try_cast(type_name).isNull(), column, f"not {type_name}")


def with_issues(df: DataFrame, checks: Iterable[Column], name: str = "issues") -> DataFrame:
    old = [F.col(name)] if name in df.columns else []
    return df.withColumn(name, F.concat(*old, F.array_compact(F.array(*checks))) if old else F.array_compact(F.array(*checks)))


def accepted(df: DataFrame, name: str = "issues") -> DataFrame:
    return df.where(F.size(name) == 0).drop(name)


def quarantined(df: DataFrame, name: str = "issues") -> DataFrame:
    return df.where(F.size(name) > 0)


def quarantine_summary(tables: dict[str, DataFrame], order: str) -> DataFrame:
    """(table, rows, first_reason) of each table's quarantined rows."""
    parts = [
        df.select(F.lit(name).alias("table"), F.col(order).cast("bigint").alias("o"), F.col("issues")[0]["reason"].alias("reason"))
        for name, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("table").agg(F.count(F.lit(1)).alias("rows"), F.min_by("reason", "o").alias("first_reason"))


def firsts(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """(key, order) of each key's first row; keys with a null are left out, as SQL's UNIQUE has it."""
    known = df.where(" and ".join(f"`{c}` is not null" for c in key))
    least = known.groupBy(*key).agg(F.min(F.struct(*order)).alias("__f"))
    return least.select(*key, *[F.col(f"__f.{c}").alias(c) for c in order])


def repeated_keys(df: DataFrame, keys: list[list[str]]) -> list[list[str]]:
    """Those of the keys of which some value occurs twice: one job for all of them."""
    found = None
    for i, key in enumerate(keys):
        known = df.where(" and ".join(f"`{c}` is not null" for c in key))
        again = known.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1).select(F.lit(i).alias("key"))
        found = again if found is None else found.unionByName(again)
    return [keys[r["key"]] for r in found.distinct().orderBy("key").collect()] if found is not None else []


def duplicates(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The rows that repeat an earlier row's key. First rows are aggregated before the shuffle and joined
    on key and order, so a hot key's rows stay spread. Of rows equal in both, one is the first."""
    known = df.where(" and ".join(f"`{c}` is not null" for c in key))
    first = firsts(df, key, order).withColumn("__first", F.lit(True))
    again = F.row_number().over(Window.partitionBy(*key, *order).orderBy(*order))
    marked = known.withColumn("__again", again).join(first, [*key, *order], "left")
    return marked.where(F.col("__first").isNull() | (F.col("__again") > 1)).drop("__first", "__again")


def orphans(child: DataFrame, parent: DataFrame, columns: list[str], ref: list[str]) -> DataFrame:
    """Rows whose foreign key finds no parent; any null exempts a row (MATCH SIMPLE)."""
    known = child.where(" and ".join(f"`{c}` is not null" for c in columns))
    keys = parent.select(*[F.col(r).alias(c) for r, c in zip(ref, columns)]).distinct()
    return known.join(keys, columns, "left_anti")


def match_full(columns: list[str]) -> Column:
    """Some columns of a MATCH FULL key are null, others are not."""
    nulls = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return issue((nulls > 0) & (nulls < len(columns)), columns, "match full")


def partly_null(child: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that break MATCH FULL: some columns of the key are null, others are not."""
    nulls = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return child.where((nulls > 0) & (nulls < len(columns)))


def checkpointed(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return df.checkpoint(eager=True)


def closure(tables: dict[str, DataFrame], keys: list[tuple[str, list[str], str, list[str]]]) -> dict[str, DataFrame]:
    """Tables without rows whose foreign keys (child, columns, parent, referenced) find no parent, to a
    fixed point: dropping a parent drops its children in turn. A round looks only at keys whose parent lost rows
    in the round before, and writes only tables that lose rows."""
    out, changed = dict(tables), {parent for _, _, parent, _ in keys}
    while changed:
        before, changed = changed, set()
        for child, columns, parent, ref in keys:
            if parent not in before | changed:
                continue
            lost = checkpointed(orphans(out[child], out[parent], columns, ref).select(*columns).distinct())
            if not lost.isEmpty():
                out[child] = checkpointed(out[child].join(lost, columns, "left_anti"))
                changed.add(child)
    return out


def distinct_values(rows: DataFrame, draw, column: str, order: str, rounds: int = 50, within: list[str] | None = None) -> DataFrame:
    """rows with a column of distinct values: draw(round) proposes one for each row; the first row of a
    value keeps it, others draw again. Fails when rows are left after the last round.

    Given columns `within`, values are distinct among rows equal in these (a null is equal to nothing), and
    rows that are left keep a repeated value, as a group may have more rows than there are values; half the
    rounds in a row without a new value end the search."""
    key = [*(within or []), column]
    left, taken, idle = rows, None, 0
    missing = rows.count()
    total = missing
    for k in range(rounds):
        proposed = left.withColumn(column, draw(k))
        fresh = proposed if taken is None else proposed.join(taken.select(key), key, "left_anti")
        won = fresh.join(firsts(fresh, key, [order]), [*key, order], "left_semi").select(*rows.columns, column)
        if within:
            won = won.unionByName(proposed.where(" or ".join(f"`{c}` is null" for c in key)))
        won = checkpointed(won)  # each round writes what it won and what is left, not what was taken before
        taken = won if taken is None else taken.unionByName(won)
        left = checkpointed(left.join(won.select(order), order, "left_anti"))
        before, missing = missing, left.count()
        if not missing:
            return taken
        idle = 0 if missing < before else idle + 1
        if within and 2 * idle >= rounds:
            break
    if within:
        return taken.unionByName(left.withColumn(column, draw(rounds)))
    raise ValueError(f"{column}: no distinct values for all {total} rows after {rounds} rounds")
