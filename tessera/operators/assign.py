"""Assignment of parents to child rows.

Parents carry a dense 0-based number `pidx`; a child gets `pidx` by arithmetic or an equi-join. All
strategies are functions of (seed, table, row), and all capacity checks run before any row exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.draws import Cell, permuted, pick
from tessera.functions.generators import zipf_rank
from tessera.operators.ranks import cumulative, numbered, range_lookup, ranges_of


class InfeasibleError(ValueError):
    """More rows are asked for than the parents can hold."""


def _cell(seed: int, table: str, column: str) -> Cell:
    return Cell(seed, table, column, F.col("idx"))


def uniform(children: DataFrame, parents: int, seed: int, table: str, fk: str) -> DataFrame:
    """Any parent, with replacement."""
    return children.withColumn("pidx", pick(_cell(seed, table, fk).u("fk"), parents))


def with_nulls(children: DataFrame, ratio: float, seed: int, table: str, fk: str) -> DataFrame:
    """A coin for each row: pidx null with the given probability."""
    return children.withColumn("pidx", F.when(_cell(seed, table, fk).u("null") >= ratio, F.col("pidx")))


def zipf(children: DataFrame, parents: int, seed: int, table: str, fk: str, s: float = 1.2) -> DataFrame:
    """Parents by place with falling popularity, by rejection-inversion: no weight of a parent is ever a row."""
    return children.withColumn("pidx", zipf_rank(_cell(seed, table, fk), "fk", parents, s) - 1)


def shuffled(n: DataFrame, seed: int, table: str, tag: str, idx: str, name: str) -> DataFrame:
    """n with a permutation of its rows: their rank by a hash of idx."""
    cell = Cell(seed, table, tag, F.col(idx))
    return numbered(n.withColumn("__u", cell.u("rank")), [F.col("__u"), F.col(idx)], name).drop("__u")


def unique_subset(children: DataFrame, parents: int, seed: int, table: str, fk: str) -> DataFrame:
    """One-to-one, without replacement; children are numbered 0.. in `idx`."""
    rows = children.count()
    if rows > parents:
        raise InfeasibleError(f"{table}.{fk}: {rows} rows need {rows} parents, there are {parents}")
    return children.withColumn("pidx", permuted(_cell(seed, table, fk), F.col("idx"), parents, "parent"))


def member(cell: Cell, strategy: str, rank: Column, n: Column | int, s: float = 1.2, low: int = 0, high: int | None = None, key: Column | None = None) -> Column:
    """The parent's number in [0, n) of the child that is the rank-th of those that share these parents (all rows,
    or a group's: then key tells groups apart).

    One-to-one: the rank under a permutation. Quota: the first low * n children give each parent its least
    number; what follows takes slots of [0, (high - low) * n) without replacement, `high - low` for each parent."""
    if strategy == "unique_subset":
        return permuted(cell, rank, n, "parent", key)
    if strategy == "zipf":
        return zipf_rank(cell, "fk", n, s) - 1
    if strategy == "quota":
        size = F.lit(n).cast("bigint") if isinstance(n, int) else n
        sure, further = size * low, rank - size * low
        if high is None:
            more = pick(cell.u("extra"), size)
        else:
            more = permuted(cell, F.greatest(further, F.lit(0)), n * max(0, high - low), "free", key) % size
        return F.when(rank < sure, rank % size).otherwise(more)
    return pick(cell.u("fk"), n)


def quota(children: DataFrame, parents: int, low: int, high: int | None, seed: int, table: str, fk: str) -> DataFrame:
    """Every parent gets low to high children; children are numbered 0.. in `idx` and meet their slots in the order
    of a permutation."""
    rows = children.count()
    if not parents * low <= rows or high is not None and rows > parents * high:
        raise InfeasibleError(f"{table}.{fk}: {rows} rows don't fit {parents} parents with {low} to {high} each")
    cell = _cell(seed, table, fk)
    turned = children.withColumn("__rank", permuted(cell, F.col("idx"), rows, "child"))
    return turned.withColumn("pidx", member(cell, "quota", F.col("__rank"), parents, low=low, high=high)).drop("__rank")


LARGEST = 2**62


def distinct_ranks(children: DataFrame, total: int, seed: int, table: str, name: str = "rank") -> DataFrame:
    """Distinct numbers in [0, total) for children 0..: a sample without replacement, which needs no state and
    no shuffle."""
    return children.withColumn(name, permuted(Cell(seed, table, "rank", F.col("idx")), F.col("idx"), total, "rank"))


def tuples(children: DataFrame, sizes: list[int], names: list[str], seed: int, table: str) -> DataFrame:
    """Distinct tuples of parent numbers by unranking in mixed radix; no product is ever built. Where the number
    of tuples exceeds a long, the sizes are cut into parts that don't, the child's number is written in these parts,
    and rounds add to each part in turn an offset drawn from the others: each round is one-to-one."""
    total = 1
    for n in sizes:
        total *= n
    rows = children.count()
    if rows > total:
        raise InfeasibleError(f"{table}: {rows} rows need distinct tuples, there are {total}")
    parts: list[list[tuple[int, str]]] = [[]]
    product = 1
    for n, name in reversed(list(zip(sizes, names))):
        if product * n >= (LARGEST if total < LARGEST else 2**52):
            parts.append([])
            product = 1
        parts[-1].append((n, name))
        product *= n
    if len(parts) == 1:
        out = distinct_ranks(children, total, seed, table, "__0")
    else:
        out, rest = children, F.col("idx").cast("bigint")
        widths = []
        for i, part in enumerate(parts):
            width = 1
            for n, _ in part:
                width *= n
            widths.append(width)
            out = out.withColumn(f"__{i}", rest % width)
            rest = F.call_function("div", rest, F.lit(width))
        for step in range(2 * len(parts) + 2):
            i = step % len(parts)
            others = Cell(seed, table, "rank", F.concat_ws("/", *[F.col(f"__{k}").cast("string") for k in range(len(parts)) if k != i]))
            out = out.withColumn(f"__{i}", (F.col(f"__{i}") + pick(others.u(f"part{step}"), widths[i])) % widths[i])
    for i, part in enumerate(parts):
        for n, name in part:
            out = out.withColumn(name, F.col(f"__{i}") % n).withColumn(f"__{i}", F.expr(f"__{i} div {n}"))
    return out.drop(*[f"__{i}" for i in range(len(parts))])


def group_tuples(sides: list[DataFrame], group: list[str], names: list[str], rows: int, seed: int, table: str) -> DataFrame:
    """(idx, *group, *names): distinct tuples of positions within groups that all sides share. Sides are
    (group, n) counts; flat ranks over the groups' products are drawn and unranked by a range join, groups in
    order of a draw. Where the tuples are too many for a long, those of the first sides are distinct already, and
    the positions of the others are drawn freely."""
    both = sides[0].withColumnRenamed("n", "__n0")
    for i, side in enumerate(sides[1:], 1):
        both = both.join(side.withColumnRenamed("n", f"__n{i}"), group)
    weight, weights = F.lit(1.0), []
    for i in range(len(sides)):
        weight = weight * F.col(f"__n{i}")
        weights.append(F.sum(weight))
    totals = [x or 0.0 for x in both.agg(*weights).first()]
    held = max((i for i, x in enumerate(totals) if x < LARGEST), default=0)
    weight = F.lit(1).cast("decimal(38,0)")
    for i in range(held + 1):
        weight = (weight * F.col(f"__n{i}").cast("decimal(19,0)")).cast("decimal(38,0)")
    both = both.withColumn("__w", weight.cast("bigint"))
    total = int(both.agg(F.sum("__w")).first()[0] or 0)
    if rows > total:
        raise InfeasibleError(f"{table}: {rows} rows need distinct tuples, there are {int(totals[-1])}" + (f", and {total} of the first {held + 1} keys" if held + 1 < len(sides) else ""))
    order = Cell(seed, table, "group", F.concat_ws(",", *[F.col(c).cast("string") for c in group])).u("rank")
    both = both.withColumn("__h", order)
    ranges = cumulative(numbered(both, [F.col("__h"), *map(F.col, group)], "__g").drop("__h"), "__w", "__g").drop("__w", "__g")
    points = distinct_ranks(both.sparkSession.range(rows).withColumnRenamed("id", "idx"), total, seed, table, "__at")
    found = range_lookup(points.withColumn("__flat", F.col("__at")), "__at", ranges.withColumn("__first", F.col("low")), total)
    found = found.withColumn("__flat", F.col("__flat") - F.col("__first"))
    for i, name in reversed(list(enumerate(names))):
        if i > held:
            found = found.withColumn(name, pick(Cell(seed, table, name, F.col("idx")).u("free"), F.col(f"__n{i}")))
            continue
        found = found.withColumn(name, F.col("__flat") % F.col(f"__n{i}")).withColumn("__flat", F.expr(f"__flat div __n{i}"))
    return found.select("idx", *group, *names)


def group_pairs(left: DataFrame, right: DataFrame, group: list[str], rows: int, seed: int, table: str) -> DataFrame:
    """(idx, *group, lpos, rpos): distinct pairs within groups that both sides share."""
    return group_tuples([left, right], group, ["lpos", "rpos"], rows, seed, table)


def even_pairs(rows: DataFrame, c: int, left: int, right: int) -> DataFrame:
    """(idx, lpos, rpos) for edges 0..c-1: distinct pairs with degrees within one of each other on both sides. Left
    owners come in blocks of c div L or one more, right ones in turn."""
    base, more = divmod(c, left)
    cut = more * (base + 1)
    owner = F.when(F.col("idx") < cut, F.expr(f"idx div {base + 1}")).otherwise(F.lit(more) + F.expr(f"(idx - {cut}) div {max(1, base)}"))
    return rows.select("idx", owner.cast("bigint").alias("lpos"), (F.col("idx") % right).alias("rpos"))


def bounded_pairs(rows: DataFrame, left: int, right: int, low: tuple[int, int], high: tuple[int, int], seed: int, table: str) -> DataFrame:
    """even_pairs with each side's degrees in [low, high]; which parents these are is a permutation by hash ranks."""
    c = rows.count()
    for n, lo, hi, side in ((left, low[0], high[0], "left"), (right, low[1], high[1], "right")):
        if not n * lo <= c <= n * hi:
            raise InfeasibleError(f"{table}: {c} pairs don't fit {n} {side} parents with {lo} to {hi} each")
    if c > left * right:
        raise InfeasibleError(f"{table}: {c} distinct pairs of {left} x {right}")
    out = even_pairs(rows, c, left, right).withColumnsRenamed({"lpos": "__l", "rpos": "__r"})
    for n, name, key in ((left, "l", "lpos"), (right, "r", "rpos")):
        turned = shuffled(rows.sparkSession.range(n).withColumnRenamed("id", key), seed, table, name, key, f"__{name}")
        out = out.join(turned, f"__{name}")
    return out.select("idx", "lpos", "rpos")


def positions(members: DataFrame, group: list[str], order: list[str], pos: str = "pos", n: str = "n") -> DataFrame:
    """members with their 0-based position in their group and the group's size. order[0] is numeric: a
    group is ranked within ranges of it, and each range starts after the group's rows in lower ones, so a
    large group is spread over tasks."""
    cut = ranges_of(members, F.col(order[0]))
    sizes = cut.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__in"))
    own = Window.partitionBy(*group).orderBy("__range")
    below = F.coalesce(F.sum("__in").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*group, "__range", below.alias("__below"), F.sum("__in").over(Window.partitionBy(*group)).alias(n))
    rank = F.row_number().over(Window.partitionBy(*group, "__range").orderBy(*order))
    ranked = cut.withColumn("__rank", rank).join(sizes, [*group, "__range"])
    return ranked.withColumn(pos, (F.col("__rank") - 1 + F.col("__below")).cast("bigint")).drop("__rank", "__below", "__range")


def within_group(children: DataFrame, members: DataFrame, group: list[str], order: list[str], seed: int, table: str, fk: str) -> DataFrame:
    """Each child with a member of its own group, uniformly; null where the group has none."""
    placed = positions(members, group, order)
    sizes = members.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    drawn = children.join(sizes, group, "left").withColumn("pos", pick(_cell(seed, table, fk).u("fk"), F.col("n")))
    return drawn.drop("n").join(placed.drop("n"), [*group, "pos"], "left").drop("pos")


def shared_groups(*sides: DataFrame) -> DataFrame:
    """The groups that all sides have: the only ones from which rows with shared key columns can come."""
    out = sides[0].distinct()
    for side in sides[1:]:
        out = out.intersect(side)
    return out


def first_of_projection(parents: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The first parent of each projection, aggregated before the shuffle."""
    rest = [c for c in parents.columns if c not in columns]
    picked = parents.groupBy(*columns).agg(F.min_by(F.struct(*rest), order).alias("__first"))
    return picked.select(*columns, *[F.col(f"__first.{c}").alias(c) for c in rest])


# hierarchies and cycles


def level_starts(rows: int, branching: int, max_depth: int | None = None) -> list[tuple[int, int]]:
    """(first idx, size) of each level: one root, then up to branching times the level above."""
    levels, at, size = [], 0, 1
    while at < rows:
        if max_depth is not None and len(levels) >= max_depth:
            raise InfeasibleError(f"{rows} rows don't fit {max_depth} levels of branching {branching}")
        size = min(size, rows - at)
        levels.append((at, size))
        at += size
        size = branching ** len(levels)
    return levels


def leveled(rows: DataFrame, count: int, branching: int, seed: int, table: str, fk: str, max_depth: int | None = None) -> DataFrame:
    """rows (idx) with level and parent_idx (null for the root): a parent of the level above, by
    arithmetic on idx alone."""
    level, parent = F.lit(0), F.lit(None).cast("bigint")
    u = _cell(seed, table, fk).u("fk")
    starts = level_starts(count, branching, max_depth)
    for number, ((above, size), (at, _)) in enumerate(zip(starts, starts[1:]), 1):
        level = F.when(F.col("idx") >= at, F.lit(number)).otherwise(level)
        parent = F.when(F.col("idx") >= at, F.lit(above) + pick(u, size)).otherwise(parent)
    return rows.withColumn("level", level).withColumn("parent_idx", parent)


def fill_cycle(rows: DataFrame, candidates: DataFrame, group: list[str], order: list[str], into: str, key: str, seed: int, table: str) -> DataFrame:
    """rows whose column `into` was left null to break a cycle, filled with the key of a candidate that
    agrees on the shared columns; a row without candidates stays null."""
    chosen = within_group(rows.drop(into), candidates.select(*group, *dict.fromkeys([*order, key])), group, order, seed, table, into)
    return chosen.withColumnRenamed(key, into) if key != into else chosen
