"""Keys of one table that share columns, such as a tenant's: a row's keys must come from one group.

The group of a row is chosen for all of its keys at once. Keys without limits let a row draw its group with the
weight of the first key's parents, among the groups that all keys have. Keys with limits (a quota, one-to-one) give each
group an interval of rows, and the rows are apportioned: the level at which the clamped intervals sum up to the
rows is found by sums over the groups, what remains goes to the first groups by a draw. Rows are numbered, a
permutation of their numbers falls into the groups' running sums, and a row's rank in its group gives its
parents by arithmetic. So the driver holds some sums, never groups or rows, and all that can't be
satisfied is named before any row exists."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.draws import Cell, permuted, pick
from tessera.operators.assign import InfeasibleError, member, positions
from tessera.operators.ranks import cumulative, numbered, range_lookup
from tessera.operators.validate import checkpointed, firsts

TRIES = 32  # levels that one pass over the groups sums up


@dataclass
class Side:
    """A key's parents: their group columns, `pidx` (their order), and what a child takes over."""

    members: DataFrame
    label: str
    strategy: str = "uniform"
    s: float = 1.2
    low: int = 0
    high: int | None = None
    null_ratio: float = 0.0
    nullable: bool = False  # where its group has no member, or by its coin, a row has none

    @property
    def limited(self) -> bool:
        return self.strategy in ("quota", "unique_subset")

    def bounds(self, n: Column, rows: int) -> tuple[Column, Column]:
        """How many rows n parents can take."""
        if self.strategy == "unique_subset":
            return F.lit(0).cast("bigint"), n
        return n * self.low, F.least(n * self.high if self.high is not None else n * 0 + rows, F.lit(rows))


def components(keys: list[list[str]]) -> list[tuple[list[int], list[str]]]:
    """Keys (lists of columns) that are connected by shared columns, each with the columns that all of its keys have."""
    root = list(range(len(keys)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(keys):
        for j in range(i):
            if set(a) & set(keys[j]):
                root[find(i)] = find(j)
    found: dict[int, list[int]] = {}
    for i in range(len(keys)):
        found.setdefault(find(i), []).append(i)
    return [(members, [c for c in keys[members[0]] if all(c in keys[i] for i in members)]) for members in found.values()]


def group_table(sides: list[Side], group: list[str], seed: int, table: str) -> DataFrame:
    """(group, n0, n1, .., gid): each group with its number of parents of each side, in the order of a draw."""
    known = " and ".join(f"`{c}` is not null" for c in group)
    parts = [side.members.where(known).select(*group, F.lit(i).alias("__side")) for i, side in enumerate(sides)]
    sizes = [F.sum((F.col("__side") == i).cast("bigint")).alias(f"n{i}") for i in range(len(sides))]
    groups = reduce(DataFrame.unionByName, parts).groupBy(*group).agg(*sizes)
    order = Cell(seed, table, "group", group_key(group)).u("rank")
    return checkpointed(numbered(groups.withColumn("__u", order), [F.col("__u"), *map(F.col, group)], "gid").drop("__u"))


def group_key(group: list[str]) -> Column:
    return F.concat_ws(",", *[F.col(c).cast("string") for c in group])


def level(groups: DataFrame, low: Column, high: Column, total: int) -> tuple[int, int] | None:
    """(level, rest): clamped to [low, high], level - 1 sums up to total - rest, and level to total or more. None if
    the total is out of reach."""
    wide = "decimal(38,0)"
    least, most, at, to = groups.agg(F.sum(low.cast(wide)), F.sum(high.cast(wide)), F.min(low), F.max(high)).first()
    if least is None or not least <= total <= most:
        return (0, 0) if least is None and total == 0 else None
    if total == least:
        return at + 1, 0
    below = int(least)
    while to - at > 1:  # at sums up to less than total, to doesn't
        step = max(1, -(-(to - at) // TRIES))
        levels = list(range(at + step, to, step))
        sums = groups.agg(*[F.sum(F.greatest(low, F.least(high, F.lit(x))).cast(wide)) for x in levels]).first()
        over = next((i for i, x in enumerate(sums) if x >= total), len(levels))
        if over:
            at, below = levels[over - 1], int(sums[over - 1])
        to = levels[over] if over < len(levels) else to
    return to, total - below


def apportioned(groups: DataFrame, low: Column, high: Column, total: int, draw: Column, name: str, error: str) -> DataFrame:
    """groups (gid, ..) with a number of rows each, within [low, high], that sum up to total: as even as the intervals
    allow, one more for the first groups by a draw."""
    found = level(groups, low, high, total)
    if found is None:
        raise InfeasibleError(error)
    top, rest = found
    base = F.greatest(low, F.least(high, F.lit(top - 1)))
    if not rest:
        return groups.withColumn(name, base)
    open_ = groups.where((low <= top - 1) & (high >= top)).select("gid", draw.alias("__u"))
    more = numbered(open_, [F.col("__u"), F.col("gid")], "__r").where(F.col("__r") < rest).select("gid", F.lit(1).alias("__more"))
    return groups.withColumn(name, base).join(more, "gid", "left").withColumn(name, F.col(name) + F.coalesce("__more", F.lit(0))).drop("__more")


def spread(rows: DataFrame, at: str, groups: DataFrame, weight: str, keep: list[str], total: int) -> DataFrame:
    """rows with the group that holds the number `at` of [0, total) in the weights' running sums, and __p, the
    number's place in the group."""
    known = groups.where(F.col(weight) > 0).select("gid", weight, *[c for c in keep if c != weight])
    ranges = cumulative(known, weight, "gid").withColumn("__first", F.col("low"))
    found = range_lookup(rows.withColumn("__at", F.col(at)), "__at", ranges, total)
    return found.withColumn("__p", F.col("__at") - F.col("__first")).drop("__at", "__first", *([weight] if weight not in keep else []))


class _Joint:
    def __init__(self, rows: DataFrame, n: int, sides: list[Side], group: list[str], seed: int, table: str):
        self.rows, self.n, self.sides, self.group, self.seed, self.table = rows, n, sides, group, seed, table
        self.groups = group_table(sides, group, seed, table)
        self.sizes = [f"n{i}" for i in range(len(sides))]
        self.coins = [i for i, s in enumerate(sides) if s.null_ratio > 0]
        self.needed = [i for i, s in enumerate(sides) if i not in self.coins and (s.limited or not s.nullable)]
        self.allowed = reduce(lambda a, i: a & (F.col(f"n{i}") > 0), self.needed, F.lit(True))

    def fail(self, why: str) -> InfeasibleError:
        names = "; ".join(f"({s.label}) {s.strategy}" for s in self.sides)
        return InfeasibleError(f"{self.table}: {self.n} rows with keys that share {', '.join(self.group)} [{names}]: {why}")

    def coin(self, i: int) -> Column:
        return Cell(self.seed, self.table, self.sides[i].label, F.col("idx")).u("null") >= self.sides[i].null_ratio

    def constraints(self) -> list[tuple[list[int], Column, Column]]:
        """(sides, low, high): the limited keys that every row has count as one; each that a coin may leave null
        is one of its own."""
        always = [i for i in self.needed if self.sides[i].limited]
        out = []
        if always:
            bounds = [self.sides[i].bounds(F.col(f"n{i}"), self.n) for i in always]
            lows, highs = [b[0] for b in bounds], [b[1] for b in bounds]
            out.append((always, F.greatest(*lows) if len(lows) > 1 else lows[0], F.least(*highs) if len(highs) > 1 else highs[0]))
        for i in self.coins:
            if self.sides[i].limited:
                out.append(([i], *self.sides[i].bounds(F.col(f"n{i}"), self.n)))
        return out

    def check(self, constraints) -> None:
        """No group may have to get rows that it can't get."""
        for members, low, high in constraints:
            lost = self.groups.where(((low > 0) & ~self.allowed) | (self.allowed & (low > high))).orderBy("gid").first()
            if lost:
                where = ", ".join(f"{c} = {lost[c]}" for c in self.group)
                raise self.fail(f"the least number of rows of ({'), ('.join(self.sides[i].label for i in members)}) can't be reached where {where}")

    def numbered(self, rows: DataFrame, tag: str, n: int, dense: bool) -> DataFrame:
        """rows with __n, a permutation of the rows' numbers."""
        rows = rows.withColumn("__k", F.col("idx")) if dense else numbered(rows, [F.col("idx")], "__k")
        number = permuted(Cell(self.seed, self.table, tag, F.col("idx")), F.col("__k"), n, "label")
        return rows.withColumn("__n", F.coalesce(number, F.lit(0))).drop("__k")  # never null, so joins needn't look

    def free(self, rows: DataFrame) -> DataFrame:
        """Rows without a limited key: each draws its group by the parents of its first key."""
        cell = Cell(self.seed, self.table, "group", F.col("idx"))
        if self.needed or not self.coins:
            first = self.needed[0] if self.needed else 0
            every = self.allowed if self.needed else reduce(lambda a, c: a & (F.col(c) > 0), self.sizes, F.lit(True))
            return self.drawn(rows, self.groups.where(every), F.col(f"n{first}"), cell)
        parts = []
        rows = rows.withColumn("__on", F.concat(*[F.when(self.coin(i) if i in self.coins else F.lit(True), "1").otherwise("0") for i in range(len(self.sides))]))
        for kind in sorted(r["__on"] for r in rows.select("__on").distinct().collect()):  # 2 to the number of nullable keys at most
            on = [i for i, x in enumerate(kind) if x == "1"] or list(range(len(self.sides)))
            some = self.groups.where(reduce(lambda a, i: a & (F.col(f"n{i}") > 0), on, F.lit(True)))
            if some.isEmpty():
                some = self.groups.where(F.col(f"n{on[0]}") > 0)
            parts.append(self.drawn(rows.where(F.col("__on") == kind), some, F.col(f"n{on[0]}"), cell))
        return reduce(DataFrame.unionByName, parts).drop("__on")

    def drawn(self, rows: DataFrame, groups: DataFrame, weight: Column, cell: Cell) -> DataFrame:
        groups = groups.withColumn("__w", weight)
        total = groups.agg(F.sum("__w")).first()[0]
        if not total:
            if rows.isEmpty():
                total = 1
            else:
                raise self.fail("no group has parents of all of these keys")
        points = rows.withColumn("__n", pick(cell.u("group"), total))
        out = spread(points, "__n", groups, "__w", [*self.group, *self.sizes], total).drop("__n", "__w")
        zero = F.lit(0).cast("bigint")
        return out.withColumns({f"__rank{i}": zero for i in range(len(self.sides))} | {f"__all{i}": zero for i in range(len(self.sides))})

    def labelled(self, rows: DataFrame, counted: DataFrame, weight: str, total: int, ranks: dict[int, tuple[Column, Column]]) -> DataFrame:
        """rows (with __n) in the groups that `weight` gives them; ranks: by side, what comes before a row's place in
        its group, and the number of the side's rows there."""
        columns = {f"__before{i}": before for i, (before, _) in ranks.items()} | {f"__all{i}": total_ for i, (_, total_) in ranks.items()}
        counted = counted.withColumns(columns)
        keep = [*self.group, *self.sizes, *columns]
        out = spread(rows, "__n", counted, weight, keep, max(1, total)).drop("__n")
        zero = F.lit(0).cast("bigint")
        out = out.withColumns({f"__rank{i}": F.col(f"__before{i}") + F.col("__p") if i in ranks else zero for i in range(len(self.sides))})
        out = out.withColumns({f"__all{i}": zero for i in range(len(self.sides)) if i not in ranks})
        return out.drop(*[f"__before{i}" for i in ranks])

    def draw(self, tag: str) -> Column:
        return Cell(self.seed, self.table, f"group/{tag}", F.col("gid")).u("rank")

    def grouped(self) -> DataFrame:
        """rows with group, sizes, and for each limited side the row's rank among the rows of its group, and their number."""
        constraints = self.constraints()
        self.check(constraints)
        if not constraints:
            return self.free(self.rows)
        if len(constraints) > 2:
            raise self.fail("of keys with limits at most two may be null in different rows")
        allowed, out = self.groups.where(self.allowed), []
        on = [self.coin(members[0]) if members[0] in self.coins else F.lit(True) for members, _, _ in constraints]
        marked = self.rows.withColumn("__mask", reduce(lambda a, k: a + on[k].cast("int") * 2**k, range(len(on)), F.lit(0)))
        counts = {r["__mask"]: r["count"] for r in marked.groupBy("__mask").count().collect()}  # four at most
        part = lambda mask: self.numbered(marked.where(F.col("__mask") == mask).drop("__mask"), f"mask{mask}", counts.get(mask, 0), counts.get(mask) == self.n)
        zero = F.lit(0).cast("bigint")
        (first, low_a, high_a), *second = constraints
        if not second:
            counted = apportioned(allowed, low_a, high_a, counts.get(1, 0), self.draw("a"), "__x", self.fail("the groups can't take this number").args[0])
            out.append(self.labelled(part(1), checkpointed(counted), "__x", counts.get(1, 0), {i: (zero, F.col("__x")) for i in first}))
        else:
            (second_, low_b, high_b), = second
            both, a, b = counts.get(3, 0), counts.get(1, 0), counts.get(2, 0)
            counted = checkpointed(self.two(allowed, (low_a, high_a), (low_b, high_b), both, a, b))
            w = F.col("__w")
            all_a, all_b = w + F.col("__a"), w + F.col("__b")
            side_a = lambda before: {i: (before, all_a) for i in first}
            side_b = lambda before: {i: (before, all_b) for i in second_}
            out.append(self.labelled(part(3), counted, "__w", both, side_a(zero) | side_b(zero)))
            out.append(self.labelled(part(1), counted, "__a", a, side_a(w)))
            out.append(self.labelled(part(2), counted, "__b", b, side_b(w)))
        if counts.get(0):
            out.append(self.free(marked.where(F.col("__mask") == 0).drop("__mask")).drop("__p"))
        names = out[0].drop("__p").columns
        return reduce(DataFrame.unionByName, [x.select(*names) for x in out])

    def two(self, groups: DataFrame, a: tuple[Column, Column], b: tuple[Column, Column], both: int, only_a: int, only_b: int) -> DataFrame:
        """groups with __w, __a, __b: the rows that have both keys, the first, the second only, so that each group's
        __w + __a is within the first key's interval and __w + __b within the second's.

        A group's rows with both keys fill up to the lower of the two least numbers first, as these help both keys, then up
        to the higher one, which helps one key, and then up to the lower of the greatest numbers. What the least numbers
        still lack after the rows with one key decides how many go to the steps; any other division would
        help less, so failing here means that no assignment exists."""
        (low_a, high_a), (low_b, high_b) = a, b
        cap = F.least(high_a, high_b)
        one = F.least(low_a, low_b, cap)
        two = F.least(F.greatest(low_a, low_b), cap) - one
        steps = {"__one": one, "__two_a": F.when(low_a > low_b, two).otherwise(0), "__two_b": F.when(low_a > low_b, 0).otherwise(two), "__three": cap - one - two}
        steps = {k: v.cast("bigint") for k, v in steps.items()} | {"__la": low_a, "__ha": high_a, "__lb": low_b, "__hb": high_b}
        groups = groups.withColumns(steps)
        room, room_a, room_b, rest, sum_la, sum_lb, sum_ha, sum_hb = (int(x or 0) for x in groups.agg(*[F.sum(c) for c in ("__one", "__two_a", "__two_b", "__three", "__la", "__lb", "__ha", "__hb")]).first())
        y1 = min(both, room)
        left = both - y1
        need_a, need_b = max(0, sum_la - y1 - only_a), max(0, sum_lb - y1 - only_b)
        if need_a > room_a or need_b > room_b or need_a + need_b > left or left > room_a + room_b + rest or only_a > sum_ha - both or only_b > sum_hb - both:
            raise self.fail(f"{both} rows have both, {only_a} only the first and {only_b} only the second of the limited keys, and the groups can't take them")
        left -= need_a + need_b
        more_a = min(left, room_a - need_a)
        more_b = min(left - more_a, room_b - need_b)
        zero = F.lit(0).cast("bigint")
        for name, total, most in (("__one", y1, room), ("__two_a", need_a + more_a, room_a), ("__two_b", need_b + more_b, room_b), ("__three", left - more_a - more_b, rest)):
            if total in (0, most):
                groups = groups.withColumn(f"{name}_", F.col(name) if total else zero)
            else:
                groups = apportioned(groups, zero, F.col(name), total, self.draw(name), f"{name}_", "")
        groups = checkpointed(groups.withColumn("__w", F.col("__one_") + F.col("__two_a_") + F.col("__two_b_") + F.col("__three_")))
        w, none = F.col("__w"), self.fail("the groups can't take the rows with one of the limited keys").args[0]
        groups = apportioned(groups, F.greatest(zero, F.col("__la") - w), F.col("__ha") - w, only_a, self.draw("only_a"), "__a", none)
        return apportioned(groups, F.greatest(zero, F.col("__lb") - w), F.col("__hb") - w, only_b, self.draw("only_b"), "__b", none)

    def run(self) -> DataFrame:
        rows = self.grouped().drop("__p")
        key = group_key(self.group)
        places = {}  # all of them before any join: a join may leave the rows to a few tasks
        for i, side in enumerate(self.sides):
            cell, size, rank = Cell(self.seed, self.table, side.label, F.col("idx")), F.col(f"n{i}"), F.col(f"__rank{i}")
            if side.strategy == "quota":
                rank = permuted(cell, rank, F.col(f"__all{i}"), "child", key)
            place = member(cell, side.strategy, rank, size, side.s, side.low, side.high, key)
            there = (size > 0) & self.coin(i) if i in self.coins else size > 0
            places[f"__place{i}"] = F.when(there, place)
        rows = rows.withColumns(places)
        for i, side in enumerate(self.sides):
            rows = taken(rows, side.members, self.group, F.col(f"__place{i}"))
        return rows.drop(*places, "gid", *self.sizes, *[f"__{x}{i}" for x in ("rank", "all") for i in range(len(self.sides))])


def taken(rows: DataFrame, members: DataFrame, group: list[str], place: Column) -> DataFrame:
    """rows with what the member at a place of their group has, by order of pidx; none where the place is null (these
    rows look for places that nobody has, so that they don't meet in one task). Both sides are shuffled: members are as
    many as parents, and a broadcast would hold them in the driver."""
    placed = positions(members, group, ["pidx"], "__pos").drop("n", "pidx")
    asked = rows.withColumn("__pos", F.coalesce(place, -1 - F.col("idx")))
    return asked.join(placed.hint("merge"), [*group, "__pos"], "left").drop("__pos")


def assigned(rows: DataFrame, n: int, sides: list[Side], group: list[str], seed: int, table: str) -> DataFrame:
    """rows (idx from 0 to n - 1) with the columns of a group and what each side's members hand over. Limits hold over
    all rows; a key that a coin makes null, or that may be null and has no member in the row's group, is null."""
    return _Joint(rows, n, sides, group, seed, table).run()


def completed(rows: DataFrame, side: Side, group: list[str], seed: int, table: str) -> DataFrame:
    """rows whose group is given already, with a member of it each: the strategy holds within the group. A group that
    can't take its rows is an error before any row exists."""
    cell, size = Cell(seed, table, side.label, F.col("idx")), F.col("__n")
    sizes = side.members.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    there = F.lit(True) if not side.null_ratio else cell.u("null") >= side.null_ratio
    rank = F.lit(0).cast("bigint")
    if side.limited:
        ranked = positions(rows.where(there).select("idx", *group), group, ["idx"], "__rank", "__all")
        total = ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("__c"))
        low, high = side.bounds(F.coalesce(size, F.lit(0).cast("bigint")), 2**62)
        met = F.coalesce("__c", F.lit(0).cast("bigint"))
        over = sizes.join(total, group, "full").where((met < low) | (met > high)).where(" and ".join(f"`{c}` is not null" for c in group)).first()
        if over:
            where = ", ".join(f"{c} = {over[c]}" for c in group)
            raise InfeasibleError(f"{table}.{side.label}: {over['__c'] or 0} rows and {over['__n'] or 0} parents where {where} don't fit {side.strategy}")
        rows = rows.join(ranked.select("idx", "__rank", "__all"), "idx", "left")
        rank = F.col("__rank")
        if side.strategy == "quota":
            rank = permuted(cell, rank, F.col("__all"), "child", group_key(group))
    rows = rows.join(sizes, group, "left")
    place = member(cell, side.strategy, rank, size, side.s, side.low, side.high, group_key(group))
    return taken(rows, side.members, group, F.when((size > 0) & there, place)).drop("__n", "__rank", "__all")


# several keys of tuples


ROWS, COLUMNS, DIAGONALS = 0, 1, 2  # what a side counts by in a grid of rows and columns


def grids(sides: int, keys: list[list[int]]) -> list[list[int]]:
    """Ways to let each side count by rows, columns or diagonals, such that every key has two sides that count
    differently: a cell is then told by either key, if the grid isn't larger than these sides."""
    return [list(way) for way in product((ROWS, COLUMNS, DIAGONALS), repeat=sides) if all(len({way[i] for i in key}) > 1 for key in keys)]


def extent(way: list[int], keys: list[list[int]], sizes: list[Column]) -> tuple[Column, Column]:
    """The most rows and columns of a grid whose cells are told by every key."""
    rows, columns = [], []
    for key in keys:
        i, j = next((i, j) for i in key for j in key if way[i] < way[j])
        by_row, by_column = (j, i) if way[i] == COLUMNS else (i, j)  # of a column and a diagonal, the diagonal bounds the rows
        rows.append(sizes[by_row])
        columns.append(sizes[by_column])
    least = lambda x: F.least(*x) if len(x) > 1 else x[0]
    return least(rows), least(columns)


def distinct_in_keys(rows: DataFrame, n: int, sides: list[Side], group: list[str], keys: list[list[int]], seed: int, table: str) -> DataFrame:
    """rows with a group and a member of each side, so that within a group no two rows agree in all sides of a key
    (keys: numbers of sides).

    Rows take cells of a grid without replacement, and each side counts by the cell's row, its column or, as in a Latin
    square, its diagonal. Where no such grid has enough cells, rounds of draws keep what breaks no key; a
    number that exceeds some key's tuples is an error before any row exists, one that no round reaches an error too."""
    groups = group_table(sides, group, seed, table)
    sizes = [F.col(f"n{i}") for i in range(len(sides))]
    wide = lambda c: c.cast("decimal(19,0)").cast("decimal(38,0)")
    ways = grids(len(sides), keys)
    extents = [extent(way, keys, sizes) for way in ways]
    tuples = [reduce(lambda a, c: a * c, [sizes[i].cast("double") for i in key]) for key in keys]
    sums = groups.agg(*[F.sum(x) for x in tuples], *[F.sum((wide(a) * wide(b)).cast("decimal(38,0)")) for a, b in extents]).first()
    for key, most in zip(keys, sums):
        if n > (most or 0):
            raise InfeasibleError(f"{table}: {n} rows need distinct tuples of ({'), ('.join(sides[i].label for i in key)}), there are {int(most or 0)}")
    cells = [int(x or 0) for x in sums[len(keys) :]]
    best = max(range(len(ways)), key=lambda k: cells[k], default=None)
    if best is not None and n <= cells[best] < 2**62:
        high, wide_ = extents[best]
        counted = groups.withColumns({"__high": high, "__wide": wide_}).withColumn("__cells", F.col("__high") * F.col("__wide"))
        placed = rows.withColumn("__n", permuted(Cell(seed, table, "rank", F.col("idx")), F.col("idx"), cells[best], "rank"))
        placed = spread(placed, "__n", checkpointed(counted), "__cells", [*group, "__wide", *[f"n{i}" for i in range(len(sides))]], cells[best])
        row, column = F.call_function("div", F.col("__p"), F.col("__wide")), F.col("__p") % F.col("__wide")
        at = {ROWS: row, COLUMNS: column, DIAGONALS: row + column}
        places = {f"__p{i}": permuted(Cell(seed, table, side.label, F.col("idx")), at[ways[best][i]] % sizes[i], sizes[i], "parent", group_key(group)) for i, side in enumerate(sides)}
        placed = placed.withColumns(places).drop("__n", "__p", "__wide")
    else:
        placed = in_rounds(rows, n, sides, group, keys, groups, seed, table)
    for i, side in enumerate(sides):
        placed = taken(placed, side.members, group, F.col(f"__p{i}")).drop(f"__p{i}")
    return placed.drop("gid", *[f"n{i}" for i in range(len(sides))])


def in_rounds(rows: DataFrame, n: int, sides: list[Side], group: list[str], keys: list[list[int]], groups: DataFrame, seed: int, table: str, rounds: int = 60) -> DataFrame:
    """Each round every row that is left draws a group and members; those that break no key are kept."""
    weight = reduce(F.least, [reduce(lambda a, c: a * c, [F.col(f"n{i}").cast("double") for i in key]) for key in keys]) if len(keys) > 1 else F.col("n0")
    counted = checkpointed(groups.withColumn("__cells", F.least(weight, F.lit(2.0**40)).cast("bigint")))
    total, left, kept = counted.agg(F.sum("__cells")).first()[0], rows, None
    for k in range(rounds):
        cell = Cell(seed, table, f"round{k}", F.col("idx"))
        drawn = spread(left.withColumn("__n", pick(cell.u("group"), total)), "__n", counted, "__cells", [*group, *[f"n{i}" for i in range(len(sides))]], total).drop("__n", "__p")
        fresh = drawn.withColumns({f"__p{i}": pick(cell.u(f"side{i}"), F.col(f"n{i}")) for i in range(len(sides))})
        for key in keys:
            names = [*group, *[f"__p{i}" for i in key]]
            if kept is not None:
                fresh = fresh.join(kept.select(*names), names, "left_anti")
            fresh = fresh.join(firsts(fresh, names, ["idx"]), [*names, "idx"], "left_semi")
        won = checkpointed(fresh)
        kept = won if kept is None else kept.unionByName(won)
        left = checkpointed(left.join(won.select("idx"), "idx", "left_anti"))
        if left.isEmpty():
            return kept
    raise InfeasibleError(f"{table}: no {n} rows found whose tuples are distinct in all of {len(keys)} keys")
