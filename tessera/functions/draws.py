"""Deterministic draws. A draw is a function of (seed, table, row index, tag) alone, so a value never
depends on partitioning, batch or retry. The same bits come out of SHA-256 in any SQL engine."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 2.0**52


def prefix(seed: int, table: str) -> str:
    """Length-framed, so that no two (seed, table) share a prefix."""
    return f"{seed}|{len(table)}:{table}|"


def digest(seed: int, table: str, tag: str | Column, idx: Column) -> Column:
    tag = F.lit(f"|{tag}") if isinstance(tag, str) else F.concat(F.lit("|"), tag)
    return F.sha2(F.concat(F.lit(prefix(seed, table)), idx.cast("string"), tag), 256)


def uniform(seed: int, table: str, tag: str | Column, idx: Column) -> Column:
    """A double in [0, 1) of 52 random bits."""
    return F.conv(F.substring(digest(seed, table, tag, idx), 1, 13), 16, 10).cast("bigint") / F.lit(_BITS)


def uniform_sql(seed: int, table: str, tag: str, idx: str) -> str:
    """The same draw as DuckDB SQL; idx is an SQL expression."""
    return f"(('0x' || substr({digest_sql(seed, table, tag, idx)}, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def digest_sql(seed: int, table: str, tag: str, idx: str) -> str:
    return f"sha256('{prefix(seed, table)}' || ({idx}) || '|{tag}')"


def pick(u: Column, n: Column | int) -> Column:
    """An index in [0, n) from a uniform draw."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.least(F.floor(u * n), (n - 1).cast("bigint")).cast("bigint")


def pick_sql(draw: str, n: str | int) -> str:
    return f"least(floor({draw} * {n}), ({n}) - 1)::BIGINT"


LAYERS = 3  # of a permutation
PRIME = 2**31 - 1


def _numbers(seed: int, table: str, tag: str, n: int) -> list[int]:
    """Numbers below PRIME that belong to a tag and no row."""
    return [int(hashlib.sha256(f"{prefix(seed, table)}-|{tag}/{i}".encode()).hexdigest()[:13], 16) % PRIME for i in range(n)]


def permuted(cell: Cell, x: Column, n: Column | int, kind: str, key: Column | None = None) -> Column:
    """x of [0, n) under a permutation of [0, n), one for each cell column, kind and key: no state and no shuffle,
    and n may differ from row to row.

    A layer turns the numbers by an offset and then moves the first a * b of them, a near the root of n and b = n div a,
    by two Feistel rounds on (number div b, number mod b); each step is one-to-one, so the whole is, for any n.
    A round's function squares twice modulo PRIME, between additions of the round's numbers."""
    if isinstance(n, int):
        a, n = F.lit(min(n, max(2, isqrt(n)))).cast("bigint"), F.lit(n).cast("bigint")
    else:
        a = F.least(n, F.greatest(F.lit(2), F.floor(F.sqrt(n.cast("double"))))).cast("bigint")
    div = lambda x, y: F.call_function("div", x, y)
    b = div(n, a)
    numbers = _numbers(cell.seed, cell.table, f"{cell.column}/{kind}", 6 * LAYERS)
    steps = F.array(*[F.struct(F.lit(i % 3).alias("step"), F.lit(numbers[2 * i]).cast("bigint").alias("p"), F.lit(numbers[2 * i + 1]).cast("bigint").alias("q")) for i in range(3 * LAYERS)])
    own = F.lit(0).cast("bigint") if key is None else F.conv(F.substring(digest(cell.seed, cell.table, f"{cell.column}/{kind}", key), 1, 13), 16, 10).cast("bigint") % PRIME

    def run(h: Column) -> Column:
        def drawn(k: Column, half: Column, size: Column) -> Column:
            y = (half + k["p"] + h) % PRIME
            z = (y * y + k["q"]) % PRIME
            return z * z % PRIME % size

        def moved(v: Column, k: Column) -> Column:
            first = (div(v, b) + drawn(k, v % b, a)) % a * b + v % b
            second = div(v, b) * b + (v % b + drawn(k, div(v, b), b)) % b
            return F.when(k["step"] == 0, (v + drawn(k, F.lit(0), n)) % n).when(v >= a * b, v).when(k["step"] == 1, first).otherwise(second)

        return F.aggregate(steps, x.cast("bigint"), moved)

    return F.when(n > 0, F.element_at(F.transform(F.array(own), run), 1))


def permuted_sql(seed: int, table: str, tag: str, x: str, n: str, key: str | None = None) -> str:
    """The same as DuckDB SQL; n, and key if given, are names of columns."""
    a = f"least({n}, greatest(2, floor(sqrt({n}::DOUBLE))))::BIGINT"
    b = f"({n} // {a})"
    numbers = _numbers(seed, table, tag, 6 * LAYERS)
    of = lambda k: f"([{', '.join(map(str, numbers[k::2]))}]::BIGINT[])[j + 1]"
    h = f"(('0x' || substr({digest_sql(seed, table, tag, key)}, 1, 13))::BIGINT % {PRIME})" if key else "0"
    y = lambda half: f"(({half} + {of(0)} + {h}) % {PRIME})"
    z = lambda half: f"(({y(half)} * {y(half)} + {of(1)}) % {PRIME})"
    drawn = lambda half, size: f"({z(half)} * {z(half)} % {PRIME} % {size})"
    return f"""list_reduce(list_prepend(({x})::BIGINT, range({3 * LAYERS})), lambda v, j: CASE WHEN j % 3 = 0 THEN (v + {drawn("0", n)}) % {n}
    WHEN v >= {a} * {b} THEN v WHEN j % 3 = 1 THEN (v // {b} + {drawn(f"v % {b}", a)}) % {a} * {b} + v % {b}
    ELSE v // {b} * {b} + (v % {b} + {drawn(f"v // {b}", b)}) % {b} END)"""


@dataclass(frozen=True)
class Cell:
    """The place of a value: a column's cell in row idx of a table."""

    seed: int
    table: str
    column: str
    idx: Column

    def u(self, kind: str = "value", k: Column | None = None) -> Column:
        tag = f"{self.column}/{kind}"
        return uniform(self.seed, self.table, tag if k is None else F.concat(F.lit(tag + "/"), k.cast("string")), self.idx)

    def z(self, kind: str = "value", k: Column | None = None) -> Column:
        """A standard normal draw (Box-Muller)."""
        return F.sqrt(-2 * F.ln(1 - self.u(kind + ".r", k))) * F.cos(2 * F.pi() * self.u(kind + ".t", k))

    def hex(self, kind: str = "value") -> Column:
        return digest(self.seed, self.table, f"{self.column}/{kind}", self.idx)

    def sql(self, kind: str, idx: str) -> str:
        return uniform_sql(self.seed, self.table, f"{self.column}/{kind}", idx)
