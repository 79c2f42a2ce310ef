"""Value generators: each builds a Column for a cell. Bad parameters raise before any row exists."""

from __future__ import annotations

import datetime as dt
import inspect
import math
from collections.abc import Callable, Sequence
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.functions.draws import Cell, permuted, pick

INT_LIMITS = {16: 2**15, 32: 2**31, 64: 2**63}
DECADE = (dt.date(2015, 1, 1), dt.date(2025, 1, 1))


class GeneratorError(ValueError):
    """A generator's parameters can't give any value."""


def integer_range(cell: Cell, low: float = 0, high: float = 1000, *, min_exclusive: bool = False, max_exclusive: bool = False, bits: int = 32) -> Column:
    first, size = _integers(cell, low, high, min_exclusive, max_exclusive, bits)
    return F.lit(first).cast("bigint") + pick(cell.u(), size)


def distinct_integers(cell: Cell, rows: int, low: float = 0, high: float = 1000, *, min_exclusive: bool = False, max_exclusive: bool = False, bits: int = 32) -> Column:
    """As integer_range, but no two of the rows 0 to rows - 1 have the same value: a permutation of the range."""
    first, size = _integers(cell, low, high, min_exclusive, max_exclusive, bits)
    if rows > size:
        raise GeneratorError(f"{cell.table}.{cell.column}: no distinct values for {rows} rows between {low} and {high}")
    return F.lit(first).cast("bigint") + permuted(cell, cell.idx, size, "distinct")


def _integers(cell: Cell, low: float, high: float, min_exclusive: bool, max_exclusive: bool, bits: int) -> tuple[int, int]:
    """The first integer of a range, and how many there are."""
    limit = INT_LIMITS[bits]
    first, last = math.ceil(low), math.floor(high)
    first += min_exclusive and first == low
    last -= max_exclusive and last == high
    first, last = max(first, -limit), min(last, limit - 1)
    if first > last:
        raise GeneratorError(f"{cell.table}.{cell.column}: no integer between {low} and {high}")
    return first, last - first + 1


def grid(low: str | float, high: str | float, scale: int, *, step: str | None = None, min_exclusive: bool = False, max_exclusive: bool = False, precision: int = 38) -> tuple[int, int, Decimal]:
    """First and last multiple of the step within the bounds and what precision can hold."""
    low, high = Decimal(str(low)), Decimal(str(high))
    unit = Decimal(step) if step else Decimal(1).scaleb(-scale)
    limit = Decimal(10) ** (precision - scale) - Decimal(1).scaleb(-scale)
    low, high = max(low, -limit), min(high, limit)
    first = int((low / unit).to_integral_value(ROUND_CEILING))
    last = int((high / unit).to_integral_value(ROUND_FLOOR))
    first += min_exclusive and first * unit == low
    last -= max_exclusive and last * unit == high
    if first > last:
        raise GeneratorError(f"no multiple of {unit} between {low} and {high}")
    return first, last, unit


def numeric_range(cell: Cell, low: str | float, high: str | float, scale: int, *, precision: int = 18, **bounds) -> Column:
    """numeric(precision, scale), uniform over the grid of representable values."""
    first, last, unit = grid(low, high, scale, precision=precision, **bounds)
    return on_grid(F.lit(first).cast("bigint") + pick(cell.u(), last - first + 1), unit, precision, scale)


def on_grid(k: Column, unit: Decimal, precision: int, scale: int) -> Column:
    return (k.cast("decimal(20,0)") * F.lit(unit)).cast(f"decimal({precision},{scale})")


def float_range(cell: Cell, low: float = 0.0, high: float = 1.0, *, step: float | None = None, min_exclusive: bool = False, max_exclusive: bool = False) -> Column:
    """A double between the bounds, or a multiple of the step between them. Without a step the upper bound itself
    isn't drawn, and the lower one neither if it is exclusive."""
    low, high = float(low), float(high)
    if low > high or low == high and (min_exclusive or max_exclusive):
        raise GeneratorError(f"{cell.table}.{cell.column}: no value between {low} and {high}")
    if step:
        first, last, unit = grid(low, high, 0, step=str(step), min_exclusive=min_exclusive, max_exclusive=max_exclusive)
        return (F.lit(first).cast("bigint") + pick(cell.u(), last - first + 1)) * F.lit(float(unit))
    u = cell.u() + F.lit(2.0**-53) if min_exclusive else cell.u()
    return F.lit(low) + u * F.lit(high - low)


def _truncated(cell: Cell, low: float, high: float, draw: Callable[[Column], Column], acceptance: float) -> Column:
    """The first of a number of draws in [low, high], else the clamped first draw. That many draws miss
    with a probability under 1e-9, or 100 do."""
    tries = 1 if acceptance >= 1 else min(100, math.ceil(math.log(1e-9) / math.log1p(-max(acceptance, 1e-9))))
    number = lambda k: F.lit(k)
    inside = lambda x: F.when(x.between(low, high), x)
    once = lambda k: F.transform(F.array(draw(number(k))), inside)[0]  # noqa: E731  a lambda's argument is evaluated once
    few = min(tries, 2)
    made = [once(k) for k in range(1, few + 1)]  # coalesce draws again only where it must
    if tries > few:
        more = F.transform(F.sequence(F.lit(few + 1), F.lit(tries)), draw)
        made.append(F.try_element_at(F.filter(more, lambda x: x.between(low, high)), F.lit(1)))
    return F.coalesce(*made, F.greatest(F.lit(low), F.least(F.lit(high), draw(number(1)))))


def _phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def normal(cell: Cell, low: float, high: float, mean: float | None = None, std: float | None = None) -> Column:
    low, high = float(low), float(high)
    mean = (low + high) / 2 if mean is None else float(mean)
    std = (high - low) / 6 if std is None else float(std)
    if std <= 0:
        return F.lit(max(low, min(high, mean)))
    acceptance = _phi((high - mean) / std) - _phi((low - mean) / std)
    return _truncated(cell, low, high, lambda k: F.lit(mean) + F.lit(std) * cell.z("z", k), acceptance)


def lognormal(cell: Cell, low: float, high: float, median: float | None = None, sigma: float = 0.5) -> Column:
    low, high = float(low), float(high)
    mu = math.log(max(1.0, (low + high) / 2) if median is None else median)
    edge = lambda x: -math.inf if x <= 0 else (math.log(x) - mu) / sigma
    acceptance = _phi(edge(high)) - _phi(edge(low))
    return _truncated(cell, low, high, lambda k: F.exp(F.lit(mu) + F.lit(float(sigma)) * cell.z("z", k)), acceptance)


def rounded(value: Column, digits: int) -> Column:
    """Half up by plain arithmetic, the same in any engine."""
    return F.floor(value * F.lit(10.0**digits) + 0.5) / F.lit(10.0**digits)


def snapped(value: Column, low: str | float, high: str | float, scale: int, precision: int = 18, **exclusive) -> Column:
    """A double on the nearest multiple of 10^-scale within the bounds, half up."""
    first, last, unit = grid(low, high, scale, precision=precision, **exclusive)
    k = F.floor(value * F.lit(10.0**scale) + 0.5).cast("bigint")
    return on_grid(F.greatest(F.lit(first).cast("bigint"), F.least(F.lit(last).cast("bigint"), k)), unit, precision, scale)


def zipf(cell: Cell, low: float = 0, high: float = 1000, s: float = 1.2, *, min_exclusive: bool = False, max_exclusive: bool = False, bits: int = 32) -> Column:
    """Integers from `low` on with falling popularity, the k-th proportional to 1 / k^s: rejection-inversion
    (Hörmann and Derflinger 1996), so no table of ranks is made, however many there are. A draw is accepted
    nine times in ten or more; forty are tried. An s within 1e-6 of 1 counts as 1."""
    limit = INT_LIMITS[bits]
    first, last = max(math.ceil(low), -limit), min(math.floor(high), limit - 1)
    first += min_exclusive and first == low
    last -= max_exclusive and last == high
    n = last - first + 1
    if n < 1 or s <= 0:
        raise GeneratorError(f"{cell.table}.{cell.column}: no integer between {low} and {high}, or s is not over 0")
    return F.lit(first - 1).cast("bigint") + zipf_rank(cell, "zipf", n, s)


def zipf_rank(cell: Cell, kind: str, n: Column | int, s: float) -> Column:
    """A rank from 1 to n, which may be a column, with falling popularity."""
    if isinstance(n, int) and n < 2:
        return F.lit(1).cast("bigint")
    one = abs(s - 1) < 1e-6
    area = lambda x: math.log(x) if one else (x ** (1 - s) - 1) / (1 - s)  # noqa: E731  of the hat, from 1 to x
    area_of = lambda x: F.ln(x) if one else (F.pow(x, F.lit(1.0 - s)) - 1) / F.lit(1.0 - s)
    back = lambda y: math.exp(y) if one else (1 + y * (1 - s)) ** (1 / (1 - s))
    back_of = lambda y: F.exp(y) if one else F.pow(1 + y * F.lit(1.0 - s), F.lit(1 / (1 - s)))
    whole = F.lit(area(n + 0.5)) if isinstance(n, int) else area_of(n + 0.5)
    n, start = F.lit(n) if isinstance(n, int) else n, F.lit(area(1.5) - 1)
    near = 2 - back(area(2.5) - 2**-s)  # at this distance below a rank every draw is accepted

    def ranks(numbers: Column) -> Column:
        """The accepted rank of each try, else null. Each step names what the next reads twice."""
        drawn = F.transform(numbers, lambda k: whole + cell.u(kind, k) * (start - whole))
        placed = F.transform(drawn, lambda y: F.struct(y.alias("y"), back_of(y).alias("x")))
        ranked = F.transform(placed, lambda v: F.struct(v["y"].alias("y"), v["x"].alias("x"), F.greatest(F.lit(1.0), F.least(n.cast("double"), F.floor(v["x"] + 0.5).cast("double"))).alias("r")))
        fits = lambda v: (v["r"] - v["x"] <= F.lit(near)) | (v["y"] >= area_of(v["r"] + 0.5) - F.pow(v["r"], F.lit(-float(s))))
        return F.transform(ranked, lambda v: F.when(fits(v), v["r"]))

    again = F.try_element_at(F.filter(ranks(F.sequence(F.lit(2), F.lit(40))), lambda r: r.isNotNull()), F.lit(1))
    return F.coalesce(ranks(F.array(F.lit(1)))[0], again, F.lit(1.0)).cast("bigint")


def sequence(cell: Cell, start: int = 1, step: int = 1) -> Column:
    if step == 0:
        raise GeneratorError(f"{cell.table}.{cell.column}: a step of 0")
    return F.lit(start).cast("bigint") + cell.idx * F.lit(step)


def choice(cell: Cell, values: Sequence, weights: Sequence[float] | None = None) -> Column:
    if not values or weights and (len(weights) != len(values) or min(weights) < 0 or sum(weights) <= 0):
        raise GeneratorError(f"{cell.table}.{cell.column}: no values, or weights that don't fit them")
    if not weights:
        return F.element_at(F.array(*map(F.lit, values)), (pick(cell.u(), len(values)) + 1).cast("int"))
    total, below, out = sum(weights), 0.0, None
    for value, weight in zip(values, weights):
        below += weight
        under = cell.u() < F.lit(below / total)
        out = F.when(under, value) if out is None else out.when(under, value)
    return out.otherwise(next(v for v, w in zip(reversed(values), reversed(weights)) if w > 0))


def template(cell: Cell, text: str, start: int = 0) -> Column:
    """{table}, {column} and {n}, the row's number from `start`."""
    fixed = text.replace("{table}", cell.table).replace("{column}", cell.column)
    if "{" in fixed.replace("{n}", ""):
        raise GeneratorError(f"{cell.table}.{cell.column}: unknown placeholder in {text!r}")
    number = (cell.idx + start).cast("string")
    parts = fixed.split("{n}")
    return F.concat(*[x for i, p in enumerate(parts) for x in ([number] if i else []) + [F.lit(p)]])


def uuid4(cell: Cell) -> Column:
    h = cell.hex("uuid")
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1)
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def date_range(cell: Cell, low: dt.date = DECADE[0], high: dt.date = DECADE[1]) -> Column:
    days = (high - low).days
    if days < 0:
        raise GeneratorError(f"{cell.table}.{cell.column}: {low} is after {high}")
    return F.date_add(F.lit(low), pick(cell.u(), days + 1).cast("int"))


def timestamp_range(cell: Cell, low: dt.datetime, high: dt.datetime) -> Column:
    """Second resolution, without time zone."""
    seconds = int((high - low).total_seconds())
    if seconds < 0:
        raise GeneratorError(f"{cell.table}.{cell.column}: {low} is after {high}")
    return F.timestamp_add("SECOND", pick(cell.u(), seconds + 1), F.lit(low.isoformat(" ")).cast("timestamp_ntz"))


def fallback(cell: Cell, kind: str, *, scale: int = 2, precision: int = 10, values: Sequence[str] = (), length: int | None = None) -> Column:
    """A value of a type about which nothing else is known."""
    if kind == "integer":
        return integer_range(cell, 0, 1000)
    if kind == "numeric":
        return numeric_range(cell, 0, 1000, scale, precision=precision)
    if kind == "boolean":
        return cell.u() < 0.5
    if kind == "uuid":
        return uuid4(cell)
    if kind == "enum":
        return choice(cell, values)
    if kind == "date":
        return date_range(cell)
    if kind == "timestamp":
        return timestamp_range(cell, dt.datetime.combine(DECADE[0], dt.time()), dt.datetime.combine(DECADE[1], dt.time()))
    if kind == "json":
        return F.lit("{}")
    if kind == "bytea":
        return F.lit(b"")
    value = F.concat(F.lit(f"{cell.table}_{cell.column}_"), F.substring(cell.hex("text"), 1, 8))
    return F.substring(value, 1, length) if length else value


def nullable(cell: Cell, ratio: float, value: Column) -> Column:
    if not 0 <= ratio <= 1:
        raise GeneratorError(f"{cell.table}.{cell.column}: a null ratio of {ratio}")
    return F.when(cell.u("null") >= ratio, value)


def array_of(cell: Cell, element: Callable[[Column], Column], longest: int = 5) -> Column:
    """0 to `longest` elements; element builds one from its number, from 1."""
    size = pick(cell.u("len"), longest + 1).cast("int")
    return F.slice(F.transform(F.sequence(F.lit(1), F.lit(longest)), element), F.lit(1), size)


def bounded(value: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """A generated value moved into bounds that other columns of the row give."""
    if low is not None:
        value = F.greatest(value, low)
    return value if high is None else F.least(value, high)


def redrawn(cell: Cell, value: Column, bound: Column, op: str, edge, kind: str) -> Column:
    """value where it keeps `value op bound`; else drawn anew between the bound and the generator's own edge on
    the other side, or the bound itself where the edge is beyond it. A null bound leaves the value."""
    u, up = cell.u("bound"), op.startswith(">")
    if kind == "date":
        bound = F.date_add(bound, (op == ">") - (op == "<")) if len(op) == 1 else bound
        room = F.datediff(F.lit(edge), bound) if up else F.datediff(bound, F.lit(edge))
        step = F.least(F.floor(u * (room + 1)), room).cast("int")
        new = F.date_add(bound, step) if up else F.date_sub(bound, step)
    elif kind == "integer":
        bound = F.ceil(bound) if op == ">=" else F.floor(bound) if op == "<=" else F.floor(bound) + 1 if up else F.ceil(bound) - 1
        room = F.lit(edge) - bound if up else bound - F.lit(edge)
        step = F.least(F.floor(u * (room + 1)), F.floor(room))
        new = bound + step if up else bound - step
    else:
        room = F.lit(edge) - bound if up else bound - F.lit(edge)
        part = room * (1 - u)  # never zero, so that strict bounds hold
        new = bound + part if up else bound - part
    keeps = ((value > bound if op == ">" and kind not in ("date", "integer") else value >= bound) if up else (value < bound if op == "<" and kind not in ("date", "integer") else value <= bound))
    return F.when(F.coalesce(keeps, F.lit(True)), value).when(room >= 0, new).otherwise(bound)


# draws between bounds that differ by row: text that Spark and DuckDB read alike


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def normal_share(x: str) -> str:
    """The normal distribution's share below x (Abramowitz and Stegun 26.2.17), as SQL; x is a column's name."""
    t = f"(1 / (1 + {_d(0.2316419)} * abs({x})))"
    poly = f"{t} * ({_d(0.319381530)} + {t} * ({_d(-0.356563782)} + {t} * ({_d(1.781477937)} + {t} * ({_d(-1.821255978)} + {t} * {_d(1.330274429)}))))"
    tail = f"({_d(1 / math.sqrt(2 * math.pi))} * exp(-{x} * {x} / 2) * {poly})"
    return f"(CASE WHEN {x} < 0 THEN {tail} ELSE 1 - {tail} END)"


def normal_point(p: str) -> str:
    """The point with a share of p, a column's name, below it (Acklam's rational approximation), as SQL."""
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)

    def poly(x: str, k: tuple) -> str:
        out = _d(k[0])
        for v in k[1:]:
            out = f"({out} * {x} + {_d(v)})"
        return out

    q, r = f"({p} - {_d(0.5)})", f"(({p} - {_d(0.5)}) * ({p} - {_d(0.5)}))"
    low, high = f"sqrt(-2 * ln(greatest({p}, {_d(1e-300)})))", f"sqrt(-2 * ln(greatest(1 - {p}, {_d(1e-300)})))"
    return f"(CASE WHEN {p} < {_d(0.02425)} THEN {poly(low, c)} / {poly(low, d)} WHEN {p} > {_d(0.97575)} THEN -{poly(high, c)} / {poly(high, d)} ELSE {poly(r, a)} * {q} / {poly(r, b)} END)"


def truncated_steps(shape: str, mean: float, spread: float) -> list[tuple[str, str]]:
    """(column, SQL) that make, of a uniform __u and bounds __lo and __hi, a value __new of a normal or lognormal
    distribution between the bounds: the inverse of its distribution function, at a share between those of the
    bounds. Where these are as good as equal, or for any other shape, it is uniform between the bounds."""
    plain = "__lo + __u * (__hi - __lo)"
    if shape not in ("normal", "lognormal"):
        return [("__new", plain)]
    scaled = (lambda v: f"(({v} - {_d(mean)}) / {_d(spread)})") if shape == "normal" else (lambda v: f"((ln(greatest({v}, {_d(1e-300)})) - {_d(mean)}) / {_d(spread)})")
    back = f"{_d(mean)} + {_d(spread)} * __z"
    return [
        ("__zl", scaled("__lo")), ("__zh", scaled("__hi")), ("__pl", normal_share("__zl")), ("__ph", normal_share("__zh")), ("__p", "__pl + __u * (__ph - __pl)"),
        ("__z", normal_point("__p")),
        ("__new", f"CASE WHEN __ph - __pl < {_d(1e-6)} THEN {plain} ELSE greatest(__lo, least(__hi, {back if shape == 'normal' else f'exp({back})'})) END"),
    ]


def shape_of(generator: str, params: dict) -> tuple[str, float, float]:
    """(shape, mean, spread) of a generator of numbers, as normal() and lognormal() read their parameters."""
    low, high = float(params.get("low", 0)), float(params.get("high", 0))
    if generator == "normal":
        mean = (low + high) / 2 if params.get("mean") is None else float(params["mean"])
        return "normal", mean, (high - low) / 6 if params.get("std") is None else float(params["std"])
    if generator == "lognormal":
        return "lognormal", math.log(max(1.0, (low + high) / 2) if params.get("median") is None else params["median"]), float(params.get("sigma", 0.5))
    return "uniform", 0.0, 1.0


def within_bounds(df: DataFrame, cell: Cell, column: str, lows: list[tuple[Column, bool]], highs: list[tuple[Column, bool]], unit: float | None, shape: tuple[str, float, float]) -> DataFrame:
    """df with a numeric column whose values keep all of its row's bounds (value, whether it is exclusive): a value
    that does stays, others are drawn again between the highest of the lower bounds and the lowest of the
    upper ones, with the generator's distribution. Values are multiples of unit, or any doubles without one.
    Null bounds count for nothing; where a side has none, or the bounds leave nothing between them, the value is
    moved to the nearest bound."""
    value = F.col(column).cast("double")
    nudge = F.lit(unit or 0.0)
    edge = lambda b, strict, up: b.cast("double") if unit is None else (F.ceil(b.cast("double") / unit - 1e-9) + F.when(F.lit(strict) & (F.ceil(b.cast("double") / unit - 1e-9) <= b.cast("double") / unit + 1e-9), 1).otherwise(0) if up else F.floor(b.cast("double") / unit + 1e-9) - F.when(F.lit(strict) & (F.floor(b.cast("double") / unit + 1e-9) >= b.cast("double") / unit - 1e-9), 1).otherwise(0)) * nudge
    most = lambda f, xs: f(*xs) if len(xs) > 1 else xs[0] if xs else F.lit(None).cast("double")
    low, high = most(F.greatest, [edge(b, s, True) for b, s in lows]), most(F.least, [edge(b, s, False) for b, s in highs])
    out = df.withColumns({"__lo": low, "__hi": high, "__u": (cell.u("bound") + 2.0**-53)})
    for name, text in truncated_steps(*shape):
        out = out.withColumn(name, F.expr(text))
    new = F.col("__new") if unit is None else F.least(F.col("__hi"), F.greatest(F.col("__lo"), F.floor(F.col("__new") / unit + 0.5) * unit)) if shape[0] != "uniform" else F.least(F.col("__hi"), F.col("__lo") + F.floor(F.col("__u") * ((F.col("__hi") - F.col("__lo")) / unit + 1)) * unit)
    strict_low, strict_high = (any(s for _, s in xs) and unit is None for xs in (lows, highs))
    keeps = F.coalesce(value > F.col("__lo") if strict_low else value >= F.col("__lo"), F.lit(True)) & F.coalesce(value < F.col("__hi") if strict_high else value <= F.col("__hi"), F.lit(True))
    moved = F.when((F.col("__lo") <= F.col("__hi")), new).otherwise(F.greatest(F.least(value, F.col("__hi")), F.col("__lo")))
    moved = F.when(value.isNull() | keeps, value).otherwise(moved)
    return out.withColumn("__made", moved).drop("__lo", "__hi", "__u", *[n for n, _ in truncated_steps(*shape)])


def years_between(later: Column, earlier: Column) -> Column:
    month_day = lambda d: F.month(d) * 100 + F.dayofmonth(d)
    return F.year(later) - F.year(earlier) - (month_day(later) < month_day(earlier)).cast("int")


def noise(cell: Cell, sigma: float, rule: int | str = 0) -> Column:
    """1 + N(0, sigma); the rule's number and the place in the rule keep two noises of a row apart."""
    if sigma < 0:
        raise GeneratorError("a noise of negative width")
    return 1 + F.lit(float(sigma)) * cell.z(f"noise{rule}")


#: Pools of invented or common words: fixed values.
POOLS = {
    "first_name": ["Ana", "Luis", "Marta", "Pablo", "Lucia", "Jorge", "Elena", "Raul", "Ines", "Diego", "Clara", "Hugo"],
    "last_name": ["Vega", "Rojas", "Soler", "Marin", "Ibarra", "Campos", "Prieto", "Lara", "Nieto", "Rivas", "Duran", "Pardo"],
    "city": ["Valdera", "Montalba", "Riofrio", "Castelar", "Puertoluz", "Santalla", "Belmira", "Aldanova"],
    "street": ["Calle Mayor", "Avenida del Sol", "Calle Nueva", "Paseo del Rio", "Calle Real", "Plaza Alta"],
    "country": ["Spain", "France", "Portugal", "Italy", "Germany", "Ireland"],
    "country_code": ["ES", "FR", "PT", "IT", "DE", "IE"],
    "currency": ["EUR", "USD", "GBP", "CHF"],
    "color": ["red", "green", "blue", "black", "white", "yellow", "brown", "grey"],
    "job": ["analyst", "welder", "teacher", "baker", "nurse", "driver", "clerk", "architect"],
    "word": ["amber", "cedar", "delta", "ember", "fjord", "grove", "harbor", "islet", "juniper", "kernel", "lagoon", "meadow"],
}


def fake(cell: Cell, provider: str, locale: str | None = None) -> Column:
    """Plausible text of a kind, from fixed pools and digits of the cell's draws. With a locale, names of people and
    places are put together from its syllables, so their number has no bound."""
    if locale is not None and locale not in names.SYLLABLES:
        raise GeneratorError(f"{cell.table}.{cell.column}: unknown locale {locale!r}; known: {', '.join(sorted(names.SYLLABLES))}")

    def word(pool: str, kind: str = "value") -> Column:
        if locale and pool in ("first_name", "last_name", "city"):
            return names.word(cell, locale, pool.removesuffix("_name"))
        return F.element_at(F.array(*map(F.lit, POOLS[pool])), (pick(cell.u(kind), len(POOLS[pool])) + 1).cast("int"))

    def digits(n: int, kind: str) -> Column:
        return F.lpad(pick(cell.u(kind), 10**n).cast("string"), n, "0")

    first, last = word("first_name", "first"), word("last_name", "last")
    plain = lambda text: F.translate(F.lower(text), "áéíóúñü", "aeiounu")
    made = {
        "name": lambda: F.concat_ws(" ", first, last),
        "user_name": lambda: F.concat(plain(first), digits(4, "n")),
        "email": lambda: F.concat(plain(first), F.lit("."), plain(last), cell.idx.cast("string"), F.lit("@example.com")),
        "street_address": lambda: F.concat(word("street"), F.lit(" "), (pick(cell.u("n"), 200) + 1).cast("string")),
        "company": lambda: F.concat(F.initcap(word("word")), F.lit(" "), last, F.lit(" SL")),
        "phone_number": lambda: F.concat(F.lit("+34 6"), digits(8, "n")),
        "postcode": lambda: digits(5, "n"),
        "ssn": lambda: F.concat(digits(8, "n"), F.element_at(F.split(F.lit("T,R,W,A,G,M,Y,F,P,D,X,B,N,J,Z,S,Q,V,H,L,C,K,E"), ","), (pick(cell.u("n"), 10**8) % 23 + 1).cast("int"))),
        "iban": lambda: F.concat(F.lit("ES"), digits(2, "a"), digits(10, "b"), digits(10, "c")),
        "ipv4": lambda: F.concat_ws(".", *[pick(cell.u(f"p{i}"), 256).cast("string") for i in range(4)]),
        "url": lambda: F.concat(F.lit("https://"), word("word"), F.lit(".example.com/"), cell.idx.cast("string")),
        "image_url": lambda: F.concat(F.lit("https://img.example.com/"), cell.idx.cast("string"), F.lit(".png")),
        "license_plate": lambda: F.concat(digits(4, "n"), F.lit(" "), F.upper(F.substring(cell.hex("plate"), 1, 3))),
        "slug": lambda: F.concat_ws("-", word("word", "a"), word("word", "b"), cell.idx.cast("string")),
        "catch_phrase": lambda: F.initcap(F.concat_ws(" ", word("word", "a"), word("color", "b"), word("word", "c"))),
    }
    aliases = {"region": "city", "currency_code": "currency", "color_name": "color"}
    if provider in made:
        return made[provider]()
    pool = aliases.get(provider, provider)
    if pool not in POOLS:
        raise GeneratorError(f"{cell.table}.{cell.column}: unknown provider {provider!r}")
    return word(pool)


REGISTRY: dict[str, Callable[..., Column]] = {
    "numeric_range": numeric_range, "integer_range": integer_range, "float_range": float_range, "normal": normal,
    "lognormal": lognormal, "sequence": sequence, "choice": choice, "template": template, "uuid": uuid4,
    "date_range": date_range, "timestamp_range": timestamp_range, "fallback": fallback, "fake": fake, "zipf": zipf,
}


def register(name: str, build: Callable[..., Column]) -> None:
    """Add a generator: build(cell, **params) returns a Column."""
    if name in REGISTRY:
        raise GeneratorError(f"{name!r} is registered")
    REGISTRY[name] = build


def resolve(name: str) -> Callable[..., Column]:
    if name not in REGISTRY:
        raise GeneratorError(f"unknown generator {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


def check_params(name: str, params: dict, where: str) -> None:
    """An error that names a parameter which a generator doesn't have."""
    known = {p.name: p for p in list(inspect.signature(resolve(name)).parameters.values())[1:]}
    if any(p.kind is p.VAR_KEYWORD for p in known.values()):
        return
    for key in params:
        if key not in known:
            raise GeneratorError(f"{where}: {name} has no parameter {key!r}")
