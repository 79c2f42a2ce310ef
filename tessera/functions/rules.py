"""Row rules. A rule is a Spark SQL expression over the row's columns; Catalyst parses and checks it.
Three forms are spelled for it before: parent(fk).column, ref('name') and noise(sigma). Rules may call the
functions in FUNCTIONS only, as Spark has functions that run any Java method."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.draws import Cell
from tessera.functions.generators import noise

_PARENT = re.compile(r"\bparent\(\s*(\w+)\s*\)\.(\w+)")
_REF = re.compile(r"\bref\(\s*'([^']*)'\s*\)")
_NOISE = re.compile(r"\bnoise\(\s*([0-9.]+)\s*\)")
_EQUAL = re.compile(r"'[^']*'|\"[^\"]*\"|<=>|[<>!=]=|<>|=")
_COMPARE = re.compile(r"^\s*(\w+)\s*(>=|<=|<>|=|>|<)\s*(.+)$", re.S)
_BANNED = re.compile(r";|--|/\*|[\\`{}]|\b(select|from|table|values|exists)\b", re.I)
_STRING = re.compile(r"'[^']*'|\"[^\"]*\"")
_CALL = re.compile(r"(\w+)\s*\(")
#: What rules and CHECKs may call: row functions without effects.
FUNCTIONS = frozenset(
    "parent ref noise years_between date date_add date_sub datediff add_months months_between make_date to_date last_day trunc date_trunc"
    " year month day dayofmonth dayofweek hour minute second extract timestamp abs round floor ceil ceiling greatest least mod pow power sqrt exp ln sign"
    " coalesce nullif ifnull nvl if isnull isnotnull int bigint smallint double float decimal numeric string boolean cast try_cast"
    " len length char_length character_length lower upper trim ltrim rtrim btrim substring substr left right concat concat_ws replace lpad rpad position"
    " instr startswith endswith contains size cardinality array array_contains".split()
)
_WORDS = frozenset("in and or not when then else case between like ilike is interval varchar char".split())


class RuleError(ValueError):
    """A rule that can't be used."""


def check_text(text: str) -> str:
    """text, if it is one expression of allowed functions."""
    bare = _STRING.sub("''", text)
    if _BANNED.search(bare) or "\\" in text or "'" in bare.replace("''", "") or '"' in bare:
        raise RuleError(f"not a row rule: {text!r}")
    for name in _CALL.findall(bare):
        if name.lower() not in FUNCTIONS | _WORDS:
            raise RuleError(f"unknown function {name!r} in {text!r}")
    return text


def parent_column(fk: str, column: str) -> str:
    return f"__p_{fk}_{column}"


@dataclass(frozen=True)
class Rule:
    """kind is bound (column, op and expr), derivation (column = expr) or assertion."""

    text: str
    number: int = 0
    kind: str = field(init=False)
    column: str | None = field(init=False, default=None)
    op: str | None = field(init=False, default=None)
    right: str | None = field(init=False, default=None)

    def __post_init__(self) -> None:
        check_text(self.text)
        found = _COMPARE.match(self.text)
        kind = "assertion"
        if found and found[2] != "<>" and not re.search(r"\b(and|or)\b", found[3], re.I) and not re.search(rf"(?<![.\w]){found[1]}\b", _PARENT.sub("", found[3])):
            kind = "derivation" if found[2] == "=" else "bound"
            for name, value in zip(("column", "op", "right"), found.groups()):
                object.__setattr__(self, name, value)
        object.__setattr__(self, "kind", kind)

    @property
    def parents(self) -> list[tuple[str, str]]:
        return sorted(set(_PARENT.findall(self.text)))

    @property
    def reads(self) -> set[str]:
        """The names that the rule's right side (an assertion's whole text) reads from its own row."""
        bare = _PARENT.sub(" ", _STRING.sub(" ", self.right or self.text))
        return set(re.findall(r"(?<![.\w])[A-Za-z_]\w*", bare))


def ordered(rules: list[Rule], assertions: bool = False) -> list[Rule]:
    """Derivations and bounds so that each comes after those of the columns it reads; of one column, the
    derivation first; else as written; assertions last or not at all. A cycle is an error that names its columns."""
    todo = sorted((r for r in rules if r.kind != "assertion"), key=lambda r: (r.kind == "bound", r.number))
    by_column: dict[str, list[Rule]] = {}
    for r in todo:
        by_column.setdefault(r.column, []).append(r)
    out: list[Rule] = []
    state: dict[int, bool] = {}  # number -> finished

    def visit(rule: Rule, path: list[str]) -> None:
        if rule.number in state:
            if not state[rule.number]:
                raise RuleError(f"rules in a circle: {' -> '.join([*path[path.index(rule.column):], rule.column])}")
            return
        state[rule.number] = False
        for column in sorted(rule.reads & by_column.keys() - {rule.column}):
            for other in by_column[column]:
                visit(other, [*path, rule.column])
        for other in by_column[rule.column]:
            if other.kind == "derivation" and rule.kind == "bound":
                visit(other, [*path, rule.column])
        state[rule.number] = True
        out.append(rule)

    for r in sorted(todo, key=lambda r: r.number):
        visit(r, [])
    return out + [r for r in rules if assertions and r.kind == "assertion"]


def replaced(text: str, name: str, build: Callable[[list[str]], str | None]) -> str:
    """text with each call of a function, outside of strings, as build makes it of the arguments; these may hold
    calls and strings of their own. A call for which build gives None stays."""
    out, at, word = "", 0, re.compile(rf"'[^']*'|\"[^\"]*\"|(?<![.\w]){name}\s*\(")
    while found := word.search(text, at):
        out += text[at : found.start()]
        if found[0][0] in "'\"":
            out, at = out + found[0], found.end()
            continue
        args, depth, start, k = [], 1, found.end(), found.end()
        while k < len(text) and depth:
            c = text[k]
            if c in "'\"":
                k = text.find(c, k + 1) if text.find(c, k + 1) > 0 else len(text)
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1 or not depth:
                args.append(replaced(text[start:k].strip(), name, build))
                start = k + 1
            k += 1
        if depth:
            raise RuleError(f"a parenthesis isn't closed: {text!r}")
        made = build(args)
        out, at = out + (f"{name}({', '.join(args)})" if made is None else made), k
    return out + text[at:]


def two_valued(text: str) -> str:
    """SQL text whose = and <> are never unknown: null equals null and differs from all else."""
    names = {"=": " IS NOT DISTINCT FROM ", "==": " IS NOT DISTINCT FROM ", "<>": " IS DISTINCT FROM ", "!=": " IS DISTINCT FROM "}
    return _EQUAL.sub(lambda m: names.get(m[0], m[0]), text)


def compile_text(text: str, cell: Cell, refs: dict | None = None, number: int = 0) -> tuple[str, dict[str, Column]]:
    """SQL text and the helper columns it names."""
    helpers: dict[str, Column] = {}

    def ref(match: re.Match) -> str:
        if match[1] not in (refs or {}):
            raise RuleError(f"unknown ref {match[1]!r}")
        value = refs[match[1]]
        if not isinstance(value, str):
            return str(value)
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def draw(match: re.Match) -> str:
        name = f"__noise{number}_{len(helpers)}"
        helpers[name] = noise(cell, float(match[1]), f"{number}.{len(helpers)}" if helpers else number)
        return name

    def years(args: list[str]) -> str | None:
        if len(args) != 2:
            return None
        a, b = args
        return f"(year({a}) - year({b}) - int(month({a}) * 100 + day({a}) < month({b}) * 100 + day({b})))"

    text = _PARENT.sub(lambda m: parent_column(m[1], m[2]), text)
    text = replaced(text, "years_between", years)
    text = replaced(text, "date", lambda args: f"make_date({', '.join(args)})" if len(args) == 3 else None)
    return _NOISE.sub(draw, _REF.sub(ref, text)), helpers


def evaluate(df: DataFrame, name: str, text: str, cell: Cell, refs: dict | None = None, number: int = 0) -> DataFrame:
    """df with the value of a rule's expression as a column."""
    sql, helpers = compile_text(text, cell, refs, number)
    return df.withColumns(helpers).withColumn(name, F.expr(sql)).drop(*helpers) if helpers else df.withColumn(name, F.expr(sql))


def with_parent(df: DataFrame, parent: DataFrame, fk: str, keys: dict[str, str], columns: list[str]) -> DataFrame:
    """df with columns of its parent (keys: child column -> parent column), null without one."""
    side = parent.select(*[F.col(p).alias(f"__k_{c}") for c, p in keys.items()], *[F.col(c).alias(parent_column(fk, c)) for c in columns])
    condition = None
    for c in keys:
        equal = df[c] == side[f"__k_{c}"]
        condition = equal if condition is None else condition & equal
    return df.join(side, condition, "left").drop(*[f"__k_{c}" for c in keys])
