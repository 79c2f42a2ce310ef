"""Reads the PostgreSQL statements that declare tables into a Schema. Only declarations are read; other
statements and clauses give a warning. CHECK predicates stay text: Spark evaluates them."""

from __future__ import annotations

import re

from tessera.plans.schema import Column, ForeignKey, Schema, SchemaError, Table

_TOKEN = re.compile(r"\s+|--[^\n]*|/\*.*?\*/|(?P<t>'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|\w+(?:\.\d+)?|::|<=|>=|<>|!=|\|\||.)", re.S)
#: PostgreSQL type names by kind: fixed values.
TYPES = {
    "smallint": ("integer", 16), "int2": ("integer", 16), "integer": ("integer", 32), "int": ("integer", 32), "int4": ("integer", 32), "bigint": ("integer", 64), "int8": ("integer", 64),
    "smallserial": ("integer", 16), "serial": ("integer", 32), "bigserial": ("integer", 64), "numeric": ("numeric", 0), "decimal": ("numeric", 0), "real": ("numeric", 0), "float4": ("numeric", 0),
    "float8": ("numeric", 0), "float": ("numeric", 0), "double": ("numeric", 0), "text": ("text", 0), "varchar": ("text", 0), "character": ("text", 0), "char": ("text", 0), "bpchar": ("text", 0),
    "date": ("date", 0), "timestamp": ("timestamp", 0), "timestamptz": ("timestamp", 0), "boolean": ("boolean", 0), "bool": ("boolean", 0), "uuid": ("uuid", 0), "json": ("json", 0), "jsonb": ("json", 0), "bytea": ("bytea", 0),
}
_STOP = {"not", "null", "primary", "unique", "references", "check", "default", "constraint", "generated", "collate", "deferrable", "initially", "match", "on"}


class _Token(str):
    """A token with its place in the text."""

    line: int
    column: int


def _tokens(text: str) -> list[str]:
    out, line, start = [], 1, 0
    for m in _TOKEN.finditer(text):
        if m["t"]:
            token = _Token(m["t"])
            token.line, token.column = line, m.start() - start + 1
            out.append(token)
        if breaks := m[0].count("\n"):
            line, start = line + breaks, m.start() + m[0].rindex("\n") + 1
    return out


def _at(token: str) -> str:
    return f"line {token.line}, column {token.column}: " if isinstance(token, _Token) else ""


def _name(token: str) -> str:
    return token[1:-1].replace('""', '"') if token.startswith('"') else token.lower()


class _Reader:
    def __init__(self, tokens: list[str]):
        self.tokens, self.at = tokens, 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead].lower() if self.at + ahead < len(self.tokens) else ""

    def take(self) -> str:
        if self.at >= len(self.tokens):
            raise SchemaError(f"{_at(self.tokens[-1]) if self.tokens else ''}the statement ends early: {' '.join(self.tokens)[-60:]}")
        self.at += 1
        return self.tokens[self.at - 1]

    def accept(self, *words: str) -> bool:
        if all(self.peek(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def expect(self, word: str) -> None:
        if not self.accept(word):
            near = self.tokens[min(self.at, len(self.tokens) - 1)] if self.tokens else ""
            raise SchemaError(f"{_at(near)}{word!r} expected at {' '.join(self.tokens[self.at : self.at + 6])!r}")

    def name(self) -> str:
        name = _name(self.take())
        while self.accept("."):
            name = f"{name}.{_name(self.take())}"
        return name

    def inside(self) -> list[str]:
        """The tokens between a pair of parentheses."""
        self.expect("(")
        depth, start = 1, self.at
        while depth:
            token = self.take()
            depth += (token == "(") - (token == ")")
        return self.tokens[start : self.at - 1]

    def names(self) -> list[str]:
        return [_name(t) for t in self.inside() if t != ","]


def _pieces(tokens: list[str], mark: str) -> list[list[str]]:
    out, depth = [[]], 0
    for t in tokens:
        depth += (t == "(") - (t == ")")
        if t == mark and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return [p for p in out if p]


def _text(tokens: list[str]) -> str:
    return re.sub(r"\s*::\s*\w+", "", " ".join(tokens)).replace(" . ", ".").strip()


def _type(r: _Reader, column: Column, enums: dict[str, list[str]], warnings: list[str]) -> None:
    word = r.name()
    if word in enums:
        column.kind, column.values = "enum", enums[word]
    elif word not in TYPES:
        warnings.append(f"{column.name}: unknown type {word}, read as text")
    else:
        column.kind, bits = TYPES[word]
        column.bits = bits or 32
        column.serial = word.endswith("serial")
        column.nullable = not column.serial
        column.with_timezone = word == "timestamptz"
        r.accept("precision")
        r.accept("varying")
    if r.peek() == "(":
        numbers = [int(t) for t in r.inside() if t.isdigit()]
        if column.kind == "numeric" and numbers:
            column.precision, column.scale = numbers[0], numbers[1] if len(numbers) > 1 else 0
        elif column.kind == "text" and numbers:
            column.length = numbers[0]
    if word in ("char", "character") and column.length is None and column.kind == "text":
        column.length = 1
    if r.accept("with", "time", "zone"):
        column.with_timezone = True
    r.accept("without", "time", "zone")
    while r.accept("["):
        column.array = True
        while not r.accept("]"):
            r.take()


def _reference(r: _Reader, columns: list[str]) -> ForeignKey:
    fk = ForeignKey(columns, r.name())
    if r.peek() == "(":
        fk.ref_columns = r.names()
    while r.peek() in ("on", "match", "deferrable", "initially", "not"):
        if r.peek() == "not" and r.peek(1) != "deferrable":
            break
        word = r.take().lower()
        if word == "on":
            event, action = r.take().lower(), r.take().lower()
            if action in ("set", "no"):
                action = f"{action} {r.take().lower()}"
            if event == "delete":
                fk.on_delete = action
            else:
                fk.on_update = action
            if r.peek() == "(":
                fk.set_null = r.names()
        elif word == "match":
            fk.match_full = r.take().lower() == "full"
        elif word == "not":
            r.take()
        elif word == "deferrable":
            fk.deferrable = True
        else:
            r.take()
    return fk


def _column(tokens: list[str], table: Table, enums: dict[str, list[str]], warnings: list[str]) -> None:
    r = _Reader(tokens)
    column = Column(_name(r.take()))
    _type(r, column, enums, warnings)
    table.columns.append(column)
    while r.peek():
        if r.accept("constraint"):
            named = _name(r.take())
            what = {"primary": column.name, "unique": column.name, "references": column.name}.get(r.peek())
            if what is None and r.peek() == "check":
                what = _text(_Reader(r.tokens[r.at + 1 :]).inside())
            table.names[what or column.name] = named
        elif r.accept("not", "null"):
            column.nullable = False
        elif r.accept("null"):
            pass
        elif r.accept("primary", "key"):
            table.primary_key = [column.name]
        elif r.accept("unique"):
            table.uniques.append([column.name])
        elif r.accept("references"):
            table.foreign_keys.append(_reference(r, [column.name]))
        elif r.accept("check"):
            column.checks.append(_text(r.inside()))
        elif r.accept("default"):
            start = r.at
            while r.peek() and (r.peek() not in _STOP or r.at == start):
                r.inside() if r.peek() == "(" else r.take()
            column.default = _text(r.tokens[start : r.at])
        else:
            warnings.append(f"{table.name}.{column.name}: {r.take()} ignored")


def _constraint(r: _Reader, table: Table, warnings: list[str]) -> None:
    named, what = _name(r.take()) if r.accept("constraint") else None, None
    if r.accept("primary", "key"):
        table.primary_key = what = r.names()
    elif r.accept("unique"):
        what = r.names()
        table.uniques.append(what)
    elif r.accept("foreign", "key"):
        what = r.names()
        r.expect("references")
        table.foreign_keys.append(_reference(r, what))
    elif r.accept("check"):
        what = [_text(r.inside())]
        table.checks += what
    if what:
        if named:
            table.names[",".join(what)] = named
    else:
        warnings.append(f"{table.name}: constraint {r.peek()} ignored")


def read_ddl(sql: str) -> Schema:
    """Statements may come in any order: types first, then tables, then comments and constraints."""
    schema, enums, later = Schema(), {}, []
    statements = _pieces(_tokens(sql), ";")
    for tokens in statements:
        r = _Reader(tokens)
        if r.accept("create", "type"):
            name = r.name()
            if r.accept("as", "enum"):
                enums[name] = [t[1:-1].replace("''", "'") for t in r.inside() if t.startswith("'")]
            else:
                schema.warnings.append(f"type {name} ignored")
    for tokens in statements:
        r = _Reader(tokens)
        if r.accept("create", "table"):
            r.accept("if", "not", "exists")
            table = Table(r.name())
            for part in _pieces(r.inside(), ","):
                if part[0].lower() in ("constraint", "primary", "unique", "foreign", "check"):
                    _constraint(_Reader(part), table, schema.warnings)
                else:
                    _column(part, table, enums, schema.warnings)
            schema.tables.append(table)
        elif not r.accept("create", "type"):
            later.append(r)
    for r in later:
        if r.accept("alter", "table"):
            r.accept("only")
            table = schema.table(r.name())
            if r.accept("add") and r.peek() in ("constraint", "primary", "unique", "foreign", "check"):
                _constraint(r, table, schema.warnings)
            else:
                schema.warnings.append(f"ALTER TABLE {table.name} ignored")
        elif r.accept("comment", "on"):
            what, name = r.take().lower(), r.name()
            r.expect("is")
            text = r.take()[1:-1].replace("''", "'")
            try:
                if what == "table":
                    schema.table(name).comment = text
                elif what == "column":
                    schema.table(name.rpartition(".")[0]).column(name.rpartition(".")[2]).comment = text
            except SchemaError as e:
                schema.warnings.append(str(e))
        else:
            schema.warnings.append(f"statement ignored: {' '.join(r.tokens[:4])}")
    return schema.finish()
