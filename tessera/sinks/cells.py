"""Cells and statements as text, built by column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Reserved words of PostgreSQL that an identifier must quote: fixed values.
RESERVED = frozenset(
    "all analyse analyze and any array as asc asymmetric authorization binary both case cast check collate collation column concurrently"
    " constraint create cross current_catalog current_date current_role current_schema current_time current_timestamp current_user"
    " default deferrable desc distinct do else end except false fetch for foreign freeze from full grant group having ilike in initially"
    " inner intersect into is isnull join lateral leading left like limit localtime localtimestamp natural not notnull null offset on only"
    " or order outer overlaps placing primary references returning right select session_user similar some symmetric system_user table"
    " tablesample then to trailing true union unique user using variadic verbose when where window with".split()
)


def identifier(name: str) -> str:
    plain = re.fullmatch(r"[a-z_][a-z0-9_$]*", name) and name not in RESERVED
    return name if plain else '"' + name.replace('"', '""') + '"'


def plain_text(field: T.StructField) -> Column:
    """The value as unquoted text; null stays null."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, T.BooleanType):
        return F.when(c, "true").when(~c, "false")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def csv_cell(field: T.StructField) -> Column:
    """Null is empty; quotes only where a cell needs them."""
    text = F.coalesce(plain_text(field), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\n\r]'), quoted).otherwise(text)


def csv_line(df: DataFrame, columns: list[str]) -> Column:
    return F.concat_ws(",", *[csv_cell(df.schema[c]) for c in columns])


def json_object(df: DataFrame, columns: list[str]) -> Column:
    """One JSON object; decimals as strings, bytes as hex, nulls kept."""
    values = []
    for c in columns:
        kind = df.schema[c].dataType
        values.append((plain_text(df.schema[c]) if isinstance(kind, (T.DecimalType, T.BinaryType, T.TimestampType, T.TimestampNTZType)) else F.col(f"`{c}`")).alias(c))
    return F.to_json(F.struct(*values), {"ignoreNullFields": "false"})


def _sql_string(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def array_text(array: Column) -> Column:
    """PostgreSQL's text form of an array of strings."""

    def element(e: Column) -> Column:
        escaped = F.replace(F.replace(e, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        needs = (e == "") | (F.upper(e) == "NULL") | e.rlike(r'[,{}"\\\s]')
        return F.when(e.isNull(), "NULL").when(needs, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(e)

    return F.concat(F.lit("{"), F.array_join(F.transform(array, element), ","), F.lit("}"))


def sql_literal(field: T.StructField) -> Column:
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, T.BooleanType):
        text = F.when(c, "TRUE").when(~c, "FALSE")
    elif isinstance(kind, T.NumericType):
        text = c.cast("string")
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.lit("'\\x"), F.lower(F.hex(c)), F.lit("'::bytea"))
    elif isinstance(kind, T.ArrayType):
        text = _sql_string(array_text(c.cast("array<string>")))
    else:
        text = _sql_string(plain_text(field))
    return F.coalesce(text, F.lit("NULL"))


def value_tuple(df: DataFrame, columns: list[str]) -> Column:
    return F.concat(F.lit("("), F.concat_ws(", ", *[sql_literal(df.schema[c]) for c in columns]), F.lit(")"))


def insert_statements(df: DataFrame, table: str, columns: list[str], order: str, batch: int) -> DataFrame:
    """(batch, statement): multi-row INSERTs of `batch` rows by a dense 0-based order."""
    head = f"INSERT INTO {identifier(table)} ({', '.join(map(identifier, columns))}) VALUES\n  "
    rows = df.select(F.expr(f"`{order}` div {batch}").alias("batch"), F.struct(F.col(f"`{order}`").alias("o"), value_tuple(df, columns).alias("t")).alias("r"))
    listed = F.transform(F.array_sort(F.collect_list("r")), lambda r: r["t"])  # `batch` rows at most
    return rows.groupBy("batch").agg(F.concat(F.lit(head), F.array_join(listed, ",\n  "), F.lit(";")).alias("statement"))


def update_statements(df: DataFrame, table: str, key: list[str], columns: list[str]) -> DataFrame:
    """(statement): one UPDATE for each row with a value to set; columns without one are not named."""
    if not key:
        raise ValueError(f"{table}: an UPDATE needs a primary key")
    known = df.where(" or ".join(f"`{c}` is not null" for c in columns))
    pairs = lambda names: [F.concat(F.lit(f"{identifier(c)} = "), sql_literal(df.schema[c])) for c in names]
    given = [F.when(F.col(f"`{c}`").isNotNull(), pair) for c, pair in zip(columns, pairs(columns))]
    text = F.concat(F.lit(f"UPDATE {identifier(table)} SET "), F.concat_ws(", ", *given), F.lit(" WHERE "), F.concat_ws(" AND ", *pairs(key)), F.lit(";"))
    return known.select(text.alias("statement"))


def contiguous(df: DataFrame, column: str, start: int = 1) -> DataFrame:
    """(contiguous): whether the column holds start, start + 1, ... without gap or repeat."""
    c = F.col(column)
    n = F.count(F.lit(1))
    return df.agg(((n == 0) | ((F.min(c) == start) & (F.max(c) == n + start - 1) & (F.countDistinct(c) == n))).alias("contiguous"))


def comment(text: str) -> str:
    """A one-line SQL comment; line breaks of any kind become spaces."""
    return "-- " + re.sub(r"[\n\r\v\f\x1c-\x1e\x85  ]", " ", text)
