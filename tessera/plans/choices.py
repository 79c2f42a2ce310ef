"""Which generator fills a column: the configuration, else the schema's own facts, else a guess by the
column's name, else the type's fallback."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field
from decimal import Decimal

from tessera.functions.generators import check_params
from tessera.plans.schema import Column, Schema, SchemaError, Table, column_bounds
from tessera.sources.config import Config

#: (name, column pattern, kinds, confidence, generator, parameters), the first that fits counts.
#: A name in a table of products is a product's.
GUESSES = [
    ("password", r"^(password|passwd|contrasena|clave)$", "text", 0.8, "template", {"text": "{column}_{n}"}),
    ("email", r"e_?mail|correo", "text", 0.95, "fake", {"provider": "email"}),
    ("iban", r"iban", "text", 0.9, "fake", {"provider": "iban"}),
    ("national id", r"^(dni|nif|nie|ssn)", "text", 0.75, "fake", {"provider": "ssn"}),
    ("postcode", r"postal|postcode|zip", "text", 0.85, "fake", {"provider": "postcode"}),
    ("user", r"^(user(_?name)?|login|usuario)$", "text", 0.8, "fake", {"provider": "user_name"}),
    ("ip", r"^ip(_|$)|_ip$", "text", 0.85, "fake", {"provider": "ipv4"}),
    ("image", r"image|imagen|foto|photo|avatar", "text", 0.7, "fake", {"provider": "image_url"}),
    ("url", r"url|website|^web$", "text", 0.85, "fake", {"provider": "url"}),
    ("phone", r"phone|telefono|^tel$|movil|mobile", "text", 0.85, "fake", {"provider": "phone_number"}),
    ("uuid", r"uuid|guid", "uuid text", 0.9, "uuid", {}),
    ("first name", r"nombre_pila|first_?name|given_?name", "text", 0.85, "fake", {"provider": "first_name"}),
    ("last name", r"apellido|last_?name|surname", "text", 0.85, "fake", {"provider": "last_name"}),
    ("company", r"empresa|company|compania", "text", 0.75, "fake", {"provider": "company"}),
    ("job", r"puesto|^job|cargo$", "text", 0.7, "fake", {"provider": "job"}),
    ("name", r"^(nombre|name|full_?name|nombre_completo)$", "text", 0.75, "fake", {"provider": "name"}),
    ("address", r"direccion|address|domicilio", "text", 0.8, "fake", {"provider": "street_address"}),
    ("city", r"ciudad|city|localidad|municipio", "text", 0.8, "fake", {"provider": "city"}),
    ("region", r"provincia|region|comunidad|^state$", "text", 0.75, "fake", {"provider": "region"}),
    ("country code", r"(pais|country)_?(iso|code)|^(codigo_pais|iso_code)", "text", 0.85, "fake", {"provider": "country_code"}),
    ("country", r"^(pais|country)", "text", 0.85, "fake", {"provider": "country"}),
    ("currency", r"moneda|currency|divisa", "text", 0.85, "fake", {"provider": "currency_code"}),
    ("color", r"colou?r", "text", 0.7, "fake", {"provider": "color_name"}),
    ("plate", r"matricula|license_plate", "text", 0.8, "fake", {"provider": "license_plate"}),
    ("title", r"titulo|^title$|asunto|subject", "text", 0.7, "fake", {"provider": "catch_phrase"}),
    ("slug", r"^slug$", "text", 0.8, "fake", {"provider": "slug"}),
    ("code", r"^cod(igo)?(_|$)|^code|_code$|referencia", "text", 0.7, "template", {"text": "{column}_{n}"}),
    ("identifier", r"^(identificador|numero|num|ref)(_|$)", "text", 0.7, "template", {"text": "{column}_{n}"}),
    ("description", r"descripcion|description|observaciones|notas?$|comment", "text", 0.7, "template", {"text": "{column} {n}"}),
    ("age", r"^(edad|age)$", "integer", 0.85, "integer_range", {"low": 0, "high": 120}),
    ("year", r"^(anio|ano|year)|_(anio|year)", "integer", 0.8, "integer_range", {"low": 1900, "high": 2100}),
    ("percent", r"porcentaje|percent|^pct", "numeric integer", 0.7, "numeric_range", {"low": 0, "high": 100}),
    ("latitude", r"^lat(itud|itude)?$", "numeric", 0.85, "numeric_range", {"low": -90, "high": 90}),
    ("longitude", r"^(lon|lng|longitud|longitude)$", "numeric", 0.85, "numeric_range", {"low": -180, "high": 180}),
    ("price", r"precio|price|importe|amount|total|coste?|salario|salary", "numeric integer", 0.75, "numeric_range", {"low": 0, "high": 1000000}),
    ("quantity", r"cantidad|quantity|stock|unidades|qty", "integer numeric", 0.7, "integer_range", {"low": 0, "high": 1000}),
    ("capacity", r"capacidad|capacity|aforo", "integer", 0.7, "integer_range", {"low": 1, "high": 1000}),
    ("area", r"superficie|area|metros", "numeric integer", 0.7, "numeric_range", {"low": 1, "high": 10000}),
    ("birth", r"nacimiento|birth", "date", 0.85, "date_range", {"low": dt.date(1930, 1, 1), "high": dt.date(2010, 1, 1)}),
    ("registration", r"fecha_(alta|registro|creacion)|^(created|registered|signup)", "date", 0.8, "date_range", {"low": dt.date(2015, 1, 1), "high": dt.date(2025, 1, 1)}),
    ("flag", r"^(es|is|has|tiene)_|activ[oa]|^active|enabled", "boolean", 0.8, "fallback", {}),
    ("expiry", r"caducidad|expir|vencimiento", "date", 0.8, "date_range", {"low": dt.date(2025, 1, 1), "high": dt.date(2035, 1, 1)}),
]


@dataclass
class Choice:
    generator: str
    params: dict = field(default_factory=dict)
    source: str = "fallback"  # user schema heuristic fallback key serial
    confidence: float = 0.0
    null_ratio: float = 0.0
    unique: bool = False


def guess(column: Column, table: str = "") -> tuple[str, float, str, dict] | None:
    for name, pattern, kinds, confidence, generator, params in GUESSES:
        if column.kind in kinds.split() and re.search(pattern, column.name):
            if name == "name" and re.search(r"product|articul|item|servicio", table):
                return "product name", confidence, "fake", {"provider": "catch_phrase"}
            return name, confidence, generator, params
    return None


def misfit(column: Column) -> str | None:
    """The guess that the column's name gives and its type forbids."""
    return next((name for name, pattern, kinds, *_ in GUESSES if re.search(pattern, column.name) and column.kind not in kinds.split()), None)


def choose(schema: Schema, config: Config, warnings: list[str] | None = None) -> dict[str, dict[str, Choice]]:
    """The choice for each column of each table; contradictions with the schema are errors, what is only
    doubtful is added to the warnings."""
    warnings = [] if warnings is None else warnings
    for name, t in config.tables.items():
        for column in [*t.columns, *t.foreign_keys]:
            schema.table(name).column(column)
        for fk in schema.table(name).foreign_keys:
            given = [c for c in fk.columns if c in t.foreign_keys]
            for c in given[1:]:
                if t.foreign_keys[c] != t.foreign_keys[given[0]]:
                    raise SchemaError(f"{name}: {given[0]} and {c} belong to one foreign key, but name different strategies")
    return {t.name: {c.name: _choose(t, c, config, warnings) for c in t.columns} for t in schema.tables}


def _choose(table: Table, column: Column, config: Config, warnings: list[str]) -> Choice:
    own = getattr(config.tables.get(table.name), "columns", {}).get(column.name)
    bounds = column_bounds(table, column.name)
    unique = [column.name] in table.keys() or bool(own and own.unique)
    if own and own.null_ratio and not column.nullable:
        raise SchemaError(f"{table.name}.{column.name}: a null ratio on a column that is NOT NULL")
    nulls = own.null_ratio if own else config.null_ratio if column.nullable else 0.0
    if column.serial:
        return Choice("serial", source="serial")
    if any(column.name in fk.columns for fk in table.foreign_keys):
        return Choice("key", source="key")
    if own and own.generator:
        allowed = column.values or bounds.get("values")
        where = f"{table.name}.{column.name}"
        check_params(own.generator, own.params, where)
        if own.generator == "choice" and allowed and not set(map(str, own.params.get("values", []))) <= set(map(str, allowed)):
            raise SchemaError(f"{where}: values outside {allowed}")
        if own.generator != "choice" and allowed:
            warnings.append(f"{where}: {own.generator} may make values outside {allowed}")
        _within(where, own.generator, own.params, bounds)
        return Choice(own.generator, _clipped(table, column, own.params, bounds, own.generator), "user", 1.0, nulls, unique)
    if "values" in bounds and not bounds["values"]:
        warnings.append(f"{table.name}.{column.name}: no value satisfies its checks")
        return Choice("fallback", {}, "fallback", 0.0, nulls, unique)
    if column.values or "values" in bounds:
        return Choice("choice", {"values": [*map(_plain(column), column.values or bounds["values"])]}, "schema", 1.0, nulls, unique)
    found = None if column.array else guess(column, table.name)
    if not found and not column.array and (name := misfit(column)):
        warnings.append(f"{table.name}.{column.name}: a {column.kind} column can't hold what its name says ({name})")
    known = {k: v for k, v in bounds.items() if k in ("low", "high")}
    if found and found[1] >= config.min_confidence:
        return Choice(found[2], _clipped(table, column, found[3], bounds, found[2]), "heuristic", found[1], nulls, unique)
    if known and column.kind in ("integer", "numeric", "date"):
        return Choice(_range_of(column), _clipped(table, column, {}, bounds, _range_of(column)), "schema", 1.0, nulls, unique)
    return Choice("fallback", {}, "fallback", 0.0, nulls, unique)


def _plain(column: Column):
    return (lambda v: int(v)) if column.kind == "integer" else (lambda v: float(v)) if column.kind == "numeric" else str


def _range_of(column: Column) -> str:
    return {"integer": "integer_range", "date": "date_range"}.get(column.kind, "numeric_range" if column.precision else "float_range")


def _within(where: str, generator: str, params: dict, bounds: dict) -> None:
    """What a configuration asks for must lie within the schema's bounds: it is never cut in silence."""
    asked = params.get("values") or [] if generator == "choice" else [params[b] for b in ("low", "high") if params.get(b) is not None]
    for value in asked:
        for bound, sign in (("low", -1), ("high", 1)):
            edge = bounds.get(bound)
            day = isinstance(value, dt.date) and isinstance(edge, str)
            if not day and not (isinstance(value, (int, float)) and isinstance(edge, (int, float, Decimal))):
                continue
            a, b = (value.isoformat(), edge) if day else (value, float(edge))
            beyond = a < b if sign < 0 else a > b
            if beyond or generator == "choice" and a == b and bounds.get(f"{bound}_exclusive"):
                raise SchemaError(f"{where}: {value} is beyond the schema's {'lower' if sign < 0 else 'upper'} bound {edge}")


#: Generators of a range: both ends are set, and lie within the schema's bounds.
_RANGED = {"integer_range", "numeric_range", "float_range", "date_range", "normal", "lognormal", "zipf"}


def _clipped(table: Table, column: Column, params: dict, bounds: dict, generator: str) -> dict:
    """Range parameters within the schema's bounds."""
    if column.kind not in ("integer", "numeric", "date") or generator not in _RANGED:
        return dict(params)
    default = {"integer": (0, 1000), "numeric": (0, 1000), "date": (dt.date(2015, 1, 1), dt.date(2025, 1, 1))}[column.kind]
    cast = (lambda v: dt.date.fromisoformat(str(v))) if column.kind == "date" else float
    low, high = params.get("low", None), params.get("high", None)
    edge_low, edge_high = (cast(bounds[b]) if b in bounds else None for b in ("low", "high"))
    out = {k: v for k, v in params.items() if k not in ("low", "high")}
    out["low"] = max(x for x in (low if low is not None else (default[0] if edge_low is None else edge_low), edge_low) if x is not None)
    span = dt.timedelta(days=3653) if column.kind == "date" else 1000
    upper = high if high is not None else (edge_high if edge_high is not None else max(default[1], out["low"] + span))
    out["high"] = min(x for x in (upper, edge_high) if x is not None)
    if column.kind == "date":
        out["low"] += dt.timedelta(days=bool(bounds.get("low_exclusive") and out["low"] == edge_low))
        out["high"] -= dt.timedelta(days=bool(bounds.get("high_exclusive") and out["high"] == edge_high))
    if out["low"] > out["high"]:
        raise SchemaError(f"{table.name}.{column.name}: no value between {out['low']} and {out['high']}")
    if column.kind != "date" and "low" in bounds and bounds.get("low_exclusive") and out["low"] == edge_low:
        out["min_exclusive"] = True
    if column.kind != "date" and "high" in bounds and bounds.get("high_exclusive") and out["high"] == edge_high:
        out["max_exclusive"] = True
    return out
