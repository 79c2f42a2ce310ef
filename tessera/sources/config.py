"""Run configuration from YAML: seed, rows, generators, foreign keys, rules, refs, hierarchies."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

import yaml


class ConfigError(ValueError):
    """A configuration with an unknown or misplaced entry; the message names its path."""


class _Loader(yaml.SafeLoader):
    """YAML 1.2 booleans: yes, no, on and off are text."""


_Loader.yaml_implicit_resolvers = {
    first: [(tag, pattern) for tag, pattern in found if tag != "tag:yaml.org,2002:bool" or first in "tTfF"] for first, found in yaml.SafeLoader.yaml_implicit_resolvers.items()
}


@dataclass
class ColumnConfig:
    generator: str | None = None
    params: dict = field(default_factory=dict)
    null_ratio: float = 0.0
    unique: bool = False


@dataclass
class KeyConfig:
    strategy: str | None = None  # uniform zipf unique_subset quota
    s: float = 1.2
    min: int = 0
    max: int | None = None
    null_ratio: float = 0.0


@dataclass
class TableConfig:
    rows: int | None = None
    columns: dict[str, ColumnConfig] = field(default_factory=dict)
    foreign_keys: dict[str, KeyConfig] = field(default_factory=dict)
    rules: list[str] = field(default_factory=list)


@dataclass
class Level:
    branching: int = 5
    max_depth: int | None = None


@dataclass
class Config:
    seed: int = 0
    rows: int = 100
    min_confidence: float = 0.7
    tables: dict[str, TableConfig] = field(default_factory=dict)
    refs: dict[str, float | int | str] = field(default_factory=dict)
    hierarchy: dict[str, Level] = field(default_factory=dict)
    null_ratio: float = 0.0  # of nullable columns without one of their own
    batch_size: int = 5000
    on_error: str = "quarantine"  # or abort
    locale: str = "es_ES"  # of names


_PARTS = {("tables",): TableConfig, ("tables", "columns"): ColumnConfig, ("tables", "foreign_keys"): KeyConfig, ("hierarchy",): Level}


def _build(cls: type, data: object, path: str, kind: tuple[str, ...] = ()) -> object:
    if not isinstance(data, dict):
        raise ConfigError(f"{path or 'configuration'}: a mapping is expected")
    known, out = {f.name for f in fields(cls)}, {}
    for key, value in data.items():
        where = f"{path}.{key}" if path else str(key)
        if key not in known:
            raise ConfigError(f"{where}: unknown entry")
        part = _PARTS.get((*kind, key))
        if part:
            if not isinstance(value, dict):
                raise ConfigError(f"{where}: a mapping is expected")
            value = {name: _build(part, item, f"{where}.{name}", (*kind, key)) for name, item in value.items()}
        out[key] = value
    return cls(**out)


#: Entries that say nothing to this engine: the format's version, the dialect, a language model's address.
_IGNORED = ("version", "dialect", "llm")


#: The parameters of each distribution.
_FAMILIES = {"uniform": (), "normal": ("mean", "std"), "lognormal": ("median", "sigma"), "zipf": ("s",)}


def _put(target: dict, key: str, value: object, path: str) -> None:
    if key in target:
        raise ConfigError(f"{path}: given twice")
    target[key] = value


def _sections(data: dict) -> dict:
    """The longer form of a configuration, with sections defaults and output and with fk, in the short one."""
    out = {k: v for k, v in data.items() if k not in (*_IGNORED, "defaults", "output")}
    llm = data.get("llm")
    if isinstance(llm, dict) and "min_confidence" in llm:
        _put(out, "min_confidence", llm["min_confidence"], "llm.min_confidence")
    known = {"defaults": ("rows", "null_ratio"), "output": ("batch_size", "on_error")}
    for section, names in known.items():
        for key, value in (data.get(section) or {}).items():
            if key in names:
                _put(out, key, value, f"{section}.{key}")
            elif (section, key) != ("output", "max_repair_retries"):
                raise ConfigError(f"{section}.{key}: unknown entry")
    for name, t in (out.get("tables") or {}).items():
        if not isinstance(t, dict):
            continue
        if "fk" in t:
            t = out["tables"][name] = {("foreign_keys" if k == "fk" else k): v for k, v in t.items()}
        for column, c in (t.get("columns") or {}).items():
            if isinstance(c, dict):
                t["columns"][column] = _column(c, f"tables.{name}.columns.{column}")
    return out


def _column(c: dict, path: str) -> dict:
    """A column's generator with min, max and a distribution of its values."""
    params = dict(c.get("params") or {})
    for old, new in (("min", "low"), ("max", "high"), ("template", "text")):
        if old in params:
            _put(params, new, params.pop(old), f"{path}.params.{old}")
    generator = {"faker": "fake"}.get(c.get("generator"), c.get("generator"))
    shape = params.pop("distribution", None)
    if shape is not None:
        if not isinstance(shape, dict) or shape.get("family") not in _FAMILIES:
            raise ConfigError(f"{path}.params.distribution.family: one of {', '.join(_FAMILIES)}")
        given = shape.get("params") or {}
        for key in [k for k in shape if k not in ("family", "params")] + [k for k in given if k not in _FAMILIES[shape["family"]]]:
            raise ConfigError(f"{path}.params.distribution.{key}: {shape['family']} has no such entry")
        if shape["family"] != "uniform":
            generator = shape["family"]
            params |= given
    return c | {"generator": generator, "params": params} if c.get("generator") else c


def read_config_text(text: str) -> Config:
    try:
        data = yaml.load(text, Loader=_Loader)
    except yaml.YAMLError as e:
        raise ConfigError(f"not YAML: {e}") from e
    config = _build(Config, _sections(data) if isinstance(data, dict) else data or {}, "")
    if config.on_error not in ("quarantine", "abort"):
        raise ConfigError("on_error: quarantine or abort")
    for name, t in config.tables.items():
        for column, key in t.foreign_keys.items():
            if key.strategy not in (None, "uniform", "zipf", "unique_subset", "quota"):
                raise ConfigError(f"tables.{name}.foreign_keys.{column}.strategy: unknown {key.strategy!r}")
    return config


def read_config(path: str) -> Config:
    return read_config_text(Path(path).read_text(encoding="utf-8"))
