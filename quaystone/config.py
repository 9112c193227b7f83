"""Strict configuration: unknown keys and wrong types are errors."""

from __future__ import annotations

import dataclasses
import re
import types
import typing
from pathlib import Path
from typing import Any

import yaml

from quaystone.plans.guard import Policy


class ConfigError(ValueError):
    """A configuration file that says what it must not."""


@dataclasses.dataclass(frozen=True)
class SqlSection:
    allowed_tables: list[str]
    max_rows: int = 200
    statement_timeout_ms: int = 30_000
    blocked_functions: list[str] = dataclasses.field(default_factory=list)


@dataclasses.dataclass(frozen=True)
class CheckSection:
    explain: bool = False
    max_scan_bytes: int | None = None


@dataclasses.dataclass(frozen=True)
class RetrievalConfig:
    sql: SqlSection
    sql_checks: CheckSection = CheckSection()

    def policy(self) -> Policy:
        base = Policy(frozenset(self.sql.allowed_tables))
        return Policy(frozenset(t.lower() for t in self.sql.allowed_tables), self.sql.max_rows, self.sql.statement_timeout_ms / 1000, self.sql_checks.max_scan_bytes, base.default_schema, base.blocked_functions | {f.lower() for f in self.sql.blocked_functions})


@dataclasses.dataclass(frozen=True)
class EvaluationConfig:
    calls_per_minute: int | None = None
    calls_per_day: int | None = None
    top_k: int = 4
    cases: str = "golden_set.yaml"


@dataclasses.dataclass(frozen=True)
class ModelConfig:
    """One pair of generator and embedder; ``provider`` names who is asked."""

    provider: str
    generator: str
    embedder: str
    dimensions: int
    top_k: int = 4
    floor: float = 0.0
    retries: int = 3


@dataclasses.dataclass(frozen=True)
class ProfileSet:
    """The known models and the one in use."""

    active: str
    profiles: dict[str, ModelConfig]

    def __post_init__(self):
        self.select()

    def select(self, name: str | None = None) -> ModelConfig:
        """A profile by name, the active one without."""
        wanted = name or self.active
        if wanted not in self.profiles:
            raise ConfigError(f"no profile {wanted}; there are {sorted(self.profiles)}")
        return self.profiles[wanted]


@dataclasses.dataclass(frozen=True)
class DocumentSource:
    """An outside document, pinned to a version and a digest. Its names become paths, so they hold nothing that means one."""

    source_id: str
    title: str
    publisher: str
    canonical_url: str
    version: str
    language: str
    sha256: str

    def __post_init__(self):
        for value, form, what in (
            (self.source_id, r"[a-z0-9]+(_[a-z0-9]+)*", "source_id"),
            (self.version, r"[A-Za-z0-9._-]+", "version"),
            (self.language, r"[a-z]{2}", "language"),
            (self.sha256, r"[0-9a-f]{64}", "sha256"),
            (self.canonical_url, r"https?://[^\s?#]+\.[A-Za-z0-9]+", "canonical_url"),
        ):
            if not re.fullmatch(form, value):
                raise ConfigError(f"{what}: {value!r} has not the form {form}")

    @property
    def file_name(self) -> str:
        return f"{self.source_id}__{self.version}.{self.canonical_url.rsplit('.', 1)[1]}"


@dataclasses.dataclass(frozen=True)
class SourceRegistry:
    sources: list[DocumentSource]

    def __post_init__(self):
        names = [s.source_id for s in self.sources]
        if not names or len(set(names)) < len(names):
            raise ConfigError(f"sources: none, or an id that comes twice: {sorted(names)}")

    def select(self, source_id: str) -> DocumentSource:
        for s in self.sources:
            if s.source_id == source_id:
                return s
        raise ConfigError(f"no source {source_id}; there are {sorted(s.source_id for s in self.sources)}")


def _typed(value: Any, kind: Any, where: str) -> Any:
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if dataclasses.is_dataclass(kind):
        return build(kind, value, where)
    if origin in (typing.Union, types.UnionType):
        return None if value is None and type(None) in args else _typed(value, next(a for a in args if a is not type(None)), where)
    if origin is list:
        if not isinstance(value, list):
            raise ConfigError(f"{where}: a list is wanted")
        return [_typed(v, args[0], f"{where}[{i}]") for i, v in enumerate(value)]
    if origin is dict:
        if not isinstance(value, dict) or not value or not all(isinstance(k, str) for k in value):
            raise ConfigError(f"{where}: a mapping by name is wanted")
        return {k: _typed(v, args[1], f"{where}.{k}") for k, v in value.items()}
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        value = float(value)
    if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
        raise ConfigError(f"{where}: {kind.__name__} is wanted, not {value!r}")
    if kind is int and value <= 0:
        raise ConfigError(f"{where}: must be positive")
    return value


def build(kind: type, raw: Any, where: str = "config"):
    """An instance of the dataclass from plain data."""
    if not isinstance(raw, dict):
        raise ConfigError(f"{where}: a mapping is wanted")
    hints, fields = typing.get_type_hints(kind), {f.name: f for f in dataclasses.fields(kind)}
    unknown = sorted(set(raw) - set(fields))
    if unknown:
        raise ConfigError(f"{where}: unknown keys {unknown}")
    missing = sorted(n for n, f in fields.items() if n not in raw and f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING)
    if missing:
        raise ConfigError(f"{where}: missing keys {missing}")
    return kind(**{n: _typed(v, hints[n], f"{where}.{n}") for n, v in raw.items()})


def load(path: str, kind: type = RetrievalConfig):
    """Read a YAML file into ``kind``."""
    try:
        raw = yaml.safe_load(Path(path).read_text())
    except (OSError, yaml.YAMLError) as e:
        raise ConfigError(f"{path}: {type(e).__name__}") from e
    out = build(kind, raw)
    if isinstance(out, RetrievalConfig) and out.sql_checks.max_scan_bytes and not out.sql_checks.explain:
        raise ConfigError("sql_checks: a ceiling needs explain")
    return out
