"""Declarations: entities, properties, relations, dictionaries and views. Plain data; nothing here touches Spark."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields
from typing import Any

TYPES = ("string", "number", "boolean", "timestamp", "object", "json", "id")
CARDINALITIES = ("1:1", "1:n", "n:1", "n:n")


class ModelError(ValueError):
    """A declaration or a query that the model rejects."""


@dataclass(frozen=True)
class Property:
    """A typed column. `collection` makes it an array; `default` fills missing values on insert; `computed` derives it from its own row."""

    name: str
    type: str = "string"
    collection: bool = False
    default: Any = None
    computed: Callable | None = None

    def __post_init__(self):
        if self.type not in TYPES and self.type not in _extended:
            raise ModelError(f"unknown property type {self.type!r}")


@dataclass(frozen=True)
class Entity:
    name: str
    properties: tuple[Property, ...] = ()
    identity: tuple[str, ...] = ()

    def __post_init__(self):
        names = [p.name for p in self.properties]
        if len(set(names)) != len(names):
            raise ModelError(f"{self.name}: a property is declared twice")
        if missing := set(self.identity) - set(names) - {"id"}:
            raise ModelError(f"{self.name}: identity names unknown properties {sorted(missing)}")

    def property(self, name: str) -> Property | None:
        return next((p for p in self.properties if p.name == name), None)


@dataclass(frozen=True)
class FilteredEntity:
    """A view: the rows of `base` (an entity or another view) that match."""

    name: str
    base: str
    match: Any


@dataclass(frozen=True)
class MergedEntity:
    """A union type over entities or views, told apart by `__type`. It can't be created directly."""

    name: str
    inputs: tuple[str, ...]
    common: tuple[str, ...] = ()


@dataclass(frozen=True)
class Relation:
    """A typed edge set. The side that a property is read from decides whether it is to one or to many.

    A relation of an entity with itself under one property name is symmetric. `base` and `match` make it a filtered relation.
    `reliance`: targets live and die with their source.
    """

    name: str
    source: str
    source_property: str
    target: str
    target_property: str = ""
    type: str = "n:n"
    properties: tuple[Property, ...] = ()
    reliance: bool = False
    base: str = ""
    match: Any = None

    def __post_init__(self):
        if self.type not in CARDINALITIES:
            raise ModelError(f"{self.name}: unknown cardinality {self.type!r}")
        if self.symmetric and self.type != "n:n":
            raise ModelError(f"{self.name}: a symmetric relation is n:n")
        if self.reliance and self.type not in ("1:1", "1:n"):
            raise ModelError(f"{self.name}: only 1:1 and 1:n targets can rely on their source")

    @property
    def symmetric(self) -> bool:
        return self.source == self.target and self.source_property == self.target_property

    def to_many(self, forward: bool) -> bool:
        return self.type.split(":")[1 if forward else 0] == "n"


@dataclass(frozen=True)
class Dictionary:
    """A global named value."""

    name: str
    type: str = "string"
    collection: bool = False
    default: Any = None


@dataclass(frozen=True)
class TypeSpec:
    """An extended property type: its Spark type, codecs (Column to Column) and the operators legal on it."""

    name: str
    spark: str
    encode: Callable = lambda c: c
    decode: Callable = lambda c: c
    operators: dict[str, Callable] = field(default_factory=dict)


_extended: dict[str, TypeSpec] = {}


def define_type(spec: TypeSpec) -> TypeSpec:
    if spec.name in TYPES:
        raise ModelError(f"{spec.name} is built in")
    _extended[spec.name] = spec
    return spec


def extended_type(name: str) -> TypeSpec | None:
    return _extended.get(name)


SPARK_TYPES = {"string": "string", "number": "double", "boolean": "boolean", "timestamp": "timestamp", "object": "string", "json": "string", "id": "bigint"}


def spark_type(p: Property) -> str:
    base = _extended[p.type].spark if p.type in _extended else SPARK_TYPES[p.type]
    return f"array<{base}>" if p.collection else base


def to_dict(decl: Any) -> dict:
    """A declaration as plain data; functions are left out."""

    def plain(x: Any) -> Any:
        if hasattr(x, "to_dict"):
            return x.to_dict()
        if isinstance(x, Property):
            return {f.name: plain(getattr(x, f.name)) for f in fields(x)}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        return None if callable(x) else x

    return {"kind": type(decl).__name__, **{f.name: plain(getattr(decl, f.name)) for f in fields(decl)}}


def from_dict(d: dict) -> Any:
    from .plans.match import Match

    kinds = {c.__name__: c for c in (Property, Entity, FilteredEntity, MergedEntity, Relation, Dictionary)}
    d = dict(d)
    kind = kinds[d.pop("kind")]
    if "properties" in d:
        d["properties"] = tuple(Property(**p) for p in d["properties"])
    if d.get("match") is not None:
        d["match"] = Match.from_dict(d["match"])
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items()})
