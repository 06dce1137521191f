"""The match language: atoms `(path, operator, operand)` in a boolean tree, and what each operator means as a Column."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import canonical_json, json_column, to_timestamp_literal
from ..model import ModelError, Property, extended_type
from .boolexp import BoolExp

LINK = "&"


@dataclass(frozen=True)
class Atom:
    """`reference`: the operand is a path from the outermost root (a pair of paths for between)."""

    path: str
    op: str
    operand: Any
    reference: bool = False

    @property
    def segments(self) -> tuple[str, ...]:
        return tuple(self.path.split("."))

    def to_dict(self) -> dict:
        operand = {"match": self.operand.to_dict()} if isinstance(self.operand, Match) else self.operand
        return {"path": self.path, "op": self.op, "operand": operand, "reference": self.reference}

    @staticmethod
    def from_dict(d: dict) -> Atom:
        o = d["operand"]
        return Atom(d["path"], d["op"], Match.from_dict(o["match"]) if isinstance(o, dict) and "match" in o else o, d["reference"])


@dataclass(frozen=True)
class Match:
    exp: BoolExp

    @staticmethod
    def atom(path: str, op: str, operand: Any, reference: bool = False) -> Match:
        if not path:
            raise ModelError("an atom needs a path")
        if op == "exist" and not isinstance(operand, Match):
            operand = Match.of(operand)
        return Match(BoolExp.atom(Atom(path, op.lower(), operand, reference)))

    @staticmethod
    def of(x: Any) -> Match:
        """From a Match, an expression, a mapping of equalities (all hold), or a list of atoms (one holds)."""
        if isinstance(x, Match):
            return x
        if isinstance(x, BoolExp):
            return Match(x)
        if isinstance(x, dict):
            if not x:
                raise ModelError("a mapping needs a key")
            return Match(BoolExp.all(*[Match.atom(k, "=", v) for k, v in x.items()]))
        if isinstance(x, tuple):
            return Match.atom(*x)
        return Match(BoolExp.any(*[Match.of(a) for a in x]))

    def and_(self, other: Any) -> Match:
        return Match(self.exp.and_(Match.of(other)))

    def or_(self, other: Any) -> Match:
        return Match(self.exp.or_(Match.of(other)))

    def not_(self) -> Match:
        return Match(self.exp.not_())

    __and__, __or__, __invert__ = and_, or_, not_

    def rebase(self, prefix: str) -> Match:
        """The same predicate seen from a record that reaches this one by `prefix`. Operands of exist stay as they are."""
        return Match(self.exp.map(lambda a: replace(a, path=f"{prefix}.{a.path}")))

    def paths(self) -> set[str]:
        """All paths that it reads, those inside exist included."""
        out: set[str] = set()
        for a in self.exp.atoms():
            if a.op == "exist":
                out.add(a.path)
                out |= {f"{a.path}.{p}" for p in a.operand.paths()}
            else:
                out.add(a.path)
            if a.reference:
                out |= set(a.operand if isinstance(a.operand, (list, tuple)) else [a.operand])
        return out

    def to_dict(self) -> dict:
        return self.exp.to_dict()

    @staticmethod
    def from_dict(d: dict) -> Match:
        return Match(BoolExp.from_dict(d, Atom.from_dict))


_SIMPLE: dict[str, Callable[[Column, Any], Column]] = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "like": lambda a, b: a.like(b)}


def atom_column(value: Column, op: str, operand: Any, prop: Property | None, reference: Callable[[str], Column] | None = None) -> Column:
    """The three-valued truth of one atom. `reference` resolves operand paths where the operand is one."""
    if reference is not None:
        if op in _SIMPLE and op != "like":
            return _SIMPLE[op](value, reference(operand))
        if op == "between":
            return value.between(reference(operand[0]), reference(operand[1]))
        raise ModelError(f"{op} takes no reference")
    ext = extended_type(prop.type) if prop else None
    if ext is not None and op not in ("is null", "is not null", "not") and operand is not None:
        if op not in ext.operators:
            raise ModelError(f"{op} is not an operator of {ext.name}")
        return ext.operators[op](value, operand)
    if prop is not None and prop.type == "timestamp":
        operand = [_time(v) for v in operand] if isinstance(operand, (list, tuple)) else _time(operand)
    json = prop is not None and prop.type in ("json", "object") and not prop.collection
    if op in ("is null", "is not null", "not"):
        if operand is not None:
            raise ModelError(f"{op} takes null only")
        return value.isNull() if op == "is null" else value.isNotNull()
    if op in ("in", "not in"):
        if not isinstance(operand, (list, tuple)):
            raise ModelError(f"{op} takes a list")
        rest, null = [v for v in operand if v is not None], any(v is None for v in operand)
        if json:
            value, rest = json_column(value), [canonical_json(v) for v in rest]
        if op == "in":
            found = value.isin(list(rest)) if rest else F.lit(False)
            found = found | value.isNull() if null else found
            return F.coalesce(found, F.lit(False)) if json else found
        found = ~value.isin(list(rest)) if rest else F.lit(True)
        found = value.isNotNull() & found if null else found
        return F.coalesce(found, F.lit(False)) if json else found
    if op == "contains":
        if prop is None or not prop.collection:
            raise ModelError("contains needs a collection")
        return F.coalesce(F.array_contains(value, F.lit(operand)), F.lit(False))
    if op == "between":
        if len(operand) != 2 or any(v is None for v in operand):
            raise ModelError("between takes two bounds")
        return value.between(operand[0], operand[1])
    if op not in _SIMPLE:
        raise ModelError(f"unknown operator {op}")
    if operand is None:
        if op in ("=", "!="):
            return value.isNull() if op == "=" else value.isNotNull()
        raise ModelError(f"{op} can't be used with null")
    if json and op in ("=", "!="):
        return F.coalesce(_SIMPLE[op](json_column(value), F.lit(canonical_json(operand))), F.lit(False))
    return _SIMPLE[op](value, operand if op == "like" else F.lit(operand))


def _time(v: Any) -> Any:
    return to_timestamp_literal(v) if isinstance(v, (int, float, str, dt.datetime)) else v


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)
