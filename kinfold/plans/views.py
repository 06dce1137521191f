"""The graph of derived views: dependencies, order of refresh, what a change touches, differences between two declarations."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import FilteredEntity, MergedEntity, ModelError, to_dict
from ..sources.catalog import Catalog
from .match import Match

#: Phases of a refresh; a view of an earlier phase is refreshed first.
BEFORE_ALL, NORMAL, AFTER_ALL = 0, 1, 2
MAX_DEPTH = 100


@dataclass(frozen=True)
class View:
    """A derived table: `reads` maps what it depends on (tables or views) to the attributes it reads there (empty: all).

    `full` computes it from its inputs. `incremental` gets (inputs, last, changes) and is used where there is a last result and
    nothing in `windowed` (inputs read with order, limit or offset) changed."""

    name: str
    reads: dict[str, tuple[str, ...]]
    full: Callable[[dict[str, DataFrame]], DataFrame]
    incremental: Callable[[dict[str, DataFrame], DataFrame, dict[str, DataFrame]], DataFrame] | None = None
    windowed: tuple[str, ...] = ()
    phase: int = NORMAL
    version: str = ""


@dataclass
class Graph:
    views: dict[str, View] = field(default_factory=dict)

    def add(self, v: View) -> Graph:
        self.views[v.name] = v
        self.order()
        return self

    def order(self) -> list[str]:
        """Inputs before what reads them, earlier phases first where that leaves a choice; a cycle is an error."""
        left, out = dict(self.views), []
        while left:
            ready = sorted((v.phase, n) for n, v in left.items() if not set(v.reads) & set(left) - {n} and n not in v.reads)
            if not ready:
                raise ModelError(f"views depend on each other in a circle: {sorted(left)}")
            out.append(ready[0][1])
            del left[ready[0][1]]
        return out

    def affected(self, changed: dict[str, set[str]]) -> list[str]:
        """Views to refresh, in order, after changes of attributes (an empty set: rows came or went, or a view was declared anew)."""
        dirty, out = {k: set(v) for k, v in changed.items()}, []
        for n in self.order():
            v = self.views[n]
            if n in changed or any(t in dirty and (not dirty[t] or not attrs or dirty[t] & set(attrs)) for t, attrs in v.reads.items()):
                out.append(n)
                dirty[n] = set()
        if len(out) > MAX_DEPTH:
            raise ModelError(f"a change goes through more than {MAX_DEPTH} views")
        return out

    def plan(self, name: str, last: DataFrame | None, changes: dict[str, Any]) -> str:
        """incremental, full or skip."""
        v = self.views[name]
        touched = [t for t in v.reads if t in changes]
        if last is not None and not touched:
            return "skip"
        if last is None or v.incremental is None or set(touched) & set(v.windowed):
            return "full"
        return "incremental"

    def refresh(self, tables: dict[str, DataFrame], last: dict[str, DataFrame] | None = None, changes: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """All views after a change: skipped, refreshed from changes, or computed in full."""
        last, changes, out = last or {}, dict(changes or {}), dict(tables)
        for n in self.order():
            v = self.views[n]
            how = self.plan(n, last.get(n), changes)
            if how == "skip":
                out[n] = last[n]
                continue
            deps = {t: out[t] for t in v.reads}
            out[n] = v.incremental(deps, last[n], {t: changes[t] for t in v.reads if t in changes}) if how == "incremental" else v.full(deps)
            if n in last:
                changes[n] = out[n]
        return out


def dependencies(cat: Catalog, view: str) -> dict[str, set[str]]:
    """The entities that membership of a view depends on, and which attributes of them."""
    out: dict[str, set[str]] = {}
    for n in cat.order(view):
        d = cat.entities[n]
        if isinstance(d, MergedEntity):
            for i in d.inputs:
                out.setdefault(cat.base_of(i), set())
        if not isinstance(d, FilteredEntity):
            continue
        for p in Match.of(d.match).paths():
            at, seg = cat.base_of(d.base), p.split(".")
            for s in seg[:-1]:
                end = cat.end(at, s)
                if end is None:
                    break
                out.setdefault(end.relation.name, set())
                at = cat.base_of(end.target)
            if cat.end(at, seg[-1]) is None:
                out.setdefault(at, set()).add(seg[-1])
    return out


def manifest(cat: Catalog, graph: Graph | None = None) -> dict[str, dict]:
    """Name to {kind, hash, declaration} of all declarations and views."""
    out = {}
    for kind, group in (("entity", cat.entities), ("relation", cat.relations), ("dictionary", cat.dictionaries)):
        for n, d in group.items():
            plain = to_dict(d)
            out[n] = {"kind": kind, "hash": hashlib.sha256(json.dumps(plain, sort_keys=True, default=str).encode()).hexdigest(), "declaration": plain}
    for n, v in (graph.views if graph else {}).items():
        plain = {"reads": {k: list(a) for k, a in v.reads.items()}, "version": v.version, "phase": v.phase}
        out[n] = {"kind": "view", "hash": hashlib.sha256(json.dumps(plain, sort_keys=True).encode()).hexdigest(), "declaration": plain}
    return out


def manifest_diff(old: dict[str, dict], new: dict[str, dict]) -> list[tuple[str, str]]:
    """(change, name): added, removed, changed."""
    return sorted([("added", n) for n in new.keys() - old.keys()] + [("removed", n) for n in old.keys() - new.keys()] + [("changed", n) for n in new.keys() & old.keys() if new[n]["hash"] != old[n]["hash"]])


def rebuild_plan(old: dict[str, dict], new: dict[str, dict], graph: Graph) -> list[str]:
    """Views to rebuild after declarations changed, inputs first."""
    return graph.affected({n: set() for _, n in manifest_diff(old, new)}) if old != new else []


def destructive(old: dict[str, dict], new: dict[str, dict]) -> list[str]:
    """What of stored data a change of declarations would lose, as "name" or "name.property": removed declarations, removed properties
    and properties whose type or collection changed. Views hold nothing of their own."""
    out = []
    for n, d in old.items():
        if d["kind"] == "view":
            continue
        if n not in new:
            out.append(n)
            continue
        props = lambda x: {p["name"]: (p.get("type"), p.get("collection")) for p in x["declaration"].get("properties") or ()}
        now = props(new[n])
        out += [f"{n}.{p}" for p, kind in props(d).items() if now.get(p) != kind]
    return sorted(out)


def approve(old: dict[str, dict], new: dict[str, dict], approved: set[str]) -> None:
    """Refuse a change that loses data unless just that loss is approved; approvals of anything else are refused too."""
    lost = set(destructive(old, new))
    if missing := sorted(lost - approved):
        raise ModelError(f"not approved: {missing}")
    if extra := sorted(approved - lost):
        raise ModelError(f"approved, but nothing of it is lost: {extra}")


def apply_result(kind: str, current: DataFrame | None, result: DataFrame, name: str = "value", key: str = "id") -> DataFrame:
    """The table that a computed result leaves: global and entity replace it; property sets a column of the hosts in the result (id, value)
    and leaves the others as they are; delete takes the records in the result away."""
    if kind in ("global", "entity"):
        return result
    if kind == "delete":
        return current.join(result.select(key), key, "left_anti")
    if kind != "property":
        raise ModelError(f"{kind} is not a kind of result")
    new = result.select(key, F.struct(F.col(name).alias("v")).alias("_new"))
    j = current.join(new, key, "left")
    old = F.col(name) if name in current.columns else F.lit(None).cast(result.schema[name].dataType)
    value = F.when(F.col("_new").isNotNull(), F.col("_new.v")).otherwise(old)
    return j.select(*[value.alias(c) if c == name else F.col(c) for c in current.columns], *([] if name in current.columns else [value.alias(name)]))


def last_value(policy: str, table: DataFrame | None, name: str = "value", key: str = "id") -> DataFrame | None:
    """What a computation gets of its last result: nothing, its own value by key, or the whole output."""
    if policy not in ("none", "normal", "full"):
        raise ModelError(f"{policy} is not a policy")
    return None if policy == "none" or table is None else table if policy == "full" else table.select(key, name)
