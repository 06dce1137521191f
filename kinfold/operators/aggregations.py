"""Declarative aggregations: count, sum, average, weighted sum, every, any; over all records or per host over a relation.

Each is a few additive states per item and a result of their sums. That split is what Spark combines before a shuffle, and what
change logs add to and take from (`delta`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import finite
from ..model import ModelError
from ..plans.compiler import column, fk_of, hop_rows, join_hop, name_of, resolve, restrict
from ..plans.match import LINK, Match
from ..sources.catalog import Catalog, End


class Item:
    """What a callback reads: item["prop"], item["rel.prop"] over relations to one, item["&.prop"] of the link, item.dep["name"]."""

    def __init__(self, names: dict[str, Column], deps: dict[str, Column]):
        self.names, self.dep = names, deps

    def __getitem__(self, path: str) -> Column:
        if path not in self.names:
            raise ModelError(f"{path} is not among the declared attributes {sorted(self.names)}")
        return self.names[path]


def _truth(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0).cast("bigint")


@dataclass(frozen=True)
class Aggregation:
    """attrs: the paths that the callback reads; no others are scanned."""

    attrs: tuple[str, ...] = ()
    callback: Callable[[Item], Any] | None = None

    needs_callback = True
    many_only = False

    def __post_init__(self):
        if self.needs_callback and self.callback is None:
            raise ModelError(f"{type(self).__name__} needs a callback")
        if self.callback is not None and not self.attrs:
            raise ModelError(f"{type(self).__name__}: a callback declares the attributes it reads")

    def states(self, item: Item) -> dict[str, Column]:
        raise NotImplementedError

    def result(self, s: dict[str, Column]) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Count(Aggregation):
    """Items, or items whose callback is true; 0 if none."""

    needs_callback = False

    def states(self, item):
        return {"n": _truth(self.callback(item)) if self.callback else F.lit(1).cast("bigint")}

    def result(self, s):
        return F.coalesce(s["n"], F.lit(0)).cast("bigint")


@dataclass(frozen=True)
class _Field(Aggregation):
    needs_callback = False

    def __post_init__(self):
        if len(self.attrs) != 1:
            raise ModelError(f"{type(self).__name__} reads exactly one field")


@dataclass(frozen=True)
class Summation(_Field):
    """Nulls, NaN and infinities count as 0; 0 if none."""

    def states(self, item):
        return {"s": finite(item[self.attrs[0]])}

    def result(self, s):
        return F.coalesce(s["s"], F.lit(0.0))


@dataclass(frozen=True)
class Average(_Field):
    """Sum over number of items: nulls count as 0 and stay in the denominator; 0 if none."""

    def states(self, item):
        return {"s": finite(item[self.attrs[0]]), "n": F.lit(1).cast("bigint")}

    def result(self, s):
        return F.when(s["n"] > 0, s["s"] / s["n"]).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class WeightedSummation(Aggregation):
    """The callback gives (weight, value); products that are not finite count as 0."""

    def states(self, item):
        w, v = self.callback(item)
        return {"s": finite(w.cast("double") * v.cast("double"))}

    def result(self, s):
        return F.coalesce(s["s"], F.lit(0.0))


@dataclass(frozen=True)
class Every(Aggregation):
    """Whether the callback is true of all items; of none it is, unless not_empty."""

    not_empty: bool = False
    many_only = True

    def states(self, item):
        return {"ok": _truth(self.callback(item)), "n": F.lit(1).cast("bigint")}

    def result(self, s):
        return F.when(s["n"] > 0, s["ok"] == s["n"]).otherwise(F.lit(not self.not_empty))


@dataclass(frozen=True)
class Any_(Aggregation):
    """Whether the callback is true of some item."""

    many_only = True

    def states(self, item):
        return {"ok": _truth(self.callback(item))}

    def result(self, s):
        return F.coalesce(s["ok"], F.lit(0)) > 0


def _columns(cat: Catalog, entity: str, df: DataFrame, paths: tuple[str, ...]) -> tuple[DataFrame, dict[str, Column]]:
    """df with relations to one joined where paths need them, and the column of each path."""
    names, seen = {}, set()
    for path in paths:
        seg = tuple(path.split("."))
        if seg[0] == LINK:
            names[path] = F.col(f"`{name_of((LINK,), seg[1])}`")
            continue
        hops, where, _ = resolve(cat, entity, seg)
        for p, end in hops:
            if end.many:
                raise ModelError(f"{path}: aggregations read over relations to one")
            if p not in seen:
                df = join_hop(cat, df, p[:-1], p, end)
                seen.add(p)
        names[path] = column(where, seg[-1])
    return df, names


def scalars(**values: Any) -> dict[str, Column]:
    """Global dependencies of callbacks: dictionary values, or one-row, one-column frames as scalar subqueries."""
    return {k: v.scalar() if isinstance(v, DataFrame) else F.lit(v) for k, v in values.items()}


def items(cat: Catalog, agg: Aggregation, entity: str, prop: str, match: Any = None, deps: dict[str, Column] | None = None) -> DataFrame:
    """(host, states...) for each item that a host of `entity` reaches by `prop`."""
    end = cat.end(entity, prop)
    if end is None:
        raise ModelError(f"{prop} is not a relation of {entity}")
    if agg.many_only and not end.many:
        raise ModelError(f"{type(agg).__name__} needs a relation to many")
    fk = fk_of(cat, end)
    if fk and fk[0] == "here":
        df = cat.scan(entity).select(F.col("id").alias("_src"), F.col(fk[1]).alias("_fk")).join(cat.scan(end.target), F.col("_fk") == F.col("id")).drop("_fk")
    else:
        bare = match is None and all(p.startswith(f"{LINK}.") for p in agg.attrs) and (fk is None)
        df = hop_rows(cat, end, not bare)
    if match is not None:
        df = restrict(cat, end.target, df, Match.of(match), ["_src", "id"])
    df, names = _columns(cat, end.target, df, agg.attrs)
    states = agg.states(Item(names, deps or {}))
    return df.select(F.col("_src").alias("host"), *[c.alias(k) for k, c in states.items()])


def global_items(cat: Catalog, agg: Aggregation, record: str, match: Any = None, deps: dict[str, Column] | None = None) -> DataFrame:
    df = cat.scan(record)
    if match is not None:
        df = restrict(cat, record, df, Match.of(match))
    df, names = _columns(cat, record, df, agg.attrs)
    return df.select(*[c.alias(k) for k, c in agg.states(Item(names, deps or {})).items()])


def sums(rows: DataFrame, by: str | None = None) -> DataFrame:
    cols = [c for c in rows.columns if c != by]
    return (rows.groupBy(by) if by else rows.groupBy()).agg(*[F.sum(c).alias(c) for c in cols])


def aggregate_all(cat: Catalog, agg: Aggregation, record: str, match: Any = None, name: str = "value", deps: dict[str, Column] | None = None) -> DataFrame:
    """One row: the aggregation of all records of an entity, view or union."""
    s = sums(global_items(cat, agg, record, match, deps))
    return s.select(agg.result({c: F.col(c) for c in s.columns}).alias(name))


def aggregate(cat: Catalog, agg: Aggregation, entity: str, prop: str, match: Any = None, name: str = "value", deps: dict[str, Column] | None = None) -> DataFrame:
    """(id, name) for every host, also those that reach nothing."""
    s = sums(items(cat, agg, entity, prop, match, deps), "host")
    states = [c for c in s.columns if c != "host"]
    out = cat.scan(entity).select("id").join(s, F.col("id") == F.col("host"), "left")
    return out.select("id", agg.result({c: F.col(c) for c in states}).alias(name))


def delta(state: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """The state (host, sums) after items changed: sums of `after` are added and those of `before` taken away.

    Both hold the changed items only, so that the cost follows the change. Hosts left without items keep zero states."""
    cols = [c for c in state.columns if c != "host"]
    signed = after.select("host", *cols).unionAll(before.select("host", *[(-F.col(c)).alias(c) for c in cols]))
    change = sums(signed, "host")
    j = state.alias("s").join(change.alias("d"), "host", "full")
    return j.select("host", *[(F.coalesce(F.col(f"s.{c}"), F.lit(0)) + F.coalesce(F.col(f"d.{c}"), F.lit(0))).alias(c) for c in cols])


def check_states(state: DataFrame, counts: tuple[str, ...] = ("n", "ok")) -> DataFrame:
    """States that went below zero: rows here mean that a change log missed or repeated a change."""
    bad = [F.col(c) < 0 for c in counts if c in state.columns]
    cond = F.lit(False)
    for b in bad:
        cond = cond | b
    return state.filter(cond)


def from_state(agg: Aggregation, hosts: DataFrame, state: DataFrame, name: str = "value") -> DataFrame:
    cols = [c for c in state.columns if c != "host"]
    out = hosts.select("id").join(state, F.col("id") == F.col("host"), "left")
    return out.select("id", agg.result({c: F.col(c) for c in cols}).alias(name))


__all__ = ["Aggregation", "Any_", "Average", "Count", "End", "Every", "Item", "Summation", "WeightedSummation", "aggregate", "aggregate_all", "check_states", "delta", "from_state", "global_items", "items", "scalars", "sums"]
