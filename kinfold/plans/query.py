"""find: predicate, projection and modifier over one record type, as one Catalyst plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import ModelError
from ..sources.catalog import Catalog, End
from ..sources.shared import shared_folder
from .compiler import column, fk_of, hop_rows, join_hop, many_paths, name_of, oriented_links, resolve, restrict, restrict_links
from .match import LINK, Atom, Match

ALL = "*"


@dataclass(frozen=True)
class Modifier:
    """Order by paths over relations to one (nulls last, id breaks ties), then offset, then limit."""

    order_by: tuple[tuple[str, str], ...] = ()
    limit: int | None = None
    offset: int | None = None

    @staticmethod
    def of(x: Any) -> Modifier:
        if x is None or isinstance(x, Modifier):
            return x or Modifier()
        m = Modifier(tuple((k, v.lower()) for k, v in dict(x.get("order_by", {})).items()), x.get("limit"), x.get("offset"))
        if unknown := set(x) - {"order_by", "limit", "offset"}:
            raise ModelError(f"unknown modifier {sorted(unknown)}")
        return m

    def __post_init__(self):
        for n in (self.limit, self.offset):
            if n is not None and (not isinstance(n, int) or isinstance(n, bool) or n < 0):
                raise ModelError("limit and offset are whole numbers from 0")
        if any(d not in ("asc", "desc") for _, d in self.order_by):
            raise ModelError("order is asc or desc")


@dataclass(frozen=True)
class Nested:
    """A relation in a projection: its own projection, and what filters, orders and limits its items."""

    name: str
    attrs: tuple = (ALL,)
    match: Match | None = None
    modifier: Modifier = field(default_factory=Modifier)
    alias: str = ""


def nested(name: str, attrs: Any = (ALL,), match: Any = None, modifier: Any = None, alias: str = "") -> Nested:
    return Nested(name, tuple(attrs), Match.of(match) if match is not None else None, Modifier.of(modifier), alias)


def merge_attrs(attrs: Any) -> list:
    """One entry for each name; projections of one relation join, and its filters must agree."""
    out: dict[str, Any] = {}
    for a in attrs:
        if not isinstance(a, (str, Nested)):
            raise ModelError(f"an attribute is a name or nested(...): {a!r}")
        if isinstance(a, str):
            out.setdefault(a, a)
            continue
        key = a.alias or a.name
        b = out.get(key)
        if isinstance(b, Nested):
            if (b.match, b.modifier) != (a.match, a.modifier):
                raise ModelError(f"{key} is asked for twice with different filters")
            a = Nested(a.name, tuple(merge_attrs([*b.attrs, *a.attrs])), a.match, a.modifier, a.alias)
        out[key] = a
    return list(out.values())


def ordering(cat: Catalog, entity: str, df: DataFrame, m: Modifier) -> tuple[DataFrame, list[Column]]:
    """df with the columns to order by joined, and the order."""
    keys, seen = [], set()
    for path, way in m.order_by:
        hops, where, _ = resolve(cat, entity, tuple(path.split(".")))
        if any(end.many for _, end in hops):
            raise ModelError(f"{path}: no order over a relation to many")
        if any(end.relation.base for _, end in hops):
            raise ModelError(f"{path}: no order over a filtered relation")
        for p, end in hops:
            if p not in seen:
                df = join_hop(cat, df, p[:-1], p, end)
                seen.add(p)
        c = column(where, path.split(".")[-1])
        keys.append(c.asc_nulls_last() if way == "asc" else c.desc_nulls_last())
    return df, [*keys, F.col("id").asc_nulls_last()]


def find(cat: Catalog, entity: str, match: Any = None, modifier: Any = None, attrs: Any = (ALL,)) -> DataFrame:
    """The records of an entity or view for which the predicate is true, each once, paged and projected.

    Paging is of records: predicates over relations to many are semi joins and never multiply them."""
    m = Modifier.of(modifier)
    df = cat.scan(entity)
    own = df.columns
    if match is not None:
        df = restrict(cat, entity, df, Match.of(match))
    if m.order_by or m.limit is not None or m.offset is not None:
        df, keys = ordering(cat, entity, df, m)
        df = df.orderBy(*keys)
        df = df.offset(m.offset) if m.offset else df
        df = df.limit(m.limit) if m.limit is not None else df
        df = df.select(*[F.col(f"`{c}`") for c in own])
    return project(cat, entity, df, merge_attrs(attrs))


def find_one(cat: Catalog, entity: str, match: Any = None, modifier: Any = None, attrs: Any = (ALL,)) -> DataFrame:
    m = Modifier.of(modifier)
    return find(cat, entity, match, Modifier(m.order_by, 1, m.offset), attrs)


def find_relation(cat: Catalog, relation: str, match: Any = None, attrs: Any = (ALL,)) -> DataFrame:
    """Links as records: id, source and target as structs of the asked attributes, and properties."""
    r = cat.relations[relation]
    links = cat.links(r)
    if match is not None:
        links = restrict_links(cat, r, links, Match.of(match))
    out = [F.col("id")]
    for a in merge_attrs(attrs):
        if a == ALL:
            out += [F.col(c) for c in links.columns if c not in ("id", "source", "target")]
        elif isinstance(a, str):
            out.append(F.col(a))
        elif a.name in ("source", "target"):
            side = project(cat, r.source if a.name == "source" else r.target, cat.scan(r.source if a.name == "source" else r.target), merge_attrs(a.attrs))
            links = links.join(side.select(F.col("id").alias(f"_{a.name}"), F.struct(*side.columns).alias(f"_{a.name}_s")), F.col(a.name) == F.col(f"_{a.name}"), "left")
            out.append(F.col(f"_{a.name}_s").alias(a.name))
        else:
            raise ModelError(f"{a.name} is not a side of {relation}")
    return links.select(*out)


def project(cat: Catalog, entity: str, df: DataFrame, attrs: list, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the asked values, a struct for each relation to one and an array for each to many. keep: columns of df that stay and,
    with id, identify its rows."""
    values, keys = ["id"], [*keep, "id"]
    declared = cat.properties(entity)
    for a in attrs:
        if a == ALL:
            values += [p for p in declared if p in df.columns and p not in values]
            values += [c for c in ("__type",) if c in df.columns and c not in values]
        elif isinstance(a, str) and a not in values:
            if a not in df.columns:
                raise ModelError(f"{entity} has no {a}")
            values.append(a)
    out = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, *values])])
    for a in attrs:
        if not isinstance(a, Nested):
            continue
        alias = a.alias or a.name
        if a.name == LINK:
            cols = [c for c in df.columns if c.startswith(name_of((LINK,), ""))]
            want = cols if ALL in a.attrs else [name_of((LINK,), x) for x in a.attrs]
            link = df.select(*[F.col(f"`{k}`") for k in keys], F.struct(*[F.col(f"`{c}`").alias(c.split(name_of((LINK,), ""))[1]) for c in want]).alias(LINK))
            out = out.join(link, keys, "left")
            continue
        end = cat.end(entity, a.name)
        if end is None:
            raise ModelError(f"{a.name} is not a relation of {entity}")
        out = _attach(cat, out, df, a, alias, end, keys)
    return out


def _attach(cat: Catalog, out: DataFrame, df: DataFrame, a: Nested, alias: str, end: End, keys: list[str]) -> DataFrame:
    up = [f"_up{i}" for i in range(len(keys))]
    fk = fk_of(cat, end)
    own = [F.col(f"`{k}`").alias(u) for k, u in zip(keys, up)]
    if fk and fk[0] == "here":
        child = df.select(*own, F.col(fk[1]).alias("_fk")).distinct().join(cat.scan(end.target), F.col("_fk") == F.col("id")).drop("_fk")
    elif len(keys) == 1:  # the hop has the parent's id; the final join keeps parents only
        child = hop_rows(cat, end).withColumnRenamed("_src", up[0])
    else:
        child = df.select(*own, F.col("id").alias("_id")).join(hop_rows(cat, end), F.col("_id") == F.col("_src")).drop("_id", "_src")
    if a.match is not None:
        child = restrict(cat, end.target, child, a.match, [*up, "id"])
    attrs = merge_attrs(a.attrs)
    if not end.many:
        item = project(cat, end.target, child, attrs, tuple(up))
        item = item.select(*[F.col(u) for u in up], F.struct(*[F.col(f"`{c}`") for c in item.columns if c not in up]).alias(alias))
        return _back(out, item, keys, up)
    ordered, order = ordering(cat, end.target, child, a.modifier)
    by = Window.partitionBy(*up).orderBy(*order)
    ranked = ordered.withColumn("_n", F.row_number().over(by)).select(*[F.col(f"`{c}`") for c in child.columns], "_n")
    low = a.modifier.offset or 0
    if low or a.modifier.limit is not None:
        ranked = ranked.filter((F.col("_n") > low) & (F.col("_n") <= (low + a.modifier.limit if a.modifier.limit is not None else 2**31 - 1)))
    item = project(cat, end.target, ranked, attrs, (*up, "_n"))
    item = item.select(*[F.col(u) for u in up], F.struct("_n", F.struct(*[F.col(f"`{c}`") for c in item.columns if c not in (*up, "_n")]).alias("x")).alias("_s"))
    item = item.groupBy(*up).agg(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["x"]).alias(alias))
    kind = item.schema[alias].dataType
    done = _back(out, item, keys, up)
    return done.withColumn(alias, F.coalesce(alias, F.array().cast(kind)))


def _back(out: DataFrame, item: DataFrame, keys: list[str], up: list[str]) -> DataFrame:
    item = item.select(*[F.col(u).alias(f"_b{u}") for u in up], *[c for c in item.columns if c not in up])
    on = [F.col(f"`{k}`") == F.col(f"_b{u}") for k, u in zip(keys, up)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return out.join(item, cond, "left").drop(*[f"_b{u}" for u in up])


def policy_view(cat: Catalog, entity: str, policy: dict, match: Any = None, modifier: Any = None, attrs: Any = (ALL,), user: Any = None) -> DataFrame:
    """A query under a data policy: its predicate (a function of the user, if one) holds besides the caller's, its projection
    replaces the caller's, its modifier wins; a caller of a policy with a limit may not set offset or order."""
    fixed = policy.get("match")
    fixed = fixed(user) if callable(fixed) else fixed
    both = [Match.of(x) for x in (fixed, match) if x is not None]
    mine, theirs = dict(policy.get("modifier") or {}), dict(modifier or {})
    if mine.get("limit") is not None and {"offset", "order_by"} & set(theirs):
        raise ModelError("the policy pins the limit; offset and order_by can't be set")
    cond = both[0].and_(both[1]) if len(both) == 2 else both[0] if both else None
    return find(cat, entity, cond, {**theirs, **mine}, policy.get("attrs") or attrs)


def _steps(cat: Catalog, entity: str, prop: str) -> DataFrame:
    """(_from, _to): the links of a relation that leads from an entity to itself."""
    end = cat.end(entity, prop)
    if end is None:
        raise ModelError(f"{prop} is not a relation of {entity}")
    fk = fk_of(cat, end)
    return cat.scan(entity).filter(F.col(fk[1]).isNotNull()).select(F.col("id").alias("_from"), F.col(fk[1]).alias("_to")) if fk and fk[0] == "here" else hop_rows(cat, end, False).select(F.col("_src").alias("_from"), F.col("id").alias("_to"))


def traverse(cat: Catalog, entity: str, prop: str, start: Any = None, max_depth: int = 32, stop: Callable[[dict[str, Column]], Column] | None = None) -> DataFrame:
    """(root, depth, id, path): records reached from each root by repeating one relation; a record already on the path is not
    entered again, and what `stop` holds for (given path, depth and id columns) is not gone beyond. Depth 0 is the root itself.
    Paths that go on beyond max_depth are an error."""
    step = _steps(cat, entity, prop)
    roots = cat.scan(entity) if start is None else restrict(cat, entity, cat.scan(entity), Match.of(start))
    level = roots.select(F.col("id").alias("root"), F.lit(0).alias("depth"), "id", F.array("id").alias("path"))
    # each level is a table, so that neither the plan nor the work grows with the depth
    spark, folder, kind, parts = cat.spark, shared_folder(cat.spark, "traverse"), level.schema, []
    for d in range(max_depth + 2):
        parts.append(f"{folder}/level-{d:03d}")
        level.write.parquet(parts[-1])
        level = spark.read.schema(kind).parquet(parts[-1])
        if level.isEmpty():
            break
        if d > max_depth:
            raise ModelError(f"{entity}.{prop} goes deeper than {max_depth}")
        go = level if stop is None else level.filter(~F.coalesce(stop({"path": F.col("path"), "depth": F.col("depth"), "id": F.col("id")}), F.lit(False)))
        level = go.join(step, F.col("id") == F.col("_from")).filter(~F.array_contains("path", F.col("_to")))
        level = level.select("root", (F.col("depth") + 1).alias("depth"), F.col("_to").alias("id"), F.concat("path", F.array("_to")).alias("path"))
    return spark.read.schema(kind).parquet(*parts)


def find_path(cat: Catalog, entity: str, prop: str, start: Any, goal: Any, max_depth: int = 1000) -> DataFrame:
    """(path, length): the shortest path from one id to another by repeating a relation, of several the first in order of ids; no row
    if there is none; an error if it would be longer than max_depth.

    Breadth first: a record is entered once, from the least of the records before it on a least path, so the work is that of the links met, however
    many paths there are. Each level is a table."""
    spark, step, folder = cat.spark, _steps(cat, entity, prop), shared_folder(cat.spark, "path")
    known = restrict(cat, entity, cat.scan(entity), Match.atom("id", "=", start)).select("id", F.array("id").alias("path"))
    kind, parts = known.schema, []
    found = lambda df: df.filter(F.col("id") == F.lit(goal)).select("path", (F.size("path") - 1).alias("length")).limit(1)
    for d in range(max_depth + 2):
        parts.append(f"{folder}/level-{d:05d}")
        known.write.parquet(parts[-1])
        level = spark.read.schema(kind).parquet(parts[-1])
        hit = found(level)
        if level.isEmpty() or not hit.isEmpty():
            return hit
        if d > max_depth:
            raise ModelError(f"no path of up to {max_depth} steps, and more records ahead")
        seen = spark.read.schema(kind).parquet(*parts).select(F.col("id").alias("_to"))
        ahead = level.join(step, F.col("id") == F.col("_from")).join(seen, "_to", "left_anti")
        known = ahead.groupBy(F.col("_to").alias("id")).agg(F.min("path").alias("path")).select("id", F.concat("path", F.array("id")).alias("path"))
    return hit


def recursive(cat: Catalog, entity: str, prop: str, attrs: Any = (ALL,), depth: int = 3) -> Nested:
    """A projection that goes back to itself `depth` times: nested(prop, attrs + nested(prop, ...))."""
    n = nested(prop, attrs)
    for _ in range(depth - 1):
        n = nested(prop, (*attrs, n))
    return n


__all__ = ["ALL", "Atom", "Modifier", "Nested", "find", "find_one", "find_path", "find_relation", "many_paths", "nested", "oriented_links", "policy_view", "project", "recursive", "traverse"]
