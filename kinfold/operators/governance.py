"""Writes and what guards them: inserts, updates, cascading deletes, links, constraints, identity, idempotency, payloads."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Entity, ModelError, Property, spark_type
from ..plans.compiler import restrict
from ..plans.match import Match
from ..sources.catalog import Catalog
from ..sources.shared import shared_folder


class ConstraintError(ModelError):
    """Rows break a constraint; `kind` tells which."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


def allocate_ids(current: DataFrame, new: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """new with ids that follow the largest one in use. Numbers are dealt per partition after one count of each, not by one sorted task."""
    parts = new.drop(key) if key in new.columns else new
    parts = parts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    path, kind = shared_folder(parts.sparkSession, "ids"), parts.schema  # a table, as another run may place rows elsewhere
    parts.write.parquet(path)
    parts = parts.sparkSession.read.schema(kind).parquet(path)
    sizes = parts.groupBy("_p").count()
    base = sizes.select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # a row for each partition
    top = current.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    n = F.col("_top") + F.col("_base") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return parts.join(F.broadcast(base), "_p").crossJoin(F.broadcast(top)).withColumn(key, n).drop("_p", "_m", "_base", "_top")


def with_defaults(e: Entity, df: DataFrame, written: Column | None = None) -> DataFrame:
    """Defaults where a payload lacks a property, then computed properties from their own row.

    A column that is not there is missing in every row; `written`, an array of names, tells which ones a row has. An explicit
    null is a value: it stays."""
    names = None if written is None else "_written"
    if names:
        df = df.withColumn(names, written)
    for p in e.properties:
        d = p.default() if callable(p.default) else p.default
        value = F.lit(d).cast(spark_type(p)) if not isinstance(d, (list, dict)) else F.lit(d)
        if p.name not in df.columns:
            df = df.withColumn(p.name, value)
        elif names and d is not None:
            df = df.withColumn(p.name, F.when(F.coalesce(F.array_contains(names, p.name), F.lit(False)), F.col(p.name)).otherwise(value))
    for p in e.properties:
        if p.computed is not None:
            df = df.withColumn(p.name, p.computed(_Own(df)))
    return df.drop(names) if names else df


def with_input_defaults(inputs: dict[str, Entity], df: DataFrame, created_as: str = "__type") -> DataFrame:
    """Rows of a union created under the names of its inputs: each gets the defaults of its own input for properties that are missing."""
    for name in dict.fromkeys(p.name for e in inputs.values() for p in e.properties):
        if name in df.columns:
            continue
        value = None
        for k, e in inputs.items():
            if (p := e.property(name)) is not None:
                d = p.default() if callable(p.default) else p.default
                one = F.lit(d).cast(spark_type(p)) if not isinstance(d, (list, dict)) else F.lit(d)
                value = F.when(F.col(created_as) == k, one) if value is None else value.when(F.col(created_as) == k, one)
        df = df.withColumn(name, value)
    return df


def backfill(df: DataFrame, p: Property) -> DataFrame:
    """A new property on rows that were created before it: its default (there is no row that wrote it)."""
    if p.name in df.columns:
        raise ModelError(f"{p.name} is there already")
    return with_defaults(Entity("backfill", (p,)), df)


class _Own:
    """What a computed property may read: the columns of its own row."""

    def __init__(self, df: DataFrame):
        self.df = df

    def __getitem__(self, name: str) -> Column:
        if name not in self.df.columns or "." in name:
            raise ModelError(f"a computed property reads its own row only, not {name}")
        return F.col(name)


def check_payload(cat: Catalog, entity: str, df: DataFrame) -> None:
    """Columns that aren't declared, and writes to the type mark of a union, are refused."""
    from ..model import MergedEntity

    if isinstance(cat.entities[entity], MergedEntity):
        raise ModelError(f"{entity} is a union; create one of its inputs")
    known = {"id", *cat.properties(entity)}
    if extra := [c for c in df.columns if c not in known]:
        raise ModelError(f"{entity} has no {extra}")


def insert(current: DataFrame, new: DataFrame) -> DataFrame:
    return current.unionByName(new.select(*[c for c in current.columns if c in new.columns]), allowMissingColumns=True)


def create_graph(current: dict[str, DataFrame], new: dict[str, DataFrame], fks: dict[str, list[tuple[str, str]]]) -> dict[str, DataFrame]:
    """Insert records of several types at once; fks: type to (column, referred type). New rows must refer to rows that exist or come along."""
    out = {k: insert(current[k], df) for k, df in new.items()} | {k: v for k, v in current.items() if k not in new}
    for k, df in new.items():
        for col, to in fks.get(k, ()):
            lost = df.filter(F.col(col).isNotNull()).join(out[to].select(F.col("id").alias(col)), col, "left_anti")
            if not lost.isEmpty():
                raise ConstraintError("reference", f"{k}.{col} refers to rows of {to} that don't exist")
    return out


def update_by_match(cat: Catalog, entity: str, match: Any, values: dict[str, Column]) -> DataFrame:
    """A snapshot in which the matching records have new values."""
    df = cat.scan(entity)
    hit = restrict(cat, entity, df, Match.of(match)).select("id", F.lit(True).alias("_hit"))
    out = df.join(hit, "id", "left")
    return out.select(*[F.when(F.coalesce("_hit", F.lit(False)), v).otherwise(F.col(c)).alias(c) if (v := values.get(c)) is not None else F.col(c) for c in df.columns])


def cascade_delete(cat: Catalog, entity: str, match: Any, max_depth: int = 16) -> dict[str, DataFrame]:
    """(id, depth) of what goes, by record type: the matching records, links at them, and targets that rely on them, in turn.
    Events are ordered links, reliant targets, record."""
    gone = {entity: restrict(cat, entity, cat.scan(entity), Match.of(match)).select("id", F.lit(0).alias("depth"))}
    front = [(entity, gone[entity], 0)]
    while front:
        name, ids, depth = front.pop(0)
        if depth >= max_depth:
            raise ModelError("reliance goes too deep")
        for r in cat.relations.values():
            if r.base:
                continue
            sides = [s for s, e in (("source", r.source), ("target", r.target)) if cat.base_of(e) == cat.base_of(name)]
            if not sides:
                continue
            links = cat.links(r)
            for s in sides:
                at = links.join(ids.select(F.col("id").alias(s)), s, "left_semi")
                cut = at.select("id", F.lit(depth).alias("depth"))
                gone[r.name] = gone[r.name].unionAll(cut).groupBy("id").agg(F.min("depth").alias("depth")) if r.name in gone else cut
                if r.reliance and s == "source":
                    down = at.select(F.col("target").alias("id")).distinct().withColumn("depth", F.lit(depth + 1))
                    gone[r.target] = gone[r.target].unionAll(down).groupBy("id").agg(F.min("depth").alias("depth")) if r.target in gone else down
                    front.append((r.target, down, depth + 1))
    return gone


def deletion_events(gone: dict[str, DataFrame], relations: set[str]) -> DataFrame:
    """(step, record, id) of a cascade in the order of its events: the links of a record, then what relies on it (each with its own
    links first), then the record."""
    deep = 1 + max((int(r[0]) for df in gone.values() for r in df.agg(F.coalesce(F.max("depth"), F.lit(0))).collect()), default=0)  # a row for each type
    out = None
    for name, df in sorted(gone.items()):
        step = F.col("depth") if name in relations else F.lit(2 * deep) - F.col("depth")
        part = df.select(step.cast("int").alias("step"), F.lit(name).alias("record"), F.col("id").cast("string").alias("id"))
        out = part if out is None else out.unionAll(part)
    return out


def null_out(cat: Catalog, entity: str, match: Any, columns: list[str]) -> DataFrame:
    """A snapshot in which some columns of the matching records are null."""
    kinds = dict(cat.scan(entity).dtypes)
    return update_by_match(cat, entity, match, {c: F.lit(None).cast(kinds[c]) for c in columns})


def guard_scope(old: DataFrame, new: DataFrame, scope: list[str], number: str, key: str = "id") -> DataFrame:
    """new, unless a record that has a number in a sequence would move to another scope."""
    j = old.filter(F.col(number).isNotNull()).select(key, F.struct(*scope).alias("_a")).join(new.select(key, F.struct(*scope).alias("_b")), key)
    if not j.filter(~F.col("_a").eqNullSafe(F.col("_b"))).isEmpty():
        raise ConstraintError("scope", f"{scope} can't change once {number} is given")
    return new


def delete(df: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return df.join(gone.select(key), key, "left_anti")


def hard_delete(df: DataFrame, flag: str = "_isDeleted_") -> DataFrame:
    """Records whose deletion mark became true go."""
    return df.filter(~F.coalesce(F.col(flag), F.lit(False)))


def add_links(links: DataFrame, new: DataFrame, type_: str = "n:n") -> DataFrame:
    """Links with new ones (source, target, properties, order column `seq`). A pair is unique: a repeat is an error. On a side to one, the
    latest link replaces earlier ones."""
    both = links.withColumn("seq", F.lit(None).cast("bigint")).unionByName(new, allowMissingColumns=True)
    twice = both.groupBy("source", "target").count().filter("count > 1")
    if not twice.isEmpty():
        raise ConstraintError("link", "a pair is linked twice")
    left, right = type_.split(":")
    for side, many in (("target", left), ("source", right)):
        if many == "1":
            both = both.withColumn("_r", F.row_number().over(Window.partitionBy(side).orderBy(F.col("seq").desc_nulls_last()))).filter("_r = 1").drop("_r")
    return both.drop("seq")


def replace_links(links: DataFrame, new: DataFrame, side: str = "source") -> DataFrame:
    """The sets of links of some sources replaced: all their old links go, the new ones come."""
    return links.join(new.select(side).distinct(), side, "left_anti").select(*links.columns).unionByName(new.select(*[c for c in links.columns if c in new.columns]), allowMissingColumns=True)


_WHERE: dict[str, Callable[[Column, Any], Column]] = {"isNull": lambda c, v: c.isNull(), "isNotNull": lambda c, v: c.isNotNull(), "equals": lambda c, v: c == v, "notEquals": lambda c, v: c != v, "in": lambda c, v: c.isin(*v), "notIn": lambda c, v: ~c.isin(*v)}


def unique_violations(df: DataFrame, columns: list[str], where: list[tuple[str, str, Any]] | None = None) -> DataFrame:
    """(columns, n): keys that more than one row has, among rows that meet the filter; keys with nulls don't collide."""
    for c, op, v in where or ():
        df = df.filter(_WHERE[op](F.col(c), v))
    for c in columns:
        df = df.filter(F.col(c).isNotNull())
    return df.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def non_null_violations(df: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """(key, column): cells that must not be null and are."""
    bad = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return df.select(F.col(key), F.explode(bad).alias("column"))


def enforce(df: DataFrame, unique: list[list[str]] = (), non_null: list[str] = ()) -> DataFrame:
    for cols in unique:
        if not unique_violations(df, cols).isEmpty():
            raise ConstraintError("unique", f"{cols} repeat")
    if non_null and not non_null_violations(df.withColumn("id", F.lit(0)) if "id" not in df.columns else df, list(non_null)).isEmpty():
        raise ConstraintError("non_null", f"nulls in {list(non_null)}")
    return df


def insert_ignore(current: DataFrame, new: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """The rows of `new` that are created under a natural key: known keys are observed, not created; of several new rows with one
    key the first is. A missing part of a key is an error."""
    if not new.filter(" or ".join(f"`{c}` is null" for c in identity)).isEmpty():
        raise ConstraintError("identity", f"a part of {identity} is null")
    first = F.row_number().over(Window.partitionBy(*identity).orderBy(*order))
    return new.withColumn("_r", first).filter("_r = 1").drop("_r").join(current.select(*identity), identity, "left_anti").select(*new.columns)


def idempotent(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first event of each idempotency key; repeats are answered with it."""
    return events.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")


def payload_errors(payload: DataFrame, fields: list[dict], key: str = "id", refs: dict[str, DataFrame] | None = None) -> DataFrame:
    """(key, field, error) for payload columns that are required but null, have the wrong type, or refer to records that don't exist."""
    out = None
    for f in fields:
        bad = []
        if f.get("required"):
            bad.append(payload.filter(F.col(f["name"]).isNull()).select(F.col(key), F.lit(f["name"]).alias("field"), F.lit("required").alias("error")))
        if f.get("type"):
            want = spark_type(Property(f["name"], f["type"], f.get("collection", False)))
            bad.append(payload.filter(F.col(f["name"]).isNotNull() & F.expr(f"try_cast(`{f['name']}` as {want})").isNull()).select(F.col(key), F.lit(f["name"]).alias("field"), F.lit("type").alias("error")))
        if f.get("ref"):
            known = refs[f["ref"]].select(F.col("id").alias(f["name"]))
            bad.append(payload.filter(F.col(f["name"]).isNotNull()).join(known, f["name"], "left_anti").select(F.col(key), F.lit(f["name"]).alias("field"), F.lit("ref").alias("error")))
        for b in bad:
            out = b if out is None else out.unionAll(b)
    return out


def guard(events: DataFrame, condition: Any, tests: dict[str, Callable[[], Column]]) -> tuple[DataFrame, DataFrame]:
    """(admitted, refused) events by a boolean tree of named conditions."""
    from ..plans.boolexp import BoolExp

    exp = BoolExp.parse(condition) if isinstance(condition, str) else BoolExp.of(condition)
    ok = F.coalesce(exp.fold(lambda n: F.coalesce(tests[n](), F.lit(False)), lambda a, b: a & b, lambda a, b: a | b, lambda a: ~a), F.lit(False))
    return events.filter(ok), events.filter(~ok)


def visible(events: DataFrame, table: DataFrame, on: dict[str, str], name: str) -> DataFrame:
    """events with a flag that a guard condition may read: whether the table, as it stands when the batch is admitted, has a row whose columns are
    equal to the event's (event column to table column). The flag doesn't change with what the batch itself writes."""
    seen = table.select(*[F.col(c).alias(f"_v{k}") for k, c in enumerate(on.values())]).distinct().withColumn(name, F.lit(True))
    cond = [F.col(f"`{c}`") == F.col(f"_v{k}") for k, c in enumerate(on)]
    return events.join(seen, cond, "left").select(*[F.col(f"`{c}`") for c in events.columns], F.coalesce(F.col(name), F.lit(False)).alias(name))


def dispatch(
    events: DataFrame,
    log: DataFrame,
    key: list[str],
    order: list[str],
    admit: Column | None = None,
    map_data: Callable[[DataFrame], DataFrame] | None = None,
    *,
    open_: Callable[[DataFrame], DataFrame] | None = None,
    resolve: Callable[[DataFrame], DataFrame] | None = None,
    after: Callable[[dict[str, DataFrame]], DataFrame] | None = None,
    post_commit: list[Callable[[dict[str, DataFrame]], None]] = (),
    commit: Callable[[dict[str, DataFrame]], None] | None = None,
) -> dict[str, DataFrame]:
    """A batch through the dispatch steps: repeats of keys already logged or within the batch are replayed, the rest admitted or refused,
    opened (which may add what later steps need), resolved, mapped and appended to the log.

    after: from created, refused, replayed and log, what the dispatch answers ("answer"). commit writes the result; post_commit effects run once
    it has, each by itself: those that fail are named in the error that follows, as the data are committed, and may be run again (`rerun`)."""
    first = idempotent(events, key, order).join(log.select(*key), key, "left_anti").select(*events.columns)
    ok = F.lit(True) if admit is None else F.coalesce(admit, F.lit(False))
    new = first.filter(ok)
    for step in (open_, resolve, map_data):
        new = step(new) if step else new
    replay = events.join(log.select(*key).distinct(), key, "left_semi")
    out = {"created": new, "refused": first.filter(~ok), "replayed": replay, "log": insert(log, new)}
    if after:
        out["answer"] = after(out)
    if commit:
        commit(out)
    rerun(out, post_commit)
    return out


class EffectError(ModelError):
    """Effects that failed after a commit; `failed` are those to run again."""

    def __init__(self, failed: list[tuple[Callable, Exception]]):
        super().__init__("; ".join(f"{getattr(f, '__name__', f)}: {e}" for f, e in failed))
        self.failed = [f for f, _ in failed]


def rerun(result: dict[str, DataFrame], effects: list[Callable[[dict[str, DataFrame]], None]]) -> None:
    """Run effects; one that fails doesn't keep the others from running."""
    failed = []
    for f in effects:
        try:
            f(result)
        except Exception as e:  # reported below
            failed.append((f, e))
    if failed:
        raise EffectError(failed)
