"""Change logs: snapshot differences, view membership, event patterns, application of patches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: str = "id", columns: list[str] | None = None) -> DataFrame:
    """(key, op, keys, old, new): one row for each record that was created, updated or deleted between two snapshots. keys are
    the changed columns, in their order."""
    cols = columns or [c for c in new.columns if c != key]
    a = old.select(F.col(key), F.struct(*cols).alias("old"))
    b = new.select(F.col(key), F.struct(*cols).alias("new"))
    j = a.join(b, key, "full")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")), F.lit(c)) for c in cols]))
    op = F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "delete").otherwise("update")
    out = j.select(key, op.alias("op"), F.when(op == "update", changed).alias("keys"), "old", "new")
    return out.filter((F.col("op") != "update") | (F.size("keys") > 0))


def membership(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(key, event): create for records that enter a view, delete for those that leave it."""
    a, b = before.select(key).distinct(), after.select(key).distinct()
    enter = b.join(a, key, "left_anti").withColumn("event", F.lit("create"))
    leave = a.join(b, key, "left_anti").withColumn("event", F.lit("delete"))
    return enter.unionAll(leave)


def touches(keys: Column, attributes: list[str]) -> Column:
    """Whether an update changed one of the attributes that a view depends on."""
    return F.arrays_overlap(keys, F.array(*[F.lit(a) for a in attributes]))


def merged_view(log: DataFrame) -> Column:
    """The record of an event: what it wrote over the old image. A created record is all new, a deleted one all old; an update wrote
    its `keys`, also where the new value is null (without a column `keys`: all of the new image)."""
    fields, written = log.schema["new"].dataType.names, "keys" in log.columns
    wrote = lambda f: F.col("old").isNull() | (F.col("new").isNotNull() & (F.coalesce(F.array_contains("keys", f), F.lit(True)) if written else F.lit(True)))
    return F.struct(*[F.when(wrote(f), F.col(f"new.{f}")).otherwise(F.col(f"old.{f}")).alias(f) for f in fields])


def pattern(p: dict, record: str = "record", old: str = "old", op: str = "op", keys: str = "keys") -> Column:
    """The predicate of an event pattern {type, keys, record: {..}, old: {..}}; nested mappings match fields of structs."""
    parts: list[Column] = []
    if p.get("type"):
        parts.append(F.col(op).isin(*p["type"]) if isinstance(p["type"], (list, tuple)) else F.col(op) == p["type"])
    if p.get("keys"):
        parts += [F.coalesce(F.array_contains(keys, k), F.lit(False)) for k in p["keys"]]

    def deep(at: str, want: dict) -> None:
        for k, v in want.items():
            if isinstance(v, dict):
                deep(f"{at}.{k}", v)
            else:
                parts.append(F.col(f"{at}.{k}").eqNullSafe(F.lit(v)))

    deep(record, p.get("record", {}))
    deep(old, p.get("old", {}))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def apply_patch(current: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """current after a patch with columns of current and `op` (insert, update, delete). An update writes all the patch's columns, nulls
    too, or, where the patch has an array `keys`, those named there."""
    cols = [c for c in current.columns if c != key]
    has_keys = "keys" in patch.columns and "keys" not in current.columns
    p = patch.select(F.col(key), F.col("op").alias("_op"), *([F.col("keys").alias("_keys")] if has_keys else []), *[F.col(c).alias(f"_p_{c}") for c in cols if c in patch.columns])
    j = current.withColumn("_here", F.lit(True)).join(p, key, "full").filter(~F.coalesce(F.col("_op") == "delete", F.lit(False)))
    j = j.filter(F.col("_here") | (F.col("_op") == "insert"))
    named = lambda c: F.coalesce(F.array_contains("_keys", c), F.lit(True)) if has_keys else F.lit(True)
    wrote = lambda c: (F.col("_op") == "insert") | ((F.col("_op") == "update") & named(c))
    return j.select(key, *[F.when(wrote(c), F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c) if f"_p_{c}" in j.columns else F.col(c) for c in cols])


def dirty_hosts(changed: DataFrame, reverse: DataFrame) -> DataFrame:
    """Hosts to refresh: the changed record ids (id) carried along the reverse of a path (id, host)."""
    return changed.select("id").distinct().join(reverse, "id").select("host").distinct()


def member_change(old: Column, new: Column) -> Column:
    """entered, left or none, from a predicate on both images of a record."""
    a, b = F.coalesce(old, F.lit(False)), F.coalesce(new, F.lit(False))
    return F.when(~a & b, "entered").when(a & ~b, "left").otherwise("none")
