"""Scoped sequences, retention and latest-by-key: order within partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_folder


def scoped_sequence(df: DataFrame, scope: list[str], order: list[str], name: str = "number", initial: int = 0, step: int = 1, where: Column | None = None, manual: str | None = None) -> DataFrame:
    """Dense numbers within a scope in order of creation: initial + step, initial + 2 * step, ... Rows that don't match get none.
    A value given in `manual` is kept and takes no number. The match has two truth values: a null comparison is false.

    Rows lie in ranges of (scope, order); a row's number is its place in its range and the count of its scope in the ranges before, so
    a scope with most of the rows, or an empty one, is no one task's work. The ranges are a table, as another run may cut them elsewhere."""
    ok = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    if manual:
        ok = ok & F.col(manual).isNull()
    cols = df.columns
    parts = df.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), F.struct(*scope).alias("_scope") if scope else F.lit(0).alias("_scope"), F.struct(*order).alias("_order"), ok.alias("_ok"))
    parts = parts.repartitionByRange("_scope", "_ok", "_order").withColumn("_p", F.spark_partition_id())
    path, kind = shared_folder(df.sparkSession, "sequence"), parts.schema
    parts.write.parquet(path)
    parts = df.sparkSession.read.schema(kind).parquet(path)
    sizes = parts.filter("_ok").groupBy("_scope", "_p").agg(F.count("*").alias("_size"))
    base = sizes.select("_scope", "_p", F.coalesce(F.sum("_size").over(Window.partitionBy("_scope").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # a row for each scope in a range
    base = base.select(F.col("_scope").alias("_s"), F.col("_p").alias("_q"), "_base")
    placed = parts.withColumn("_n", F.row_number().over(Window.partitionBy("_scope", "_p", "_ok").orderBy("_order")))
    placed = placed.join(base, F.col("_scope").eqNullSafe(F.col("_s")) & (F.col("_p") == F.col("_q")), "left")
    value = F.when(F.col("_ok"), F.lit(initial) + F.lit(step) * (F.col("_base") + F.col("_n"))).cast("bigint")
    if manual:
        value = F.coalesce(F.col("_row").getField(manual), value)
    return placed.select(*[F.col("_row").getField(c).alias(c) for c in cols if c != name], value.alias(name))


def reserve(current: int, count: int, step: int = 1) -> dict[str, int]:
    """The next `count` numbers of a sequence that stands at `current`."""
    if count < 1:
        raise ValueError("at least one number")
    return {"start": current + step, "count": count, "end": current + count * step, "step": step}


def sequence_seed(df: DataFrame, scope: list[str], value: str, name: str = "seed") -> DataFrame:
    """Where each scope's sequence stands: its largest number."""
    return df.groupBy(*scope).agg(F.max(value).alias(name))


def retain_ttl(df: DataFrame, ts: str, now: Column, max_age: str) -> DataFrame:
    """Rows no older than max_age (an interval, such as "7 days") at `now`; a null time stays."""
    return df.filter(F.col(ts).isNull() | (F.col(ts) >= now - F.expr(f"INTERVAL {max_age}")))


def retain_cap(df: DataFrame, partition: list[str], keys: list[str], cap: int, key: str = "id") -> DataFrame:
    """The latest `cap` rows of each partition, keys descending with nulls last, then id descending."""
    by = Window.partitionBy(*partition).orderBy(*[F.col(k).desc_nulls_last() for k in keys], F.col(key).desc_nulls_last())
    return df.withColumn("_rank", F.row_number().over(by)).filter(F.col("_rank") <= cap).drop("_rank")


def retain(df: DataFrame, policy: dict, now: Column, key: str = "id") -> DataFrame:
    """ttl {ts, max_age} first, then cap {partition, keys, n}; {forever: True} keeps all."""
    if policy.get("forever"):
        return df
    if t := policy.get("ttl"):
        df = retain_ttl(df, t["ts"], now, t["max_age"])
    if c := policy.get("cap"):
        df = retain_cap(df, c["partition"], c["keys"], c["n"], key)
    return df


def latest_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    by = Window.partitionBy(*keys).orderBy(*[F.col(o).desc_nulls_last() for o in order])
    return df.withColumn("_rank", F.row_number().over(by)).filter(F.col("_rank") == 1).drop("_rank")
