"""Transforms, real-time values, custom computations and task queues."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import ModelError
from .changes import apply_patch


def transform(df: DataFrame, key: str, rows: Callable[[Callable[[str], Column]], Column | list[Column]]) -> DataFrame:
    """Each record to no, one or more rows: structs, null ones dropped. Rows are known by (source_id, transform_index)."""
    made = rows(F.col)
    arr = F.array(*made) if isinstance(made, list) else made
    if df.select(arr.alias("x")).schema["x"].dataType.typeName() != "array":
        arr = F.array(arr)
    out = df.select(F.col(key).alias("source_id"), F.posexplode(arr).alias("transform_index", "r")).filter(F.col("r").isNotNull())
    return out.select("source_id", "transform_index", "r.*")


def transform_patch(old: DataFrame, new: DataFrame) -> DataFrame:
    """What turns one output of a transform into another: rows by (source_id, transform_index) with op insert, update or delete."""
    keys = ["source_id", "transform_index"]
    cols = [c for c in new.columns if c not in keys]
    a = old.select(*keys, F.struct(*cols).alias("a"))
    b = new.select(*keys, F.struct(*cols).alias("b"))
    j = a.join(b, keys, "full")
    op = F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "delete").when(~F.col("a").eqNullSafe(F.col("b")), "update")
    return j.withColumn("op", op).filter(F.col("op").isNotNull()).select(*keys, "op", *[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in cols])


def transform_events(events: DataFrame, where: Column, columns: list[Column]) -> DataFrame:
    """A row for each event that the pattern matches; works on a stream as well."""
    return events.filter(where).select(*columns)


def real_time(df: DataFrame, now: Column, value: Callable[[Column], Column], next_time: Callable[[Column], Column] | None = None, name: str = "value") -> DataFrame:
    """A value that depends on the time, given as `now`, and when it is to be computed next."""
    out = df.withColumn(name, value(now))
    return out.withColumn(f"{name}_next", next_time(now)) if next_time else out


def crossing(a: Column, b: Column, target: Column) -> Column:
    """When a + b * t reaches target: the time at which an inequality changes or an equation holds; null if it never does."""
    return F.when(b != 0, (target - a) / b)


@dataclass(frozen=True)
class Custom:
    """A computation from functions of frames.

    compute(deps, state) gives the value in full; incremental(deps, last, changes, state) from the last value and what changed;
    incremental_patch(deps, last, changes, state) only what changes about it, as rows with op (insert, update, delete). A function may give
    (value, state): what it wants to have next time. initial() is the value while nothing is there to compute from, create_state() the first
    state. kind: global, entity or property; a property's value has a row for each host."""

    compute: Callable[..., Any]
    incremental: Callable[..., Any] | None = None
    incremental_patch: Callable[..., Any] | None = None
    initial: Callable[[], DataFrame] | None = None
    create_state: Callable[[], DataFrame] | None = None
    kind: str = "global"
    reads: tuple[str, ...] = ()
    key: str = "id"

    def __post_init__(self):
        if self.kind not in ("global", "entity", "property"):
            raise ModelError(f"{self.kind} is not a kind of computation")
        if self.kind == "property" and any(r != "host" for r in self.reads):
            raise ModelError("a property is computed from its host; a set of records calls for a global or an entity")

    def run(self, deps: dict[str, DataFrame], last: DataFrame | None = None, changes: dict[str, DataFrame] | None = None, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
        """(value, state) by the cheapest way that there is: patch, incremental, full."""
        if state is None and self.create_state is not None:
            state = self.create_state()
        if not deps and self.initial is not None:
            return self.initial(), state
        again = last is not None and changes is not None
        if again and self.incremental_patch is not None:
            patch, state = self._both(self.incremental_patch(deps, last, changes, state), state)
            return apply_patch(last, patch, self.key), state
        if again and self.incremental is not None:
            return self._both(self.incremental(deps, last, changes, state), state)
        return self._both(self.compute(deps, state), state)

    @staticmethod
    def _both(got: Any, state: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
        return got if isinstance(got, tuple) else (got, state)


def settle_tasks(tasks: DataFrame, fresh: list[str], key: str = "id") -> DataFrame:
    """Finished tasks: the latest of each freshness key is applied, earlier ones are skipped; pending ones stay."""
    last = F.max(F.when(F.col("status") == "success", F.col(key))).over(Window.partitionBy(*fresh))
    done = F.when(F.col(key) == last, "applied").otherwise("skipped")
    return tasks.withColumn("status", F.when(F.col("status") == "success", done).otherwise(F.col("status")))


def clean_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks without those that are over."""
    return tasks.filter(~F.col("status").isin("applied", "skipped"))
