"""Sources and sinks: parquet directories, JDBC tables, event sources, key-value tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Dictionary, Entity, ModelError
from ..functions.values import canonical_json


def read_parquet(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 32, **options: str) -> DataFrame:
    """A table of a relational database (SQLite, PostgreSQL, MySQL, ...), read in parallel over ranges of a numeric key."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if key and bounds:
        r = r.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return r.load()


class QueryLog:
    """What was asked: name, time and plan of each statement, appended as rows to a table."""

    def __init__(self, path: str):
        self.path = path

    def run(self, name: str, df: DataFrame) -> DataFrame:
        """df, once its statement is logged."""
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        one = df.sparkSession.createDataFrame([(name, plan)], "name string, plan string").withColumn("at", F.current_timestamp())
        one.coalesce(1).write.mode("append").parquet(self.path)
        return df


def write_jdbc(df: DataFrame, url: str, name: str, mode: str = "append", **options: str) -> None:
    """Rows into a table of a relational database, from all partitions at once."""
    df.write.format("jdbc").option("url", url).option("dbtable", name).options(**options).mode(mode).save()


def ddl(cat: Any, using: str = "parquet") -> dict[str, str]:
    """CREATE TABLE statements for the stored entities and link tables of a catalog, by name."""
    out = {}
    for n, e in cat.entities.items():
        if isinstance(e, Entity):
            fields = [("id", dict(cat.scan(n).dtypes)["id"]), *[(c, t) for c, t in cat.scan(n).dtypes if c != "id"]]
            out[n] = f"CREATE TABLE `{n}` (" + ", ".join(f"`{c}` {t}{' NOT NULL' if c == 'id' else ''}" for c, t in fields) + f") USING {using}"
    for n, r in cat.relations.items():
        if not r.base:
            out[n] = f"CREATE TABLE `{n}` (" + ", ".join(f"`{c}` {t}{' NOT NULL' if c in ('source', 'target') else ''}" for c, t in cat.links(r).dtypes) + f") USING {using}"
    return out


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


@dataclass(frozen=True)
class EventSource:
    """Where events of one kind come from: which entity logs them, who is admitted, how they are mapped, what tells repeats apart."""

    name: str
    entity: str
    admit: Callable[[DataFrame], Column] | None = None
    map_data: Callable[[DataFrame], DataFrame] | None = None
    key: tuple[str, ...] = ()
    open_: Callable[[DataFrame], DataFrame] | None = None
    resolve: Callable[[DataFrame], DataFrame] | None = None
    after: Callable[[dict[str, DataFrame]], DataFrame] | None = None
    post_commit: tuple[Callable[[dict[str, DataFrame]], None], ...] = ()

    def take(self, events: DataFrame) -> DataFrame:
        """The rows to log; works on batches and streams."""
        if self.admit is not None:
            events = events.filter(F.coalesce(self.admit(events), F.lit(False)))
        for step in (self.open_, self.resolve, self.map_data):
            events = step(events) if step else events
        return events

    def dispatch(self, events: DataFrame, log: DataFrame, order: list[str], commit: Callable[[dict[str, DataFrame]], None] | None = None) -> dict[str, DataFrame]:
        """A batch through all steps of this source (see governance.dispatch)."""
        from ..operators.governance import dispatch

        admit = self.admit(events) if self.admit else None
        return dispatch(events, log, list(self.key), order, admit, self.map_data, open_=self.open_, resolve=self.resolve, after=self.after, post_commit=list(self.post_commit), commit=commit)


class KeyValues:
    """Dictionaries and system values: (concept, key, value as canonical JSON), unique on concept and key."""

    def __init__(self, df: DataFrame):
        self.df = df

    @staticmethod
    def empty(spark: SparkSession) -> KeyValues:
        return KeyValues(spark.createDataFrame([], "concept string, key string, value string"))

    def set(self, concept: str, key: str, value: Any) -> KeyValues:
        spark = self.df.sparkSession
        new = spark.createDataFrame([(concept, key, canonical_json({"raw": value}))], "concept string, key string, value string")
        return KeyValues(self.df.filter(~((F.col("concept") == concept) & (F.col("key") == key))).unionAll(new))

    def get(self, concept: str, key: str, default: Any = None) -> Any:
        import json

        row = self.df.filter((F.col("concept") == concept) & (F.col("key") == key)).select("value").head()
        return default if row is None else json.loads(row[0])["raw"]

    def dictionary(self, d: Dictionary) -> Any:
        return self.get("dictionary", d.name, d.default() if callable(d.default) else d.default)


def parse_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON text column as a typed one."""
    return df.withColumn(column, F.from_json(column, schema))


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ModelError(f"columns are missing: {missing}")
    return df
