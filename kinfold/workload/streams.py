"""Streams over the events table, run until all of it is taken; their sinks are tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregations as A
from ..sources.shared import shared_folder
from ..sources.tables import EventSource
from ..streaming import jobs
from .derived import _MACHINE_SQL, MACHINE

Query = Callable[[SparkSession, str], DataFrame]
Q: dict[str, tuple[Query, str]] = {}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(kind).parquet(f"{sf_dir}/events*.parquet")


def last_batch(stream: DataFrame, mode: str, schema_of: DataFrame | None = None) -> DataFrame:
    """The last output of a stream in complete mode, or all of it in append and update mode."""
    spark, path = stream.sparkSession, shared_folder(stream.sparkSession, "stream")

    def write(b: DataFrame, n: int) -> None:
        b.write.mode("overwrite").parquet(f"{path}/out" if mode == "complete" else f"{path}/out/batch={n}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


def stream_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = last_batch(jobs.windowed(events(spark, sf_dir), "ts", "2 days", "1 day", ["event_type"], [F.count("*").alias("n")]), "complete")
    return out.select(F.to_date("window.start").alias("day"), "event_type", "n")


def stream_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = EventSource("purchases", "Purchase", lambda e: F.col("event_type") == "purchase", lambda e: e.select("event_id", "user_id", (F.col("value") * 2).alias("points")))
    return last_batch(source.take(events(spark, sf_dir)), "append").drop("batch")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which event of a key comes first depends on the order of files, so the keys are the result."""
    return last_batch(jobs.first_of_key(events(spark, sf_dir), ["user_id", "event_type"], "ts", "60 days"), "append").select("user_id", "event_type")


def stream_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table is one batch here, so each user has one row."""
    return last_batch(jobs.run_machine(events(spark, sf_dir).select("user_id", "ts", "event_type"), MACHINE, "user_id", "ts", "event_type"), "update").select("user_id", "state")


def stream_maintained_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, agg = shared_folder(spark, "state"), A.Summation(("value",))
    items = lambda d: d.select(F.col("user_id").alias("host"), *[c.alias(k) for k, c in agg.states(A.Item({"value": F.col("value")}, {})).items()])
    batches: list[int] = []

    def split(b: DataFrame) -> tuple[DataFrame, DataFrame]:
        batches.append(1)
        return items(b.limit(0)), items(b)

    jobs.maintain(events(spark, sf_dir), f"{path}/versions", split, f"{path}/checkpoint", lambda s: s.createDataFrame([], "host bigint, s double")).awaitTermination()
    return spark.read.parquet(f"{path}/versions/v{len(batches) - 1}").select(F.col("host").alias("user_id"), F.round("s", 2).alias("s"))


Q["stream_windowed"] = (stream_windowed, "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
Q["stream_transform"] = (stream_transform, "SELECT event_id, user_id, value * 2 AS points FROM events WHERE event_type = 'purchase'")
Q["stream_dedup"] = (stream_dedup, "SELECT DISTINCT user_id, event_type FROM events")
Q["stream_state_machine"] = (stream_state_machine, _MACHINE_SQL.format(key="user_id", where="true") + "SELECT k AS user_id, s AS state FROM z WHERE r = 1")
Q["stream_maintained_sum"] = (stream_maintained_sum, "SELECT user_id, round(sum(value), 2) AS s FROM events GROUP BY user_id")
