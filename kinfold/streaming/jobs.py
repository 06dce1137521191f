"""Structured Streaming forms: event-time counts, first-of-key, event transforms, state machines, delta-maintained aggregations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.aggregations import delta
from ..operators.machines import StateMachine


def read_events(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(path)


def _timed(events: DataFrame, ts: str) -> DataFrame:
    """Watermarks need timestamps with a zone; those without are UTC in a UTC session."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def first_of_key(events: DataFrame, key: list[str], ts: str, delay: str) -> DataFrame:
    """Idempotent ingestion: the first event of each key that comes within the watermark."""
    return _timed(events, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def windowed(events: DataFrame, ts: str, delay: str, width: str, by: list[str], aggs: list[Column], slide: str | None = None) -> DataFrame:
    """Aggregations over event-time windows; late events within the delay count."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return _timed(events, ts).withWatermark(ts, delay).groupBy(w.alias("window"), *by).agg(*aggs)


def run_machine(events: DataFrame, machine: StateMachine, key: str, order: str, event: str) -> DataFrame:
    """(key, state, moves) after each batch of events of a key. Triggers are event names; the state is kept per key, for good. Events
    are put in order within a micro-batch: a source has to deliver batches in order, and late events act when they come."""
    table = {(t.current, t.trigger): t.next for t in machine.transfers}
    if any(callable(t.trigger) for t in machine.transfers):
        raise ValueError("on streams a trigger is an event name")
    kind = events.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s, moves = state.get if state.exists else (machine.initial, 0)
        for name in pd.concat(list(batches)).sort_values(order)[event]:
            nxt = table.get((s, name))
            if nxt is not None:
                s, moves = nxt, moves + 1
        state.update((s, moves))
        yield pd.DataFrame({key: [k[0]], "state": [s], "moves": [moves]})

    return events.select(key, order, event).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, state string, moves bigint", "state string, moves bigint", "update", GroupStateTimeout.NoTimeout)


def maintain(changes: DataFrame, state_path: str, host_items: Callable[[DataFrame], tuple[DataFrame, DataFrame]], checkpoint: str, empty: Callable[[SparkSession], DataFrame]) -> StreamingQuery:
    """Keep aggregation states in versions under state_path: each batch of a change log is split into the items before and after,
    whose difference is merged into the last version. A batch that is retried writes its version again."""

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        state = spark.read.parquet(f"{state_path}/v{n - 1}") if n > 0 else empty(spark)
        before, after = host_items(batch)
        delta(state, before, after).write.mode("overwrite").parquet(f"{state_path}/v{n}")

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def listen(changes: DataFrame, listeners: list[Callable[[DataFrame, int], None]], checkpoint: str) -> StreamingQuery:
    """Hand each batch of a change log to all listeners."""

    def each(batch: DataFrame, n: int) -> None:
        batch.persist()
        try:
            for f in listeners:
                f(batch, n)
        finally:
            batch.unpersist()

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
