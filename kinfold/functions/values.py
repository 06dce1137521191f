"""Values that compare by meaning: canonical JSON, timestamps as milliseconds, ids as text, finite numbers."""

from __future__ import annotations

import datetime as dt
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(v: Any) -> str:
    """JSON with sorted keys and no spaces; array order matters, key order does not."""
    if isinstance(v, str):
        try:
            v = json.loads(v)
        except ValueError:
            pass
    return json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def json_column(c: Column) -> Column:
    """The same of a column of JSON text: parsed as a variant, whose objects keep sorted keys, and written back."""
    return F.to_json(F.parse_json(c))


def to_timestamp_literal(v: Any) -> dt.datetime:
    """From milliseconds, ISO text or a datetime; without a zone it is UTC."""
    if isinstance(v, (int, float)):
        return dt.datetime.fromtimestamp(v / 1000, dt.timezone.utc)
    if isinstance(v, str):
        v = dt.datetime.fromisoformat(v.replace("Z", "+00:00"))
    return v if v.tzinfo else v.replace(tzinfo=dt.timezone.utc)


def millis(c: Column) -> Column:
    """A timestamp as milliseconds."""
    return F.unix_millis(c)


def from_millis(c: Column) -> Column:
    return F.timestamp_millis(c)


def same_id(a: Column, b: Column) -> Column:
    """Ids compare as text: 1 equals '1'."""
    return a.cast("string") == b.cast("string")


def finite(c: Column) -> Column:
    """A number with null, NaN and infinities as 0."""
    x = c.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def greatest_or(a: Column, b: Column) -> Column:
    """The larger of two; nulls give way."""
    return F.greatest(a, b)


def add_to(c: Column, delta: Column) -> Column:
    """coalesce(c, 0) + delta."""
    return F.coalesce(c, F.lit(0)) + delta
