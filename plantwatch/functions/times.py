"""Time arithmetic that works alike on TIMESTAMP and TIMESTAMP_NTZ."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def micros(ts) -> Column:
    return F.unix_micros(as_column(ts).cast("timestamp"))


def seconds_between(start, end) -> Column:
    return (micros(end) - micros(start)) / F.lit(1_000_000.0)


def plus_seconds(ts, seconds) -> Column:
    return as_column(ts) + F.make_dt_interval(secs=as_column(seconds).cast("decimal(18,6)"))


def instant(df: DataFrame, ts: str, value) -> Column:
    """A literal of the column's own type, so that comparisons reach the scan."""
    if isinstance(value, Column):
        return value
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else str(value)
    return F.lit(text).cast(df.schema[ts].dataType)


def span(text: str) -> Column:
    return F.expr(f"INTERVAL {text}")


def iso(ts) -> Column:
    return F.date_format(as_column(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def minutes_seconds(seconds) -> Column:
    """m:ss text."""
    s = as_column(seconds).cast("long")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"),
                    F.lpad((s % 60).cast("string"), 2, "0"))
