"""Instants and time bounds as constants that Catalyst folds and pushes into the scan."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F, types as T

Instant = datetime | str | Column | None


def instant(value: Instant, kind: T.DataType) -> Column:
    """``value`` as a constant of the time column's own type; None means now.

    The constant takes the column's type, never the other way round: a cast around the column would
    keep the bound from reaching the Parquet reader.
    """
    if value is None:
        return F.current_timestamp().cast(kind)
    if isinstance(value, Column):
        return value.cast(kind)
    if isinstance(value, datetime):
        if value.tzinfo is not None:
            value = value.astimezone(timezone.utc).replace(tzinfo=None)
        value = value.isoformat(sep=" ")
    return F.lit(value).cast(kind)


def ago(as_of: Instant, kind: T.DataType, *, days: int = 0, hours: int = 0, minutes: int = 0) -> Column:
    """``as_of`` less the given span."""
    span = F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes), F.lit(0))
    return instant(as_of, kind) - span


def month_number(moment: Column) -> Column:
    return F.year(moment) * 100 + F.month(moment)


def latest(df: DataFrame, column: str = "timestamp") -> str | None:
    """Greatest time in the table as text, to be used as ``as_of`` over data that has ended."""
    return df.agg(F.max(column).cast("string")).first()[0]


def bucket(column: Column | str, seconds: int) -> Column:
    """Number of the UTC interval a time falls into. Grouping by a whole number took a third of the
    time of grouping by ``date_trunc``; ``bucket_start`` turns the few results back into time."""
    moment = F.col(column) if isinstance(column, str) else column
    return F.floor(F.unix_seconds(moment.cast("timestamp")) / F.lit(seconds))


def bucket_start(number: Column | str, seconds: int, kind: T.DataType) -> Column:
    col = F.col(number) if isinstance(number, str) else number
    return F.timestamp_seconds(col * F.lit(seconds)).cast(kind)
