"""Row filters over the log table, with the time bound pushed to partitions and row groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.taxonomy import has_any
from ..functions.times import Instant, ago, instant, month_number

# Columns that the stored-entry queries return; the metadata column carries its stored name.
ENTRY_COLUMNS = ("timestamp", "source", "level", "message")
SEARCH_COLUMNS = ("timestamp", "source", "level", "message", "pid", "thread_id")
SAMPLE_COLUMNS = ("timestamp", "host", "file", "source_type", "message")
VIEW_COLUMNS = ("timestamp", "source", "message", "pid", "thread_id", "metadata")


def at_least(df: DataFrame, bound: Column, column: str = "timestamp") -> DataFrame:
    """Rows at or after the bound; on a month-partitioned table the months are pruned as well."""
    keep = F.col(column) >= bound
    if "ym" in df.columns:
        keep = keep & (F.col("ym") >= month_number(bound))
    return df.filter(keep)


def at_most(df: DataFrame, bound: Column, column: str = "timestamp") -> DataFrame:
    """Rows at or before the bound."""
    keep = F.col(column) <= bound
    if "ym" in df.columns:
        keep = keep & (F.col("ym") <= month_number(bound))
    return df.filter(keep)


def recent(
    df: DataFrame,
    as_of: Instant = None,
    *,
    days: int = 0,
    hours: int = 0,
    minutes: int = 0,
    column: str = "timestamp",
) -> DataFrame:
    """Rows of the last days / hours / minutes before ``as_of``, the lower bound included."""
    bound = ago(as_of, df.schema[column].dataType, days=days, hours=hours, minutes=minutes)
    return at_least(df, bound, column)


def within(df: DataFrame, start: Instant, end: Instant, column: str = "timestamp") -> DataFrame:
    """Rows of the closed range [start, end]."""
    kind = df.schema[column].dataType
    return at_most(at_least(df, instant(start, kind), column), instant(end, kind), column)


def expired(df: DataFrame, as_of: Instant = None, *, days: int, column: str = "timestamp") -> Column:
    """Predicate of rows strictly older than the retention span."""
    return F.col(column) < ago(as_of, df.schema[column].dataType, days=days)


def retained(df: DataFrame, as_of: Instant = None, *, days: int = 30, column: str = "timestamp") -> DataFrame:
    """What a clean-up after ``days`` days leaves in place."""
    return recent(df, as_of, days=days, column=column)


def has_level(level: str, column: str = "level") -> Column:
    return F.col(column) == level


def has_source(source: str, column: str = "source") -> Column:
    return F.col(column) == source


def as_entries(df: DataFrame) -> DataFrame:
    """Projection to the stored-entry columns."""
    kept = [F.col(c) for c in ENTRY_COLUMNS]
    if "metadata" in df.columns:
        kept.append(F.col("metadata").alias("log_metadata"))
    return df.select(*kept)


def newest_first(df: DataFrame, column: str = "timestamp") -> DataFrame:
    return df.orderBy(F.col(column).desc())


def logs_last_minute(logs: DataFrame, as_of: Instant = None) -> DataFrame:
    return newest_first(as_entries(recent(logs, as_of, minutes=1)))


def logs_in_range(logs: DataFrame, start: Instant, end: Instant) -> DataFrame:
    return newest_first(as_entries(within(logs, start, end)))


def logs_by_source(logs: DataFrame, source: str, minutes: int = 1, as_of: Instant = None) -> DataFrame:
    return newest_first(as_entries(recent(logs, as_of, minutes=minutes).filter(has_source(source))))


def logs_by_level(logs: DataFrame, level: str, minutes: int = 1, as_of: Instant = None) -> DataFrame:
    return newest_first(as_entries(recent(logs, as_of, minutes=minutes).filter(has_level(level))))


def matching(
    logs: DataFrame,
    search_term: str | None = None,
    source: str | None = None,
    level: str | None = None,
) -> DataFrame:
    """Conjunction of the given conditions; none given keeps every row.

    The term is plain text: ``%`` and ``_`` in it stand for themselves.
    """
    # Equalities first: they reach the scan, and the text test runs on what they leave.
    if source:
        logs = logs.filter(has_source(source))
    if level:
        logs = logs.filter(has_level(level))
    if search_term:
        logs = logs.filter(has_any("message", [search_term]))
    return logs


def error_rows(logs: DataFrame) -> DataFrame:
    return logs.filter(has_level("error")).select(*VIEW_COLUMNS)


def warning_rows(logs: DataFrame) -> DataFrame:
    return logs.filter(has_level("warning")).select(*VIEW_COLUMNS)
