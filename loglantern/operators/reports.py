"""The fixed reports. Each is one scan with map-side partial aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import taxonomy, text
from ..functions.times import Instant, bucket, bucket_start
from ..schemas import REPORTED_LEVELS, level_rank
from .filters import SAMPLE_COLUMNS, SEARCH_COLUMNS, has_level, matching, recent
from .ranking import from_newest, keep_first, newest, oldest, tie_breakers, top_groups, top_per_group


# -- totals and ranges ------------------------------------------------------------------------

def range_stats(logs: DataFrame) -> DataFrame:
    return logs.agg(
        F.count(F.lit(1)).alias("total"),
        F.min("timestamp").alias("earliest"),
        F.max("timestamp").alias("latest"),
    )


def total_count(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count(F.lit(1)).alias("total"))


def recent_activity(logs: DataFrame, as_of: Instant = None, hours: int = 1, approximate: bool = False) -> DataFrame:
    """Rows in all, and rows and distinct sources of the last hours.

    Two branches on purpose: the total needs no column at all and the other branch is cut down by
    the time bound, whereas one conditional aggregate would read time and source of every row.
    """
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    whole = logs.agg(
        F.count(F.lit(1)).alias("total_logs"),
        F.lit(0).cast("bigint").alias("recent_logs"),
        F.lit(0).cast("bigint").alias("active_sources"),
    )
    part = recent(logs, as_of, hours=hours).agg(
        F.lit(0).cast("bigint").alias("total_logs"),
        F.count(F.lit(1)).alias("recent_logs"),
        distinct("source").alias("active_sources"),
    )
    columns = ("total_logs", "recent_logs", "active_sources")
    return whole.unionByName(part).agg(*[F.sum(c).alias(c) for c in columns])


# -- counts by a key --------------------------------------------------------------------------

def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def top_hosts(logs: DataFrame, n: int = 10) -> DataFrame:
    return top_groups(counts_by(logs, "host"), n, "host")


def top_files(logs: DataFrame, n: int = 10) -> DataFrame:
    return top_groups(counts_by(logs, "file"), n, "file")


def level_counts(logs: DataFrame) -> DataFrame:
    return counts_by(logs, "level").orderBy(F.col("count").desc(), "level")


def level_counts_ranked(logs: DataFrame) -> DataFrame:
    """Counts by level in the order of the stored enumeration."""
    return counts_by(logs, "level").withColumn("level_rank", level_rank("level")).orderBy("level_rank", "level")


def with_share(counts: DataFrame, digits: int = 1) -> DataFrame:
    """Adds each group's percentage of all rows, for keys of a fixed small domain (level, label):
    the window holds one pre-aggregated row per key, and the table is scanned once."""
    total = F.sum("count").over(Window.partitionBy())
    return counts.withColumn("percentage", F.round(F.col("count") * 100.0 / total, digits).cast("double"))


def level_share(logs: DataFrame) -> DataFrame:
    return with_share(counts_by(logs, "level")).orderBy(F.col("count").desc(), "level")


def top_sources(logs: DataFrame, n: int = 10) -> DataFrame:
    counted = logs.groupBy("source").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(has_level("error")).alias("errors"),
        F.count_if(has_level("warning")).alias("warnings"),
    )
    return top_groups(counted, n, "source")


# -- counts over time -------------------------------------------------------------------------

def per_minute(logs: DataFrame, n: int = 120) -> DataFrame:
    """The newest n minutes. Typed time groups by its truncated value and is shown as text only
    for the rows that are returned; time held as text groups by its first 16 characters."""
    kind = logs.schema["timestamp"].dataType
    if isinstance(kind, T.StringType):
        grouped = logs.groupBy(text.minute_key("timestamp").alias("minute")).agg(F.count(F.lit(1)).alias("count"))
        return grouped.orderBy(F.col("minute").desc()).limit(n)
    counted = logs.groupBy(bucket("timestamp", 60).alias("__b")).agg(F.count(F.lit(1)).alias("count"))
    shown = F.date_format(bucket_start("__b", 60, T.TimestampType()), "yyyy-MM-dd HH:mm")
    return counted.orderBy(F.col("__b").desc()).limit(n).select(shown.alias("minute"), "count")


def _by_time(df: DataFrame, seconds: int, name: str, measures: Sequence[Column]) -> DataFrame:
    counted = df.groupBy(bucket("timestamp", seconds).alias("__b")).agg(*measures)
    start = bucket_start("__b", seconds, df.schema["timestamp"].dataType)
    return counted.withColumn(name, start).select(name, *counted.columns[1:]).orderBy(name)


def hourly_counts(logs: DataFrame, hours: int = 24, as_of: Instant = None) -> DataFrame:
    measures = [
        F.count(F.lit(1)).alias("count"),
        F.count_if(has_level("error")).alias("errors"),
        F.count_if(has_level("warning")).alias("warnings"),
    ]
    return _by_time(recent(logs, as_of, hours=hours), 3600, "hour", measures)


def error_trend(logs: DataFrame, hours: int = 24, as_of: Instant = None, approximate: bool = False) -> DataFrame:
    """Errors and distinct sources by minute; ``approximate`` trades exact sources for a sketch."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    measures = [F.count(F.lit(1)).alias("error_count"), distinct("source").alias("unique_sources")]
    return _by_time(recent(logs, as_of, hours=hours).filter(has_level("error")), 60, "minute", measures)


def log_statistics(logs: DataFrame, minutes: int | None = 1, as_of: Instant = None) -> DataFrame:
    """Total, count by level (always the five reported levels) and by source, as (kind, key, count).

    The rows are reduced once to one count per (level, source); the three breakdowns are then made
    from that small result instead of tripling every log row.
    """
    part = logs if minutes is None else recent(logs, as_of, minutes=minutes)
    small = counts_by(part, "level", "source")
    spread = small.select(
        F.explode(
            F.array(
                F.struct(F.lit("total").alias("kind"), F.lit("").alias("key")),
                F.struct(F.lit("level").alias("kind"), F.col("level").alias("key")),
                F.struct(F.lit("source").alias("kind"), F.col("source").alias("key")),
            )
        ).alias("e"),
        "count",
    ).select("e.kind", "e.key", "count")
    spread = spread.filter((F.col("kind") != "level") | F.col("key").isin(*REPORTED_LEVELS))
    zeros = [("total", "", 0)] + [("level", level, 0) for level in REPORTED_LEVELS]
    zero_rows = logs.sparkSession.createDataFrame(zeros, "kind string, key string, count bigint")
    return spread.unionByName(zero_rows).groupBy("kind", "key").agg(F.sum("count").alias("count"))


# -- message content --------------------------------------------------------------------------

def length_histogram(df: DataFrame, message: str = "message", width: int = 100) -> DataFrame:
    return (
        df.filter(text.not_empty(message))
        .groupBy(text.length_bucket(message, width).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("bucket")
    )


def severity_estimate(logs: DataFrame, lists: taxonomy.WordLists = taxonomy.SEVERITY_WORDS) -> DataFrame:
    return logs.agg(*[F.count_if(flag).alias(name) for name, flag in _flags(logs, lists, "est_").items()])


def _flags(logs: DataFrame, lists: taxonomy.WordLists, prefix: str = "is_") -> dict[str, Column]:
    """Predicates per list; flags that ingest has stored for the same words are read instead of computed."""
    return {
        name: F.col(f"{prefix}{name}") if taxonomy.stored_flag(logs, name, words, prefix) else taxonomy.has_any("message", words)
        for name, words in lists.items()
    }


def insights_summary(
    logs: DataFrame,
    since: Column | None = None,
    lists: taxonomy.WordLists = taxonomy.CATEGORY_WORDS,
) -> DataFrame:
    """Rows in all and rows per category, in one pass. A row may count in several categories."""
    if since is not None:
        logs = logs.filter(F.col("timestamp") >= since)
    names = {"error": "errors", "security": "security_issues", "hardware": "hardware_issues"}
    flags = _flags(logs, lists)
    return logs.agg(
        F.count(F.lit(1)).alias("total_logs"),
        *[F.count_if(flags[name]).alias(names.get(name, name)) for name in lists],
    )


def category_flags(logs: DataFrame) -> DataFrame:
    """Every row with its category flags, the form in which ingest stores them."""
    return logs.withColumns(taxonomy.flags("message", taxonomy.CATEGORY_WORDS, "is_"))


def category_samples(
    logs: DataFrame,
    n: int = 50,
    lists: taxonomy.WordLists = taxonomy.CATEGORY_WORDS,
) -> DataFrame:
    """The n newest messages of every category, in one pass over the logs."""
    order = ("timestamp", "log_id") if "log_id" in logs.columns else ("timestamp", "message", "host")
    flags = [f"is_{name}" for name in lists if f"is_{name}" in logs.columns]

    def run(part: DataFrame) -> DataFrame:
        kept = part.select(*dict.fromkeys((*order, "message")), *flags)
        hits = taxonomy.explode_matches(kept, lists, "category")
        ranked = [F.col(order[0]).desc(), *[F.col(c) for c in order[1:]]]
        return top_per_group(hits, ["category"], ranked, n, rank="rank")

    return from_newest(logs, run, lambda found: found.count() >= n * len(lists))


def dashboard_samples(logs: DataFrame, n: int = 2, width: int = 80) -> DataFrame:
    """The n newest messages per category cut for display, always with dots."""
    return category_samples(logs, n).select(
        "category", "rank", text.prefix("message", width, ellipsis=True).alias("preview")
    )


# -- row lists --------------------------------------------------------------------------------

def search_logs(
    logs: DataFrame,
    search_term: str | None = None,
    source: str | None = None,
    level: str | None = None,
    limit: int = 100,
) -> DataFrame:
    """The newest rows that meet all given conditions."""
    keys = [F.col("timestamp").desc(), *tie_breakers(logs, ["timestamp", "ym"])]

    def run(part: DataFrame) -> DataFrame:
        return matching(part, search_term, source, level).orderBy(*keys).limit(limit).select(*SEARCH_COLUMNS)

    return from_newest(logs, run, lambda found: found.count() >= limit)


def sample_export(logs: DataFrame, n: int = 10_000) -> DataFrame:
    """The n oldest rows with a message."""
    return oldest(logs.filter(text.not_empty("message")), n).select(*SAMPLE_COLUMNS)


def newest_rows(logs: DataFrame, n: int, columns: Sequence[str] = SEARCH_COLUMNS) -> DataFrame:
    return from_newest(logs, lambda part: newest(part, n).select(*columns), lambda found: found.count() >= n)


def display_rows(rows: DataFrame, message: str = "message", score: str | None = None) -> DataFrame:
    """The ways a message is cut for display, and a score as a percentage."""
    shown = {
        "key_150": text.prefix(message, 150),
        "preview_80": text.prefix(message, 80, ellipsis=True),
        "short_100": text.prefix(message, 100, ellipsis=False),
        "body_300": text.prefix(message, 300, ellipsis=False),
        "line_160": text.one_line(message, 160),
    }
    if score:
        shown["match_percent"] = text.percent(score)
    return rows.withColumns(shown)


def keep_first_by_prefix(
    rows: DataFrame,
    order: Sequence[Column],
    message: str = "message",
    width: int = 150,
    within: Sequence[str] = (),
) -> DataFrame:
    """One row per first ``width`` characters (and per ``within`` columns), the first in the order."""
    key = "__prefix"
    return keep_first(rows.withColumn(key, text.prefix(message, width)), [*within, key], order).drop(key)


# -- collection summary -----------------------------------------------------------------------

def collection_summary(parsed: DataFrame, stored: DataFrame, minutes: int = 1, as_of: Instant = None) -> DataFrame:
    """One log row that sums up a collection run; no row when nothing was stored in the window.

    The map holds one entry per level and per distinct source of that window.
    """
    stats = log_statistics(stored, minutes, as_of)
    n_parsed = parsed.agg(F.count(F.lit(1)))
    n_stored = stored.agg(F.count(F.lit(1)))
    maps = stats.agg(
        *[
            F.to_json(
                F.map_from_entries(
                    F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "count"))))
                )
            ).alias(f"by_{kind}")
            for kind in ("level", "source")
        ],
        F.sum(F.when(F.col("kind") == "total", F.col("count"))).alias("total_logs"),
    ).filter(F.col("total_logs") > 0)
    counted = maps.withColumns({"parsed_entries": n_parsed.scalar(), "stored_entries": n_stored.scalar()})
    moment = F.current_timestamp() if as_of is None else (as_of if isinstance(as_of, Column) else F.lit(as_of))
    keys = ("parsed_entries", "stored_entries", "total_logs", "by_level", "by_source")
    pairs = [part for key in keys for part in (F.lit(key), F.col(key).cast("string"))]
    return counted.select(
        moment.cast("timestamp").alias("timestamp"),
        F.lit("system_log_parser").alias("source"),
        F.lit("info").alias("level"),
        F.format_string("Parsed %d system log entries from lastmin.log", "parsed_entries").alias("message"),
        F.create_map(*pairs).alias("metadata"),
    )
