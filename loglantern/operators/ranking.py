"""Limits, pages and per-group top-n, each with a total order."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.times import ago
from ..session import shared_dir
from .filters import at_least

# Partial groups per key in the first stage of a per-group top-n.
SALTS = 64

# Spans, in hours, in which the newest rows are looked for before the whole table is.
NEWEST_SPANS = (1, 24, 24 * 31)


def top_groups(counts: DataFrame, n: int, key: str, by: str = "count") -> DataFrame:
    """The n greatest groups; equal counts are ordered by key."""
    return counts.orderBy(F.col(by).desc(), F.col(key).asc()).limit(n)


def tie_breakers(df: DataFrame, used: Sequence[str]) -> list[Column]:
    """Columns that make an order total: the row id where there is one, else all other columns."""
    if "log_id" in df.columns:
        return [F.col("log_id")]
    simple = [f.name for f in df.schema.fields if f.name not in used and f.dataType.typeName() not in ("map", "array")]
    return [F.col(c) for c in simple]


def newest(df: DataFrame, n: int, column: str = "timestamp") -> DataFrame:
    """The n newest rows; planned as a top-n, never as a full sort."""
    return df.orderBy(F.col(column).desc(), *tie_breakers(df, [column])).limit(n)


def from_newest(
    logs: DataFrame,
    run: Callable[[DataFrame], DataFrame],
    enough: Callable[[DataFrame], bool],
    column: str = "timestamp",
) -> DataFrame:
    """Answers a "newest n" question on a month-partitioned table without reading all of it.

    ``run`` is tried on the last hour, day and month of the table; months and row groups outside
    the span are skipped. Rows that are older can not enter a result that is ``enough``, so the
    answer is the same as over the whole table, which is what is read when no span suffices. The
    tried results hold n rows per group and are kept as a checkpoint. Tables without the month
    column are read whole.
    """
    if "ym" not in logs.columns:
        return run(logs)
    shared_dir(logs.sparkSession)
    month = logs.agg(F.max("ym")).first()[0]
    end = logs.filter(F.col("ym") == month).agg(F.max(column).cast("string")).first()[0]
    if end is None:
        return run(logs)
    for hours in NEWEST_SPANS:
        bound = ago(end, logs.schema[column].dataType, hours=hours)
        found = run(at_least(logs, bound, column)).checkpoint()
        if enough(found):
            return found
    return run(logs)


def oldest(df: DataFrame, n: int, column: str = "timestamp") -> DataFrame:
    return df.orderBy(F.col(column).asc(), *tie_breakers(df, [column])).limit(n)


def page_after(df: DataFrame, position: tuple[Column, Column] | None, n: int, keys: tuple[str, str]) -> DataFrame:
    """The n rows that follow ``position`` in the order of the two keys.

    A keyset page: rows neither repeat nor go missing when the first key has ties, and the lower
    bound on that key reaches the scan, so earlier pages are not read again.
    """
    first, second = keys
    if position is not None:
        after_first, after_second = position
        df = df.filter(F.col(first) >= after_first).filter(
            (F.col(first) > after_first) | (F.col(second) > after_second)
        )
    return df.orderBy(F.col(first).asc(), F.col(second).asc()).limit(n)


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank: str | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """The first n rows of every group in the given total order.

    Two stages, so that a group holding a large share of the rows is not ranked by one task. Every
    scan task first drops all but its own n best rows per group (the planner puts a window group
    limit ahead of the shuffle), part groups by origin then cut that down to ``salts`` * n rows,
    and only those meet in one task per group. The planner does so for n up to
    ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000); raise that for a greater n.
    """
    part, position = "__part", "__position"
    if salts > 1:
        partial = Window.partitionBy(*keys, part).orderBy(*order)
        df = (
            df.withColumn(part, F.spark_partition_id() % salts)
            .withColumn(position, F.row_number().over(partial))
            .filter(F.col(position) <= n)
            .drop(part, position)
        )
    whole = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(position, F.row_number().over(whole)).filter(F.col(position) <= n)
    if rank:
        ranked = ranked.withColumn(rank, F.col(position).cast("bigint"))
    return ranked.drop(position)


def newest_distinct(df: DataFrame, group: str, columns: Sequence[str], n: int, held_rows: int = 20_000) -> DataFrame:
    """For each task and group the ``n`` newest distinct rows of ``columns`` (the time first, then in ascending order).

    A bounded state, merged batch by batch: copies go before anything is shuffled, so a task passes on at most ``n`` rows a
    group however often they repeat. Merge what the tasks return in the same way, or with ``distinct`` and a top-n.
    """
    names = [group, *columns]
    source = df.select(*names)

    def cut(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().group_by(names).aggregate([]).select(names)
        flagged, keys = rows, [(group, "ascending"), (columns[0], "descending")]
        for c in columns[1:]:  # nulls first, as Spark has them
            flagged = flagged.append_column(f"{c}!", pc.is_valid(rows.column(c)))
            keys += [(f"{c}!", "ascending"), (c, "ascending")]
        rows = rows.take(pc.sort_indices(flagged, sort_keys=keys))
        codes = rows.column(group).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else codes
        place = np.arange(len(codes)) - np.repeat(first, np.diff(np.append(first, len(codes))))
        return rows.filter(pa.array(place < n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list[pa.RecordBatch] = []
        for batch in batches:
            state.append(batch)
            if sum(b.num_rows for b in state) > held_rows:
                state = cut(pa.Table.from_batches(state)).combine_chunks().to_batches()
        if state:
            yield from cut(pa.Table.from_batches(state)).to_batches()

    return source.mapInArrow(run, source.schema)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the order.

    Copies of one key are cut to one row per scan task before the shuffle, so a key that holds a
    third of the table sends a row per task and no more.
    """
    return top_per_group(df, keys, order, 1, salts=1)
