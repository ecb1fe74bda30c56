"""Live counts over event time, and suppression of replayed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.filters import has_level
from ..sources.landing import _Store
from ..sources.writers import COMPRESSION
from .ingest import COLLECTION_INTERVAL, _trigger

# How late a row may come and still be counted; it bounds the state that is kept.
LATENESS = "1 hour"


def event_time(stream: DataFrame, column: str = "timestamp", lateness: str = LATENESS) -> DataFrame:
    """Sets the watermark. A watermark needs an instant, so time without a zone is read as UTC."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


def hourly(stream: DataFrame, width: str = "1 hour", sketch: bool = False) -> DataFrame:
    """Rows, errors and warnings per hour; with ``sketch``, a sketch of the sources that ``rolled_up`` can merge."""
    counts = [
        F.count(F.lit(1)).alias("count"),
        F.count_if(has_level("error")).alias("errors"),
        F.count_if(has_level("warning")).alias("warnings"),
    ]
    counts += [F.hll_sketch_agg("source").alias("sources")] * sketch
    grouped = stream.groupBy(F.window("timestamp", width).alias("w")).agg(*counts)
    return grouped.select(F.col("w.start").alias("hour"), "count", "errors", "warnings", *["sources"] * sketch)


def rolled_up(counts: DataFrame, unit: str = "day", window: str = "hour") -> DataFrame:
    """Stored windows merged into longer ones: sums of the counts, and distinct sources from the merged sketches.

    No log row is read again. A sketch is exact for some hundred sources and within about 2 % beyond.
    """
    sums = [F.sum(c).alias(c) for c in ("count", "errors", "warnings")]
    distinct = [F.hll_sketch_estimate(F.hll_union_agg("sources")).alias("unique_sources")] if "sources" in counts.columns else []
    return counts.groupBy(F.date_trunc(unit, F.col(window)).alias(unit)).agg(*sums, *distinct)


def error_minutes(stream: DataFrame, width: str = "1 minute") -> DataFrame:
    """Errors and distinct sources per minute; a stream counts distinct sources by a sketch."""
    return (
        stream.filter(has_level("error"))
        .groupBy(F.window("timestamp", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("error_count"), F.approx_count_distinct("source").alias("unique_sources"))
        .select(F.col("w.start").alias("minute"), "error_count", "unique_sources")
    )


def without_replays(stream: DataFrame, key: str = "log_id") -> DataFrame:
    """Drops rows whose key was seen within the watermark span."""
    return stream.dropDuplicatesWithinWatermark([key])


def keep_current(
    counts: DataFrame, path: str, checkpoint: str, once: bool = False, seconds: int = COLLECTION_INTERVAL
) -> StreamingQuery:
    """Keeps all windows up to date, the open ones too: one row per window.

    Each batch writes a version of the table: the windows it changed, and all others as the version before has them. The
    version before stays until the next one is whole, so a batch that is run again starts from the same rows, and a
    reader never sees half of one. The first column names the window.
    """
    window = counts.columns[0]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = _Store(spark, path)
        whole = _versions(store, path)
        before = [v for v in whole if v < batch_id]
        rows = batch
        if before:
            changed = batch.select(F.col(window).alias("__w"))
            old = spark.read.schema(batch.schema).parquet(f"{path}/version={before[-1]}")
            rows = batch.unionByName(old.join(changed, F.col(window) == F.col("__w"), "left_anti"))
        rows.write.mode("overwrite").option("compression", COMPRESSION).parquet(f"{path}/version={batch_id}")
        for version in before[:-1]:
            store.drop(f"{path}/version={version}")

    writer = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(writer, once, seconds).start()


def _versions(store: _Store, path: str) -> list[int]:
    """Versions that were written as a whole."""
    found = [int(name[8:]) for name, _ in store.entries(path) if name.startswith("version=")]
    return sorted(v for v in found if store.exists(f"{path}/version={v}/_SUCCESS"))


def read_current(spark, path: str, window: str) -> DataFrame:
    """The newest whole version; ``window`` names its first column."""
    versions = _versions(_Store(spark, path), path)
    if not versions:
        raise FileNotFoundError(f"nothing is kept in {path} yet")
    rows = spark.read.parquet(f"{path}/version={versions[-1]}")
    return rows.select(window, *[c for c in rows.columns if c != window])
