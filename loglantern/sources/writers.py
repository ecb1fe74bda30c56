"""Writers. Every write is one Spark job committed as a whole; none goes through the driver."""

from __future__ import annotations

import time

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from .. import schemas
from ..functions import taxonomy, text
from .readers import path_exists, read_or_empty

# Columns with a bloom filter in the log files. Fixed values.
BLOOM_COLUMNS = ("source", "level", "pid")
COMPRESSION = "zstd"

_POINTER = T.StructType([T.StructField("version", T.LongType()), T.StructField("path", T.StringType())])


def _bloom(writer):
    for column in BLOOM_COLUMNS:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    return writer


def with_ingest_columns(logs: DataFrame) -> DataFrame:
    """Adds what later queries would otherwise compute from every message again: the flags of the
    summary (``is_``), of the severity estimate (``est_``) and of the keyword search (``find_``),
    and the label. Tests inside a text cannot be pushed to Parquet, stored flags can."""
    computed = {
        **taxonomy.flags("message", taxonomy.CATEGORY_WORDS, "is_"),
        **taxonomy.flags("message", taxonomy.SEVERITY_WORDS, "est_"),
        **taxonomy.flags("message", taxonomy.SEARCH_WORDS, "find_"),
    }
    return logs.withColumns({**computed, "label": taxonomy.label_of("message")})


def laid_out(logs: DataFrame, files: int | None = None) -> DataFrame:
    """Rows placed for the table layout: by month and then by time, source and level.

    Range partitioning splits a month over as many files as its rows need, so one full month does
    not become one task; a hash of the message splits rows that agree in all sort columns.
    """
    placed = logs.withColumn("ym", text.year_month("timestamp"))
    keys = ["ym", "timestamp", "source", "level"]
    spread = F.xxhash64("message")
    ranged = placed.repartitionByRange(*([files] if files else []), *keys, spread)
    return ranged.sortWithinPartitions(*keys)


def write_logs(
    logs: DataFrame, path: str, mode: str = "append", files: int | None = None, enrich: bool = False
) -> int:
    """Appends to the log table: month partitions, rows in (timestamp, source, level) order, bloom
    filters on the lookup columns. Returns the number of rows, counted by the same job.

    ``enrich`` stores the ingest columns too. They are computed behind the exchange, because the
    sampling that sets the ranges runs everything before it a first time.
    """
    seen = Observation()
    rows = laid_out(logs, files)
    rows = with_ingest_columns(rows) if enrich else rows
    rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = rows.write.mode(mode).partitionBy("ym").option("compression", COMPRESSION)
    _bloom(writer).parquet(path)
    return int(seen.get["rows"] or 0)


def store_logs(logs: DataFrame, path: str) -> int:
    """Bulk insert of log entries, all or nothing; returns how many were stored."""
    return write_logs(logs, path)


def append_json(logs: DataFrame, path: str) -> None:
    """Appends entries as JSON lines."""
    logs.write.mode("append").option("ignoreNullFields", "false").json(path)


def insert_embeddings(rows: DataFrame, path: str) -> int:
    seen = Observation()
    observed = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
    observed.write.mode("append").option("compression", COMPRESSION).parquet(path)
    return int(seen.get["rows"] or 0)


def export_csv(report: DataFrame, folder: str, name: str, single_file: bool = False, epoch: int | None = None) -> str:
    """Writes ``<folder>/<name>_<epoch>.csv`` with a header; an empty report writes nothing.

    ``single_file`` is for limited reports: one task writes all rows.
    """
    kept = report.persist()
    try:
        if kept.isEmpty():
            return ""
        path = f"{folder}/{name}_{int(time.time()) if epoch is None else epoch}.csv"
        out = kept.coalesce(1) if single_file else kept
        out.write.mode("overwrite").option("header", True).csv(path)
        return path
    finally:
        kept.unpersist()


# -- the versioned vector set -----------------------------------------------------------------

def replace_vectors(rows: DataFrame, path: str) -> str | None:
    """Replaces the stored vector set and returns where it now lies; an empty set changes nothing.

    The new version is complete on storage before the pointer names it, so a reader sees the old
    set or the new one, never a mixture, and a failed job leaves the old one in force.
    """
    spark = rows.sparkSession
    version = (current_version(spark, path) or (0, ""))[0] + 1
    target = f"{path}/version={version:06d}-{time.time_ns()}"
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", COMPRESSION).parquet(target)
    if not seen.get["rows"]:
        return None
    spark.createDataFrame([(version, target)], _POINTER).coalesce(1).write.mode("append").json(f"{path}/_pointer")
    return target


def current_version(spark: SparkSession, path: str) -> tuple[int, str] | None:
    if not path_exists(spark, f"{path}/_pointer"):
        return None
    row = spark.read.schema(_POINTER).json(f"{path}/_pointer").orderBy(F.col("version").desc()).first()
    return (row["version"], row["path"]) if row else None


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The vector set in force; empty when none was ever stored."""
    version = current_version(spark, path)
    return read_or_empty(spark, version[1] if version else f"{path}/none", schemas.TEXT_VECTORS)


# -- models -----------------------------------------------------------------------------------

def save_model(model: PipelineModel, metadata: dict, spark: SparkSession, path: str) -> str:
    """Saves the model, then appends its metadata row; a run counts only once the row is there."""
    stamp = int(metadata["timestamp"])
    target = f"{path}/models/classifier_{stamp}"
    model.write().overwrite().save(target)
    row = {**metadata, "model_path": target}
    ordered = tuple(row.get(name) for name in schemas.MODEL_METADATA.names)
    spark.createDataFrame([ordered], schemas.MODEL_METADATA).coalesce(1).write.mode("append").json(f"{path}/metadata")
    return target
