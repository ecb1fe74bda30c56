"""Continuous ingest of log files into tables.

The file source takes each new file once; it does not follow a file that grows. A producer must
therefore roll its files, writing elsewhere and moving a finished file in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import Instant, instant
from ..operators.filters import VIEW_COLUMNS, has_level
from ..functions.text import year_month
from ..sources.writers import COMPRESSION

# Time between collections, in seconds. Fixed value.
COLLECTION_INTERVAL = 600


def read_lines(
    spark: SparkSession,
    path: str,
    start: Instant = None,
    host: str = "",
    max_line_bytes: int | None = None,
    max_files: int | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """Raw log rows from the files of a folder; with ``max_line_bytes``, without the lines beyond it.

    ``start`` begins "at the end": files last changed before it are passed over.
    """
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    lines = reader.text(path).select("value", "_metadata.file_path", "_metadata.file_modification_time")
    if start is not None:
        lines = lines.filter(F.col("file_modification_time") >= instant(start, T.TimestampType()))
    if max_line_bytes is not None:
        lines = lines.filter(F.octet_length("value") <= max_line_bytes)
    return lines.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss.SSS").alias("timestamp"),
        F.lit(host).alias("host"),
        F.col("file_path").alias("file"),
        F.lit("file").alias("source_type"),
        F.col("value").alias("message"),
    )


def read_table_stream(
    spark: SparkSession, path: str, schema: T.StructType, pattern: str | None = None, max_files: int | None = None
) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def _trigger(writer, once: bool, seconds: int):
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")


def to_table(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    once: bool = False,
    seconds: int = COLLECTION_INTERVAL,
    compression: str = COMPRESSION,
    by_month: bool = False,
) -> StreamingQuery:
    """Appends the stream to a Parquet table; the sink's own log makes each batch count once."""
    if by_month:
        stream = stream.withColumn("ym", year_month("timestamp"))
    writer = stream.writeStream.format("parquet").outputMode("append").option("compression", compression)
    if by_month:
        writer = writer.partitionBy("ym")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return _trigger(writer, once, seconds).start()


def to_console(stream: DataFrame, checkpoint: str, once: bool = False, seconds: int = 10) -> StreamingQuery:
    """Shows the stream as JSON lines, a few of every batch; for looking, not for keeping."""
    shown = stream.select(F.to_json(F.struct("*")).alias("json"))
    writer = shown.writeStream.format("console").option("truncate", False).option("checkpointLocation", checkpoint)
    return _trigger(writer, once, seconds).start()


def maintain_views(
    logs: DataFrame,
    paths: dict[str, str],
    checkpoint: str,
    once: bool = False,
    seconds: int = COLLECTION_INTERVAL,
    logs_path: str | None = None,
) -> StreamingQuery:
    """Keeps one filtered table per level (such as error and warning) beside the log table.

    Rows that came before the query was first started are not taken in if the source leaves them
    out. A batch is read once for all tables. Each table keeps a batch in a folder of its own that
    a replay overwrites, so a batch repeated after a failure counts once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("ym", year_month("timestamp")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            targets: list[tuple[DataFrame, str]] = [
                (batch.filter(has_level(level)).select(*VIEW_COLUMNS, "ym"), path) for level, path in paths.items()
            ]
            if logs_path:
                targets.append((batch, logs_path))
            for rows, path in targets:
                ordered = rows.sortWithinPartitions("ym", "timestamp")
                ordered.write.mode("overwrite").partitionBy("ym").option("compression", COMPRESSION).parquet(
                    f"{path}/batch={batch_id}"
                )
        finally:
            batch.unpersist()

    writer = logs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(writer, once, seconds).start()


def read_view(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batches of a maintained table."""
    added = [T.StructField("batch", T.LongType()), T.StructField("ym", T.IntegerType())]
    return spark.read.schema(T.StructType([*schema.fields, *added])).parquet(path).drop("batch", "ym")


def enrich(
    stream: DataFrame,
    encode: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    once: bool = False,
    seconds: int = COLLECTION_INTERVAL,
) -> StreamingQuery:
    """Adds vectors to new rows only; the checkpoint remembers which rows are done."""
    return to_table(encode(stream), path, checkpoint, once, seconds)
