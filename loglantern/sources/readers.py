"""Batch readers. Schemas are declared, never inferred; bad records are skipped, not fatal."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import schemas
from ..functions import taxonomy, text
from ..functions.times import Instant, instant
from ..operators.filters import recent
from . import json_ranges

_OS_METADATA = ("subsystem", "category", "process", "thread", "eventType", "messageType")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet table with a declared schema; a month partition column is added to it by Spark."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """The month-partitioned log table."""
    months = T.StructType([*schemas.LOGS.fields, T.StructField("ym", T.IntegerType())])
    return read_table(spark, path, months)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Stored table, or an empty one when the path is missing. A file that can't be read fails the query that
    reads it: without it the table would silently be smaller."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("ignoreCorruptFiles", "false").parquet(path)


# -- OS log exports ---------------------------------------------------------------------------

def _entries(records: DataFrame, as_of: Instant = None) -> DataFrame:
    """OS log records to log entries. A missing time becomes ``as_of``; an unreadable one drops the
    record."""
    given = F.coalesce(F.col("timestamp"), F.lit(""))
    moment = F.when(given == "", instant(as_of, T.TimestampType())).otherwise(text.to_timestamp_utc("timestamp"))
    pairs = [part for c in _OS_METADATA for part in (F.lit(c), F.coalesce(F.col(c), F.lit("")))]
    message = F.coalesce(F.col("eventMessage"), F.lit(""))
    return records.select(
        moment.alias("timestamp"),
        F.coalesce(F.col("source"), F.lit("system")).alias("source"),
        taxonomy.level_of(message).alias("level"),
        message.alias("message"),
        F.create_map(*pairs).alias("metadata"),
    ).filter(F.col("timestamp").isNotNull())


def read_os_log_arrays(spark: SparkSession, path: str, as_of: Instant = None, range_bytes: int = json_ranges.RANGE_BYTES) -> DataFrame:
    """A file, or a folder of files, that each hold one JSON array of records, however large: many tasks read one file.
    Records that don't parse are passed over; ``json_ranges.parsed_or_refused`` tells which."""
    records = json_ranges.read_records(spark, path, range_bytes)
    return _entries(json_ranges.parsed(records, schemas.OS_LOG_RECORD), as_of)


def parse_os_log_lines(lines: DataFrame, as_of: Instant = None, column: str = "value") -> DataFrame:
    """Text lines of a JSON array, one record a line: brackets, trailing commas and lines that do
    not parse are passed over."""
    bare = F.rtrim(text.strip(column), F.lit(","))
    checked = T.StructType([*schemas.OS_LOG_RECORD.fields, T.StructField(schemas.CORRUPT_RECORD, T.StringType())])
    record = F.from_json(
        bare, checked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": schemas.CORRUPT_RECORD}
    )
    parsed = lines.filter(bare.startswith("{")).select(record.alias("r")).select("r.*")
    return _entries(parsed.filter(F.col(schemas.CORRUPT_RECORD).isNull()), as_of)


def read_os_log_lines(spark: SparkSession, path: str, as_of: Instant = None) -> DataFrame:
    return parse_os_log_lines(spark.read.text(path), as_of)


# -- JSON entries -----------------------------------------------------------------------------

def read_json_entries(spark: SparkSession, path: str) -> DataFrame:
    """Log entries kept as JSON lines; malformed lines and lines without a time are skipped."""
    entries = spark.read.schema(schemas.LOG_ENTRY).option("mode", "DROPMALFORMED").json(path)
    return entries.filter(F.col("timestamp").isNotNull())


def recent_entries(spark: SparkSession, path: str, minutes: int = 10, as_of: Instant = None) -> DataFrame:
    """Entries of the last minutes from the JSON-lines store, by time; empty when it is missing."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schemas.LOG_ENTRY)
    return recent(read_json_entries(spark, path), as_of, minutes=minutes).orderBy("timestamp")


def metadata_map(column: str = "metadata") -> Column:
    """JSON metadata as a map, null when it does not parse."""
    return F.from_json(column, "map<string,string>")


# -- raw lines to logs ------------------------------------------------------------------------

def normalise(raw: DataFrame, as_of: Instant = None) -> DataFrame:
    """Raw log rows to the ``logs`` schema: the time is parsed once here, and the level follows
    from the message. Rows whose time does not parse keep ``as_of`` as their time."""
    moment = F.coalesce(text.to_timestamp_utc("timestamp"), instant(as_of, T.TimestampType()))
    now = instant(as_of, T.TimestampType())
    empty = F.lit("")
    values = {
        "timestamp": moment,
        "timestamp_unix": F.unix_micros(moment) / 1e6,
        "source": F.coalesce("source_type", empty),
        "level": taxonomy.level_of("message"),
        "message": F.coalesce("message", empty),
        "thread_id": empty,
        "log_type": empty,
        "activity_id": empty,
        "pid": F.lit(0),
        "ttl": F.lit(0),
        "host": F.coalesce("host", empty),
        "processor": empty,
        "ingestion_time": now,
        "metadata": F.to_json(F.struct("file")),
    }
    return raw.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in schemas.LOGS.fields])


# -- models -----------------------------------------------------------------------------------

def model_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MODEL_METADATA).json(f"{path}/metadata")


def load_newest_model(spark: SparkSession, path: str) -> PipelineModel | None:
    """The model of the latest recorded run, None when there is none."""
    if not path_exists(spark, f"{path}/metadata"):
        return None
    newest = model_runs(spark, path).orderBy(F.col("timestamp").desc(), F.col("model_path").desc()).first()
    return PipelineModel.load(newest["model_path"]) if newest else None
