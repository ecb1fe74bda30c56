"""Removal of expired rows from the month-partitioned log table.

A whole expired month is dropped without being read. Only the month that holds the cutoff is
rewritten: its kept rows go to a staging folder inside the table (names with a leading underscore
are invisible to readers), and only after that job has been committed does the folder take the
month's place. A run that stops half-way is finished or undone by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..functions.times import Instant, ago, month_number
from ..schemas import LOGS
from ..sources.readers import path_exists, read_table
from ..sources.writers import COMPRESSION

RETENTION_DAYS = 30
TTL_DAYS = 365
_STAGING = "_retention"


def _fs(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())


def _hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _months(spark: SparkSession, path: str) -> list[int]:
    statuses = _fs(spark, path).listStatus(_hadoop_path(spark, path))
    names = [status.getPath().getName() for status in statuses]
    return sorted(int(n.split("=", 1)[1]) for n in names if n.startswith("ym="))


def _drop(spark: SparkSession, path: str) -> None:
    _fs(spark, path).delete(_hadoop_path(spark, path), True)


def _swap(spark: SparkSession, path: str, month: int) -> None:
    """Puts a committed staging folder in its month's place."""
    staged, target = f"{path}/{_STAGING}/ym={month}", f"{path}/ym={month}"
    _drop(spark, target)
    if not _fs(spark, path).rename(_hadoop_path(spark, staged), _hadoop_path(spark, target)):
        raise OSError(f"could not move {staged} to {target}")


def recover(spark: SparkSession, path: str) -> None:
    """Finishes a swap that was cut short, or discards a staging folder that was never committed."""
    staging = f"{path}/{_STAGING}"
    if not path_exists(spark, staging):
        return
    for status in _fs(spark, path).listStatus(_hadoop_path(spark, staging)):
        name = status.getPath().getName()
        if name.startswith("ym=") and path_exists(spark, f"{staging}/{name}/_SUCCESS"):
            _swap(spark, path, int(name.split("=", 1)[1]))
    _drop(spark, staging)


def cleanup(spark: SparkSession, path: str, as_of: Instant = None, days: int = RETENTION_DAYS) -> int:
    """Removes rows strictly older than the span and returns how many there were."""
    recover(spark, path)
    kind = LOGS["timestamp"].dataType
    bound = ago(as_of, kind, days=days)
    # One value, held for the whole run.
    cut = spark.range(1).select(bound.cast("string").alias("at"), month_number(bound).alias("ym")).first()
    moment = F.lit(cut["at"]).cast("timestamp")
    removed = 0
    for month in _months(spark, path):
        if month > cut["ym"]:
            continue
        folder = f"{path}/ym={month}"
        rows = read_table(spark, folder)
        if month < cut["ym"]:
            removed += rows.count()  # answered from file footers
            _drop(spark, folder)
            continue
        old = F.coalesce(F.col("timestamp").cast("timestamp") < moment, F.lit(False))
        removed += _rewrite(spark, path, month, rows, old)
    _drop(spark, f"{path}/{_STAGING}")
    return removed


def _rewrite(spark: SparkSession, path: str, month: int, rows: DataFrame, old) -> int:
    expired = rows.filter(old).count()  # reads the time column only
    if not expired:
        return 0
    staged = f"{path}/{_STAGING}/ym={month}"
    seen = Observation()
    kept = rows.filter(~old).observe(seen, F.count(F.lit(1)).alias("rows"))
    kept.write.mode("overwrite").option("compression", COMPRESSION).parquet(staged)
    if seen.get["rows"]:
        _swap(spark, path, month)
    else:
        _drop(spark, f"{path}/ym={month}")
    return expired
