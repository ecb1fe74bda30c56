"""One layout for tables that batches and streams write, and its upkeep while a stream runs.

A table is a folder of months (``ym=202401``) with Parquet files, which any reader takes as it is. A batch is written
beside the table first and its files then move into their months under names that carry the batch's number; a batch that
is run again replaces its own files. Expiry and merging work on files by name, as listed when they start: new files are
written aside, a marker then names what comes and what goes, and only after that files move and are removed. What a
stream adds meanwhile isn't on the list and stays. A run that stopped half-way is undone if its marker is missing, and
finished from the marker if not.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text
from ..functions.times import Instant, ago, month_number
from ..schemas import LOGS

COMPRESSION = "zstd"
# Files below this size are merged into files of about this size.
FILE_BYTES = 128 << 20
# Greatest number of rows of such a file: one task sorts them, and a compressed file may unfold to many times its size.
FILE_ROWS = 1_000_000
_BATCHES = "_batches"
_UPKEEP = "_upkeep"


class _Store:
    """The file system that a table lies in."""

    def __init__(self, spark: SparkSession, path: str):
        self.path_of = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.jvm = spark._jvm

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path_of(path))

    def entries(self, path: str) -> list[tuple[str, int]]:
        """Names and sizes of what a folder holds."""
        if not self.exists(path):
            return []
        return sorted((s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(self.path_of(path)))

    def drop(self, path: str) -> None:
        self.fs.delete(self.path_of(path), True)

    def move(self, old: str, new: str) -> None:
        """Does nothing if it was done before."""
        if not self.exists(old):
            if self.exists(new):
                return
            raise FileNotFoundError(old)
        self.drop(new)
        self.fs.mkdirs(self.path_of(new).getParent())
        if not self.fs.rename(self.path_of(old), self.path_of(new)):
            raise OSError(f"could not move {old} to {new}")

    def write(self, path: str, data: str) -> None:
        """Whole or not at all: the name appears once the text is there."""
        part = f"{path}.part"
        out = self.fs.create(self.path_of(part), True)
        out.write(bytearray(data.encode()))
        out.close()
        self.move(part, path)

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path_of(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


def _months(store: _Store, path: str) -> list[int]:
    return [int(name[3:]) for name, _ in store.entries(path) if re.fullmatch(r"ym=\d+", name)]


def _files(store: _Store, path: str, month: int) -> list[tuple[str, int]]:
    return [(name, size) for name, size in store.entries(f"{path}/ym={month}") if name.endswith(".parquet") and not name.startswith(("_", "."))]


def _take_in(store: _Store, staged: str, path: str, prefix: str) -> list[tuple[str, str]]:
    """Where the files of a staged table go: (from, to)."""
    out = []
    for month in _months(store, staged):
        for k, (name, _) in enumerate(_files(store, staged, month)):
            out.append((f"{staged}/ym={month}/{name}", f"{path}/ym={month}/{prefix}-{k:05d}.parquet"))
    return out


def land(rows: DataFrame, path: str, batch_id: int) -> None:
    """Adds a batch to the table; the same batch again replaces what it added. Rows have ``timestamp``."""
    spark, prefix = rows.sparkSession, f"b{batch_id:012d}"
    store = _Store(spark, path)
    staged = f"{path}/{_BATCHES}/{prefix}"
    placed = rows.withColumn("ym", text.year_month("timestamp")).sortWithinPartitions("ym", "timestamp")
    placed.write.mode("overwrite").partitionBy("ym").option("compression", COMPRESSION).parquet(staged)
    for month in _months(store, path):
        for name, _ in _files(store, path, month):
            if name.startswith(f"{prefix}-"):
                store.drop(f"{path}/ym={month}/{name}")
    for old, new in _take_in(store, staged, path, prefix):
        store.move(old, new)
    store.drop(staged)


def land_stream(stream: DataFrame, path: str, checkpoint: str, once: bool = False, seconds: int = 600):
    """Keeps adding the batches of a stream to the table."""
    writer = stream.writeStream.foreachBatch(lambda batch, batch_id: land(batch, path, batch_id)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def read_landed(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The table; with ``schema``, empty when nothing has landed yet."""
    if schema is not None and not _months(_Store(spark, path), path):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)


# -- upkeep -----------------------------------------------------------------------------------

def recover(spark: SparkSession, path: str) -> None:
    """Finishes upkeep whose marker is there, and throws away what has none."""
    store = _Store(spark, path)
    for name, _ in store.entries(f"{path}/{_UPKEEP}"):
        run = f"{path}/{_UPKEEP}/{name}"
        if store.exists(f"{run}/marker"):
            _finish(store, run)
        else:
            store.drop(run)


def _finish(store: _Store, run: str) -> None:
    marker = json.loads(store.read(f"{run}/marker"))
    for old, new in marker["come"]:
        store.move(old, new)
    for gone in marker["go"]:
        store.drop(gone)
    store.drop(run)


def _swap(spark: SparkSession, path: str, month: int, names: list[str], keep: Column | None, files: int) -> None:
    """Replaces the named files of a month by ``files`` files of their rows, those that ``keep`` leaves."""
    store = _Store(spark, path)
    run, prefix = f"{path}/{_UPKEEP}/{uuid.uuid4().hex}", f"m{uuid.uuid4().hex}"
    rows = spark.read.parquet(*[f"{path}/ym={month}/{name}" for name in names])
    rows = rows if keep is None else rows.filter(keep)
    # Rows of one instant, however many, may go to several files.
    other = [f.name for f in rows.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    ordered = rows.repartitionByRange(files, "timestamp", F.xxhash64(*other)).sortWithinPartitions("timestamp") if files > 1 else rows.coalesce(1).sortWithinPartitions("timestamp")
    ordered.withColumn("ym", F.lit(month)).write.partitionBy("ym").option("compression", COMPRESSION).parquet(f"{run}/new")
    come = _take_in(store, f"{run}/new", path, prefix)
    store.write(f"{run}/marker", json.dumps({"come": come, "go": [f"{path}/ym={month}/{name}" for name in names]}))
    _finish(store, run)


def expire(spark: SparkSession, path: str, as_of: Instant = None, days: int = 30) -> int:
    """Removes rows strictly older than the span and returns how many there were.

    Files of expired months go unread, but for their number of rows; in the month that holds the cutoff only files with
    expired rows are written anew.
    """
    recover(spark, path)
    store = _Store(spark, path)
    kind = LOGS["timestamp"].dataType
    bound = ago(as_of, kind, days=days)
    cut = spark.range(1).select(bound.cast("string").alias("at"), month_number(bound).alias("ym")).first()
    old = F.coalesce(F.col("timestamp").cast("timestamp") < F.lit(cut["at"]).cast("timestamp"), F.lit(False))
    removed = 0
    for month in _months(store, path):
        names = [name for name, _ in _files(store, path, month)]
        if month > cut["ym"] or not names:
            continue
        whole = [f"{path}/ym={month}/{name}" for name in names]
        if month < cut["ym"]:
            removed += spark.read.parquet(*whole).count()  # answered from file footers
            for name in whole:
                store.drop(name)
            continue
        found = spark.read.parquet(*whole).groupBy(_file_name().alias("name")).agg(F.count_if(old).alias("gone"), F.count(F.lit(1)).alias("rows"))
        stale = {row["name"]: row for row in found.filter("gone > 0").collect()}
        for name in [n for n, row in stale.items() if row["gone"] == row["rows"]]:
            store.drop(f"{path}/ym={month}/{name}")
        partly = [n for n, row in stale.items() if row["gone"] < row["rows"]]
        if partly:
            sizes = dict(_files(store, path, month))
            _swap(spark, path, month, partly, ~old, _files_for(sum(sizes[n] for n in partly), sum(stale[n]["rows"] - stale[n]["gone"] for n in partly)))
        removed += sum(row["gone"] for row in stale.values())
    return removed


def _file_name() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def _files_for(size: int, rows: int, file_bytes: int = FILE_BYTES, file_rows: int = FILE_ROWS) -> int:
    return max(1, -(-size // file_bytes), -(-rows // file_rows))


def _small(spark: SparkSession, path: str, month: int, file_bytes: int, file_rows: int) -> tuple[list[str], int]:
    """Small files of a month to merge, and into how many."""
    small = {name: size for name, size in _files(_Store(spark, path), path, month) if size < file_bytes // 2}
    if len(small) < 2:
        return [], 0
    rows = spark.read.parquet(*[f"{path}/ym={month}/{name}" for name in small]).groupBy(_file_name().alias("name")).count()
    rows = {row["name"]: row["count"] for row in rows.collect()}  # a file without rows isn't there
    names = [name for name in small if rows.get(name, 0) < file_rows // 2]
    return names, _files_for(sum(small[n] for n in names), sum(rows.get(n, 0) for n in names), file_bytes, file_rows)


def compact(spark: SparkSession, path: str, file_bytes: int = FILE_BYTES, file_rows: int = FILE_ROWS) -> int:
    """Merges the small files of each month and returns how many files there are fewer."""
    recover(spark, path)
    store, fewer = _Store(spark, path), 0
    for month in _months(store, path):
        names, files = _small(spark, path, month, file_bytes, file_rows)
        if files < len(names):
            _swap(spark, path, month, names, None, files)
            fewer += len(names) - files
    return fewer
