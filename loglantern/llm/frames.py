"""Reading tables and writing intermediate ones."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loglantern.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, stored once in the shared folder and read back: cuts lineage and outlives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Has shuffle files of finished work removed: Spark drops those that nothing refers to, once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for batches of a task, which then gives the memory it is done with back to the system.

    Workers are reused: what one has freed but not given back stays with the executor while later stages run.
    """

    @functools.wraps(run)
    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return inner


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def plainly(df: DataFrame, *known: str) -> DataFrame:
    """The rows with all columns but the known ones named by their place, so that no name clashes with a working column."""
    return df.toDF(*[c if c in known else f"_c{i}" for i, c in enumerate(df.columns)])
