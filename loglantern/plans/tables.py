"""The given tables, and the log views that Spark derives from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Message templates of the derived log view, by position; True adds a running suffix. Fixed values.
TEMPLATES: tuple[tuple[str, bool], ...] = (
    ("Connection ERROR: request to upstream service failed after retry, closing socket and releasing the held resources", True),
    ("sandbox violation: process denied file-read-data on protected path /private/var/db and the request was blocked now", True),
    ("thermal sensor reports battery temperature above limit while the usb and bluetooth radios stay powered up today", True),
    ("assertion failed: 21G72: libxpc.dylib + 12345 panic in a long enough line that would pass the eighty char limit", True),
    ("Statistics: 1024 packets, wifi disk usage and security counters are listed in this deliberately long noise line", True),
    ("configured with --enable-security --enable-usb --enable-audio flags and many others so that the line is long enough", True),
    ("warning: deprecated API used", False),
    ("debug trace enter function", False),
    ("", False),
    ("session opened for user", True),
    ("slow query: cpu and memory pressure is high, the load on this machine has been growing for the last few minutes", False),
    ("kernel PANIC", False),
    ("café démarré après délai: " + "é" * 45, False),
    ("crash report written: " + "x" * 166 + " tail", True),
    ("   ", False),
    ("Unauthorized access", False),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_logs(events: DataFrame) -> DataFrame:
    """Event rows seen as log rows: a projection only, so filters on time reach the event scan."""
    text_of = F.array(*[F.lit(body) for body, _ in TEMPLATES])
    numbered = F.array(*[F.lit(suffix) for _, suffix in TEMPLATES])
    which = (F.col("event_id") % len(TEMPLATES)).cast("int")
    body = F.get(text_of, which)
    suffix = F.concat(F.lit(" #"), (F.col("event_id") % 500).cast("string"))
    kind = F.col("event_type")
    level = F.when(kind == "error", "error").when(kind == "signup", "warning").when(kind == "click", "debug")
    return events.select(
        F.col("event_id").alias("log_id"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source"),
        level.otherwise("info").alias("level"),
        F.when(F.get(numbered, which), F.concat(body, suffix)).otherwise(body).alias("message"),
        (F.col("user_id") % 7).alias("pid"),
        F.concat(F.lit("t"), (F.col("event_id") % 64).cast("string")).alias("thread_id"),
        F.concat(F.lit("host-"), (F.col("user_id") % 7).cast("string")).alias("host"),
        F.concat(F.lit("/var/log/app_"), (F.col("user_id") % 5).cast("string"), F.lit(".log")).alias("file"),
        F.lit("file").alias("source_type"),
        F.col("props").alias("metadata"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_logs(table(spark, sf_dir, "events"))


def log_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given vectors with the log row of the same id."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("log_id"), "embedding")
    return vectors.join(logs(spark, sf_dir), "log_id")


def dimension(vectors: DataFrame, column: str = "embedding") -> int:
    """Size of the stored vectors, from one row."""
    row = vectors.filter(F.col(column).isNotNull()).select(F.size(column)).first()
    return row[0] if row else 0
