"""Declared schemas of the tables and wire records, and the stable row key."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()
_MAP = T.MapType(T.StringType(), T.StringType())

# Level names and their rank in the stored enumeration. Fixed values.
LEVEL_RANKS = {"info": 1, "warning": 2, "error": 3, "debug": 4}

# Levels that the statistics report always lists, in its order. Fixed values.
REPORTED_LEVELS = ("debug", "info", "warning", "error", "critical")

LOGS = _struct(
    timestamp=_TS,
    timestamp_unix=_D,
    source=_S,
    level=_S,
    message=_S,
    thread_id=_S,
    log_type=_S,
    activity_id=_S,
    pid=_L,
    ttl=_L,
    host=_S,
    processor=_S,
    ingestion_time=_TS,
    metadata=_S,
)

RAW_LOGS = _struct(timestamp=_S, host=_S, file=_S, source_type=_S, message=_S)

EMBEDDINGS = _struct(
    log_id=_S,
    message=_S,
    timestamp=_S,
    host=_S,
    file=_S,
    embedding=T.ArrayType(T.FloatType()),
    copies=_L,
)

TEXT_VECTORS = _struct(text=_S, embedding=T.ArrayType(T.FloatType()), updated_at=_TS)

LOG_ENTRY = _struct(timestamp=_TS, source=_S, level=_S, message=_S, metadata=_MAP)

# Column that catches a malformed line when JSON entries are read.
CORRUPT_RECORD = "_corrupt_record"

OS_LOG_RECORD = _struct(
    timestamp=_S,
    source=_S,
    eventMessage=_S,
    subsystem=_S,
    category=_S,
    process=_S,
    thread=_S,
    eventType=_S,
    messageType=_S,
)

CONFUSION = _struct(label=_S, prediction=_S, count=_L)

REPORT = _struct(name=_S, precision=_D, recall=_D, f1=_D, support=_L)

MODEL_METADATA = _struct(
    model_path=_S,
    training_time=_D,
    total_time=_D,
    accuracy=_D,
    samples_trained=_L,
    samples_validated=_L,
    label_distribution=T.MapType(T.StringType(), T.LongType()),
    timestamp=_L,
    data_source=_S,
    embeddings_count=_L,
    model_type=_S,
    platform=_S,
    report=T.ArrayType(REPORT),
    confusion_matrix=T.ArrayType(CONFUSION),
)


def log_id(timestamp: str = "timestamp", host: str = "host", file: str = "file", message: str = "message") -> Column:
    """Content key of a raw log row; byte-identical rows share it, and share their vector too."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (timestamp, host, file, message)]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def level_rank(level: Column | str) -> Column:
    """Position of a level in the stored enumeration, null for any other text."""
    col = F.col(level) if isinstance(level, str) else level
    ranks = iter(LEVEL_RANKS.items())
    name, rank = next(ranks)
    chain = F.when(col == name, F.lit(rank))
    for name, rank in ranks:
        chain = chain.when(col == name, F.lit(rank))
    return chain


def is_known_level(level: Column | str) -> Column:
    col = F.col(level) if isinstance(level, str) else level
    return F.coalesce(col.isin(*LEVEL_RANKS), F.lit(False))
