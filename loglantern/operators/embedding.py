"""Text to unit vectors, and the incremental upkeep of the vector table.

The default encoder is lexical: hashed words weighted by rarity. It finds messages that share words,
not messages that share a meaning. A sentence model can be plugged in with ``model_encoder``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text, vectors
from ..schemas import log_id
from ..session import shared_dir
from .ranking import oldest

# Size of a message vector. Fixed value.
DIMENSION = 384

# Texts handed to a sentence model in one call. Fixed value.
ENCODE_BATCH = 32

Encoder = Callable[[DataFrame, str, str], DataFrame]


# Bytes of stored data that one task encodes, where the files are too few to keep tasks that small.
TASK_BYTES = 1 << 20


def spread(df: DataFrame, task_bytes: int = TASK_BYTES, tasks: int | None = None) -> DataFrame:
    """Rows dealt to as many tasks as their stored bytes ask for, if the scan has fewer.

    Encoding takes far longer than reading, and a file of one row group is one task however many cores there are. Beyond
    the session's shuffle partitions the scan has tasks enough, and nothing is dealt.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if tasks is None else tasks
    wanted = min(most, -(-size // task_bytes))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


# -- encoders ---------------------------------------------------------------------------------

def fit_lexical(texts: DataFrame, column: str = "message", dim: int = DIMENSION, min_docs: int = 0) -> PipelineModel:
    """Learns the word weights in one pass over the texts. Keep the result: logs and questions must
    be encoded by the same weights."""
    stages = [
        RegexTokenizer(inputCol=column, outputCol="__words", pattern=r"[^\p{L}\p{N}]+", minTokenLength=1),
        HashingTF(inputCol="__words", outputCol="__counts", numFeatures=dim),
        IDF(inputCol="__counts", outputCol="__weighted", minDocFreq=min_docs),
        Normalizer(inputCol="__weighted", outputCol="__unit", p=2.0),
    ]
    return Pipeline(stages=stages).fit(texts.select(F.coalesce(F.col(column), F.lit("")).alias(column)))


def lexical_encoder(model: PipelineModel) -> Encoder:
    """Row-wise JVM encoder: no shuffle and no Python worker, in batch and streaming alike."""
    read_from = model.stages[0].getInputCol()

    def encode(df: DataFrame, column: str, output: str) -> DataFrame:
        kept = df.columns
        renamed = df.select(*[F.col(c).alias(f"__in_{c}") for c in kept]).withColumn(
            read_from, F.coalesce(F.col(f"__in_{column}"), F.lit(""))
        )
        done = model.transform(renamed)
        return done.select(
            *[F.col(f"__in_{c}").alias(c) for c in kept],
            vector_to_array("__unit", "float32").alias(output),
        )

    return encode


def model_encoder(load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = ENCODE_BATCH) -> Encoder:
    """Encoder around a sentence model. ``load`` runs once per Python worker and returns a function
    from a list of texts to a matrix with one row per text."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in parts:
            values = texts.fillna("").tolist()
            rows = [model(values[i : i + batch]) for i in range(0, len(values), batch)]
            matrix = np.concatenate(rows).astype(np.float64) if rows else np.empty((0, 0))
            matrix /= np.linalg.norm(matrix, axis=1, keepdims=True) + vectors.EPSILON
            yield pd.Series(list(matrix.astype(np.float32)))

    def encode(df: DataFrame, column: str, output: str) -> DataFrame:
        return df.withColumn(output, run(F.col(column)))

    return encode


def embed(df: DataFrame, encoder: Encoder, column: str = "message", output: str = "embedding") -> DataFrame:
    """Adds the unit vector of a text column; surrounding white space does not count."""
    stripped = "__stripped"
    return encoder(df.withColumn(stripped, text.strip(column)), stripped, output).drop(stripped)


def embed_once_per_text(
    df: DataFrame, encoder: Encoder, column: str = "message", output: str = "embedding", hot_share: float = 0.001
) -> DataFrame:
    """As ``embed``, but runs the encoder once per distinct text. For encoders that cost more than a
    shuffle; logs repeat heavily.

    A text that makes up more than ``hot_share`` of the rows would overload one join task. There
    can be at most 1 / hot_share such texts, so their vectors are broadcast and their rows stay
    where they are; all other rows join by a hash of the text.
    """
    if not 0 < hot_share <= 1:
        raise ValueError("hot_share must be in (0, 1]")
    shared_dir(df.sparkSession)
    given = F.coalesce(F.col(column), F.lit(""))
    source = df.withColumn("__key", F.sha2(given, 256))
    counts = source.groupBy("__key", given.alias("__text")).agg(F.count(F.lit(1)).alias("__n"))
    # Costly vectors are computed once and kept: a checkpoint survives the loss of executors.
    distinct = embed(counts, encoder, "__text", output).select("__key", "__n", output).checkpoint()
    total = distinct.agg(F.sum("__n")).first()[0] or 0
    is_hot = F.col("__n") > total * hot_share
    hot = distinct.filter(is_hot).select("__key", F.col(output).alias("__hot"))
    cold = distinct.filter(~is_hot).select("__key", output)
    marked = source.join(F.broadcast(hot), "__key", "left")
    frequent = marked.filter(F.col("__hot").isNotNull()).select(*df.columns, F.col("__hot").alias(output))
    rare = marked.filter(F.col("__hot").isNull()).drop("__hot").join(cold, "__key")
    return frequent.unionByName(rare.select(*df.columns, output))


# -- incremental upkeep -----------------------------------------------------------------------

def pending(raw: DataFrame, done: DataFrame, key: str = "log_id", message: str = "message") -> DataFrame:
    """Rows with a message that have no vector yet.

    ``done`` is reduced to its distinct keys on the map side, so replays in it do not widen the
    join; adaptive execution splits a crowded key on the raw side, as an anti join allows.
    """
    return raw.filter(text.not_empty(message)).join(done.select(key).distinct(), key, "left_anti")


def with_log_id(raw: DataFrame) -> DataFrame:
    return raw if "log_id" in raw.columns else raw.withColumn("log_id", log_id())


def backfill_rows(raw: DataFrame, done: DataFrame, encoder: Encoder, max_rows: int | None = None) -> DataFrame:
    """New rows of the vector table, one per key, with ``copies``, how many raw rows share it; oldest first when ``max_rows``
    is set. Copies merge as partial groups, so a line that repeats is encoded once and no key is crowded."""
    keyed = with_log_id(raw).filter(text.not_empty("message"))
    columns = [F.first(c).alias(c) for c in ("message", "timestamp", "host", "file")]
    once = keyed.groupBy("log_id").agg(F.count(F.lit(1)).alias("copies"), *columns)
    todo = pending(once, done)
    if max_rows is not None:
        todo = oldest(todo, max_rows)
    return embed(todo, encoder).select(
        "log_id",
        "message",
        F.col("timestamp").cast("string").alias("timestamp"),
        "host",
        "file",
        vectors.to_float("embedding").alias("embedding"),
        "copies",
    )


def text_vectors(
    logs: DataFrame, encoder: Encoder, metadata: Column | None = None, max_rows: int | None = None
) -> DataFrame:
    """The vector set over structured log texts, for a full rebuild. Blank texts are left out.

    ``max_rows`` keeps the oldest rows only; unset, every log is taken.
    """
    if max_rows is not None:
        logs = oldest(logs, max_rows)
    texts = logs.select(text.log_text(metadata=metadata).alias("text")).filter(text.not_blank("text"))
    return encoder(texts, "text", "embedding").select(
        "text", vectors.to_float("embedding").alias("embedding"), F.current_timestamp().alias("updated_at")
    )


# -- statistics of the vector table -----------------------------------------------------------

def store_stats(
    store: DataFrame, dim: int = DIMENSION, text_column: str = "text", updated: str = "updated_at"
) -> DataFrame:
    """Count, dimension, average text length in characters, estimated size and last update."""
    size = F.count(F.lit(1)) * F.lit(float(dim * 4)) / F.lit(float(1 << 20))
    return store.agg(
        F.count(F.lit(1)).alias("total_embeddings"),
        F.lit(dim).alias("embedding_dimension"),
        F.round(F.avg(F.length(text_column).cast("double")), 1).alias("average_embedding_length"),
        F.round(size, 2).alias("memory_usage_mb"),
        F.max(updated).alias("last_updated"),
    )


def text_distribution(store: DataFrame, text_column: str = "text") -> DataFrame:
    """Rows by the source and by the level read back from the texts, as (kind, key, count).

    The texts are reduced to one count per (source, level) before the two breakdowns are made.
    """
    parsed = store.select(text.parse_source(text_column).alias("s"), text.parse_level(text_column).alias("l"))
    small = parsed.groupBy("s", "l").agg(F.count(F.lit(1)).alias("n"))
    both = F.array(
        F.struct(F.lit("source").alias("kind"), F.col("s").alias("key")),
        F.struct(F.lit("level").alias("kind"), F.col("l").alias("key")),
    )
    return (
        small.select(F.explode(both).alias("e"), "n")
        .filter(F.col("e.key").isNotNull())
        .groupBy(F.col("e.kind").alias("kind"), F.col("e.key").alias("key"))
        .agg(F.sum("n").alias("count"))
    )
