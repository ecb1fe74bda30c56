"""The jobs a user runs: collect, report, backfill, train, answer."""

from __future__ import annotations

import time

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions import taxonomy, text
from ..functions.times import Instant
from ..operators import classification, embedding, reports, search
from ..session import scratch_path
from ..sources import readers, tail, writers
from ..streaming import ingest


# -- reports ----------------------------------------------------------------------------------

def message_profile(logs: DataFrame) -> DataFrame:
    """All that the reports want to know from the messages, one row per length bucket.

    The length histogram, the severity estimate, the category counts and the time range are then
    sums over a few hundred rows: the messages, by far the widest column, are read once, not four
    times.
    """
    flags = {
        **taxonomy.flags("message", taxonomy.SEVERITY_WORDS, "est_"),
        **taxonomy.flags("message", taxonomy.CATEGORY_WORDS, "is_"),
    }
    known = {name: F.col(name) if name in logs.columns else flag for name, flag in flags.items()}
    flagged = logs.select("timestamp", "message", *[flag.alias(name) for name, flag in known.items()])
    return flagged.groupBy(text.length_bucket("message").alias("bucket"), text.not_empty("message").alias("has_text")).agg(
        F.count(F.lit(1)).alias("count"),
        F.min("timestamp").alias("earliest"),
        F.max("timestamp").alias("latest"),
        *[F.count_if(F.col(name)).alias(name) for name in known],
    )


def overview(profile: DataFrame) -> DataFrame:
    """Total, time range, severity estimate and category counts as one row."""
    return profile.agg(
        F.sum("count").alias("total"),
        F.min("earliest").alias("earliest"),
        F.max("latest").alias("latest"),
        *[F.sum(f"est_{name}").alias(name) for name in taxonomy.SEVERITY_WORDS],
        *[F.sum(f"is_{name}").alias(f"category_{name}") for name in taxonomy.CATEGORY_WORDS],
    )


def histogram(profile: DataFrame) -> DataFrame:
    return profile.filter("has_text").select("bucket", "count").orderBy("bucket")


def run_reports(logs: DataFrame, folder: str, epoch: int | None = None) -> dict[str, str]:
    """Writes the standard reports as CSV and returns their paths; an empty report gives ''."""
    stamp = int(time.time()) if epoch is None else epoch
    profile = message_profile(logs).persist()
    try:
        found = {
            "top_hosts": reports.top_hosts(logs),
            "top_files": reports.top_files(logs),
            "per_minute": reports.per_minute(logs),
            "message_length_hist": histogram(profile),
            "severity_estimate": overview(profile).select(*taxonomy.SEVERITY_WORDS),
            "sample_10k": reports.sample_export(logs),
        }
        return {name: writers.export_csv(df, folder, name, epoch=stamp) for name, df in found.items()}
    finally:
        profile.unpersist()


# -- collection -------------------------------------------------------------------------------

def collect_logs(spark: SparkSession, export: str, table: str, entries: str, as_of: Instant = None) -> int:
    """Takes an OS log export in: stores the rows, then appends them with a summary row to the
    JSON-lines store. Returns the number of rows stored."""
    moment = as_of or spark.range(1).select(F.current_timestamp().cast("string")).first()[0]
    fresh = readers.read_os_log_arrays(spark, export, moment)
    columns = {
        "timestamp_unix": F.unix_micros("timestamp") / 1e6,
        "host": F.lit(""),
        "pid": F.lit(0).cast("bigint"),
        "thread_id": text.fetch("metadata", "thread", ""),
        "ingestion_time": F.lit(moment).cast("timestamp"),
        "metadata": F.to_json("metadata"),
    }
    stored = writers.store_logs(fresh.withColumns(columns), table)
    summary = reports.collection_summary(fresh, readers.read_table(spark, table), 1, F.lit(moment))
    writers.append_json(fresh.unionByName(summary), entries)
    return stored


def ingest_lines(
    spark: SparkSession, folder: str, table: str, checkpoint: str, pattern: str = "*", host: str = "", from_end: bool = False, once: bool = False, seconds: int = ingest.COLLECTION_INTERVAL
):
    """Follows the files of a folder, appended lines included, into the month-partitioned log table with its flags.

    The checkpoint holds a byte position per file and the table's own log the finished batches, so a run that was killed
    goes on where it stopped and no line is stored twice. Reports read the flags in place of the messages.
    """
    lines = tail.raw_rows(tail.follow(spark, folder, pattern, from_end), host)
    rows = writers.with_ingest_columns(readers.normalise(lines))
    return ingest.to_table(rows, table, checkpoint, once, seconds, by_month=True)


# -- vectors ----------------------------------------------------------------------------------

def backfill(
    raw: DataFrame, path: str, encoder: embedding.Encoder, max_rows: int | None = None
) -> int:
    """Adds the missing vectors to the vector table and returns how many were added.

    Running it again adds nothing, and a run that failed left nothing behind.
    """
    spark = raw.sparkSession
    done = readers.read_or_empty(spark, path, schemas.EMBEDDINGS)
    return writers.insert_embeddings(embedding.backfill_rows(raw, done, encoder, max_rows), path)


# -- classifier -------------------------------------------------------------------------------

def train(
    store: DataFrame,
    path: str,
    dim: int = embedding.DIMENSION,
    limit: int | None = classification.TRAINING_ROWS,
    max_iterations: int = classification.MAX_ITERATIONS,
    key: str = "log_id",
    data_source: str = "embeddings",
    platform: str = "spark",
) -> dict:
    """Labels, splits, trains, measures and stores; returns the run's metadata.

    The held-out rows are scored once, for the confusion counts; accuracy and the report by class follow from those, which
    are at most the square of the number of labels. Without held-out rows the accuracy is null and the report empty.
    """
    started = time.time()
    spark = store.sparkSession
    # Several passes follow over rows that took a top-n and a labelling to get: written once, they
    # are read back without either and survive the loss of executors.
    rows_path = scratch_path(spark, "training")
    labelled = classification.training_rows(store, dim, limit).select(key, "message", "embedding", "label")
    classification.stratified_split(labelled, key).write.parquet(rows_path)
    rows = spark.read.parquet(rows_path)
    labels = {r["label"]: r["count"] for r in classification.label_distribution(rows).collect()}
    sizes = {r["is_train"]: r["n"] for r in rows.groupBy("is_train").agg(F.count(F.lit(1)).alias("n")).collect()}

    fit_started = time.time()
    model = classification.train_classifier(rows.filter("is_train"), max_iterations=max_iterations)
    fitted = time.time() - fit_started
    judged = classification.predict(model, rows.filter("not is_train").select(key, "label", "embedding"))
    counts = classification.confusion_matrix(judged).orderBy("label", "prediction").collect()
    matrix = spark.createDataFrame(counts, schemas.CONFUSION)
    report = classification.classification_report(matrix).orderBy("name").collect()
    measured = sum(r["count"] for r in counts)
    score = sum(r["count"] for r in counts if r["label"] == r["prediction"]) / measured if measured else None
    metadata = {
        "training_time": fitted,
        "total_time": time.time() - started,
        "accuracy": score,
        "samples_trained": sizes.get(True, 0),
        "samples_validated": sizes.get(False, 0),
        "label_distribution": labels,
        "timestamp": int(time.time()),
        "data_source": data_source,
        "embeddings_count": sum(labels.values()),
        "model_type": "OneVsRest logistic regression with StandardScaler",
        "platform": platform,
        "report": [r.asDict() for r in report],
        "confusion_matrix": [r.asDict() for r in counts],
    }
    metadata["model_path"] = writers.save_model(model, metadata, spark, path)
    return metadata


def classify(
    texts: DataFrame, encoder: embedding.Encoder, model: PipelineModel, column: str = "message"
) -> DataFrame:
    """Label and class probabilities of a text column, by the encoder the model was trained with."""
    return classification.predict(model, embedding.embed(texts, encoder, column)).drop("embedding")


# -- questions --------------------------------------------------------------------------------

def answer(
    questions: DataFrame,
    logs: DataFrame,
    store: DataFrame,
    encoder: embedding.Encoder,
    top: int = 10,
    dim: int = embedding.DIMENSION,
    threshold: float = search.SEMANTIC_THRESHOLD,
) -> DataFrame:
    """Answers a table of questions (qid, query); the questions are encoded as the logs were."""
    return search.hybrid_search(embedding.embed(questions, encoder, "query"), logs, store, top, dim, threshold)
