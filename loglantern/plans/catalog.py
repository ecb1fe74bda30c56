"""Every operator as a query over the given tables: name -> f(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import taxonomy, text, vectors
from ..functions.times import instant, latest
from ..operators import classification, embedding, filters, ivf, knn, quantised, ranking, reports, retention, search
from ..schemas import level_rank
from ..session import scratch_path, shared_dir
from ..sources import file_index, landing, readers, tail, writers
from ..streaming import ingest, trends
from . import jobs
from .tables import as_logs, dimension, log_embeddings, logs, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    """Registers a query. Results show time without a zone, as the given tables hold it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        shared_dir(spark)
        df = f(spark, sf_dir)
        zoned = [c.name for c in df.schema.fields if isinstance(c.dataType, T.TimestampType)]
        return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned})

    run.__name__ = f.__name__
    _QUERIES[f.__name__] = run
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _as_of(spark: SparkSession, sf_dir: str) -> str:
    """The reports' "now": the given data has ended, so its last event stands in for the clock."""
    return latest(table(spark, sf_dir, "events"), "ts")


# -- reports over logs ------------------------------------------------------------------------

@_query
def log_range_stats(spark, sf):
    return reports.range_stats(logs(spark, sf))


@_query
def total_count(spark, sf):
    return reports.total_count(logs(spark, sf))


@_query
def top_hosts(spark, sf):
    return reports.top_hosts(logs(spark, sf))


@_query
def top_files(spark, sf):
    return reports.top_files(logs(spark, sf))


@_query
def per_minute(spark, sf):
    return reports.per_minute(logs(spark, sf))


@_query
def per_minute_text(spark, sf):
    """The same over time held as text, as raw rows hold it."""
    raw = logs(spark, sf).withColumn("timestamp", F.col("timestamp").cast("string"))
    return reports.per_minute(raw)


@_query
def length_histogram(spark, sf):
    return reports.length_histogram(logs(spark, sf))


@_query
def length_histogram_docs(spark, sf):
    return reports.length_histogram(table(spark, sf, "documents"), "text")


@_query
def severity_estimate(spark, sf):
    return reports.severity_estimate(logs(spark, sf))


@_query
def severity_estimate_docs(spark, sf):
    return reports.severity_estimate(table(spark, sf, "documents").withColumnRenamed("text", "message"))


@_query
def level_counts(spark, sf):
    return reports.level_counts(logs(spark, sf))


@_query
def level_counts_ranked(spark, sf):
    return reports.level_counts_ranked(logs(spark, sf))


@_query
def level_share(spark, sf):
    return reports.level_share(logs(spark, sf))


@_query
def top_sources(spark, sf):
    return reports.top_sources(logs(spark, sf))


@_query
def hourly_counts(spark, sf):
    return reports.hourly_counts(logs(spark, sf), 24, _as_of(spark, sf))


@_query
def error_trend(spark, sf):
    return reports.error_trend(logs(spark, sf), 24, _as_of(spark, sf))


@_query
def log_statistics(spark, sf):
    return reports.log_statistics(logs(spark, sf), 24 * 60, _as_of(spark, sf))


@_query
def log_statistics_all(spark, sf):
    return reports.log_statistics(logs(spark, sf), None)


@_query
def insights_summary(spark, sf):
    return reports.insights_summary(logs(spark, sf))


@_query
def insights_summary_since(spark, sf):
    """The summary with its time span really applied."""
    rows = filters.recent(logs(spark, sf), _as_of(spark, sf), hours=24)
    return reports.insights_summary(rows)


@_query
def overview(spark, sf):
    """Totals, range, severity and categories from one pass over the messages."""
    return jobs.overview(jobs.message_profile(logs(spark, sf)))


@_query
def recent_activity(spark, sf):
    return reports.recent_activity(logs(spark, sf), _as_of(spark, sf))


@_query
def category_flags(spark, sf):
    return reports.category_flags(logs(spark, sf)).select("log_id", "is_error", "is_security", "is_hardware")


@_query
def category_samples(spark, sf):
    return reports.category_samples(logs(spark, sf))


@_query
def dashboard_samples(spark, sf):
    return reports.dashboard_samples(logs(spark, sf))


@_query
def collection_summary(spark, sf):
    """The summary row of a collection run, its counts read back from the metadata map."""
    rows = logs(spark, sf)
    as_of = _as_of(spark, sf)
    summary = reports.collection_summary(rows, rows.filter(text.not_empty("message")), 24 * 60, as_of)
    numbers = ("parsed_entries", "stored_entries", "total_logs")
    levels = F.from_json(F.col("metadata")["by_level"], "map<string,bigint>")
    return summary.select(
        "timestamp",
        "source",
        "level",
        "message",
        *[F.col("metadata")[n].cast("bigint").alias(n) for n in numbers],
        *[levels[name].alias(f"level_{name}") for name in ("info", "error", "critical")],
    )


# -- filters and row lists --------------------------------------------------------------------

@_query
def search_logs(spark, sf):
    return reports.search_logs(logs(spark, sf), search_term="request", source="src3", level="error")


@_query
def search_logs_unfiltered(spark, sf):
    return reports.search_logs(logs(spark, sf))


@_query
def logs_in_range(spark, sf):
    return filters.logs_in_range(logs(spark, sf), "2024-01-10 06:00:00", "2024-01-12 18:30:00")


@_query
def logs_last_minute(spark, sf):
    return filters.logs_last_minute(logs(spark, sf), _as_of(spark, sf))


@_query
def logs_by_source(spark, sf):
    return filters.logs_by_source(logs(spark, sf), "src3", 24 * 60, _as_of(spark, sf))


@_query
def logs_by_level(spark, sf):
    return filters.logs_by_level(logs(spark, sf), "warning", 24 * 60, _as_of(spark, sf))


@_query
def retained_logs(spark, sf):
    return filters.retained(logs(spark, sf), _as_of(spark, sf), days=7)


@_query
def oldest_sample(spark, sf):
    return reports.sample_export(logs(spark, sf))


@_query
def newest_rows(spark, sf):
    return reports.newest_rows(logs(spark, sf), 100)


@_query
def keyset_page(spark, sf):
    rows = logs(spark, sf).filter(text.not_empty("message"))
    position = (instant("2024-01-15 12:00:00", rows.schema["timestamp"].dataType), F.lit(0).cast("bigint"))
    page = ranking.page_after(rows, position, 2000, ("timestamp", "log_id"))
    return page.select("log_id", "message", "timestamp", "host", "file")


@_query
def noise_filter(spark, sf):
    """Long rows without noise, with the keyword list and with the shorter semantic list."""
    rows = logs(spark, sf).filter(text.longer_than("message"))
    return rows.select(
        "log_id",
        text.without_any("message", text.NOISE_KEYWORD).alias("keyword_ok"),
        text.without_any("message", text.NOISE_SEMANTIC).alias("semantic_ok"),
    )


@_query
def time_keys(spark, sf):
    """Minute key, month number and level rank of every row."""
    return logs(spark, sf).select(
        "log_id",
        text.minute_key(F.col("timestamp").cast("string")).alias("minute"),
        text.year_month("timestamp").alias("ym"),
        level_rank("level").alias("level_rank"),
    )


@_query
def display_rows(spark, sf):
    shown = reports.display_rows(logs(spark, sf).withColumn("score", F.lit(0.85).cast("double")), score="score")
    return shown.select("log_id", "key_150", "preview_80", "short_100", "body_300", "line_160", "match_percent")


@_query
def display_docs(spark, sf):
    """Display cuts of whole documents: many characters, several scripts, many lines."""
    shown = reports.display_rows(table(spark, sf, "documents"), "text")
    return shown.select("doc_id", "key_150", "preview_80", "short_100", "body_300", "line_160")


@_query
def blank_texts(spark, sf):
    """Rows whose text is blank, and every text's length after stripping."""
    rows = logs(spark, sf)
    return rows.select(
        "log_id", text.not_blank("message").alias("has_text"), F.length(text.strip("message")).alias("stripped_length")
    )


@_query
def dedupe_prefix(spark, sf):
    order = [F.col("timestamp").desc(), F.col("log_id").asc()]
    return reports.keep_first_by_prefix(logs(spark, sf), order).select("log_id", "timestamp", "message")


@_query
def dedupe_prefix_docs(spark, sf):
    rows = reports.keep_first_by_prefix(table(spark, sf, "documents"), [F.col("doc_id").asc()], "text")
    return rows.select("doc_id", "text")


# -- classification by words ------------------------------------------------------------------

@_query
def infer_level(spark, sf):
    return logs(spark, sf).select("log_id", taxonomy.level_of("message").alias("inferred_level"))


@_query
def weak_labels(spark, sf):
    return classification.with_label(logs(spark, sf)).select("log_id", "label")


@_query
def weak_labels_docs(spark, sf):
    return classification.with_label(table(spark, sf, "documents"), "text").select("doc_id", "label")


@_query
def label_distribution(spark, sf):
    return classification.label_distribution(classification.with_label(logs(spark, sf)))


@_query
def route_questions(spark, sf):
    """Every conversation turn routed as a question."""
    routed = search.route_questions(table(spark, sf, "conversations"), "text")
    return routed.select("conv_id", "turn", "category", F.size("keywords").alias("n_keywords"))


@_query
def route_messages(spark, sf):
    """Every log message routed as a question ("more like this line")."""
    routed = search.route_questions(logs(spark, sf), "message")
    return routed.select("log_id", "category", F.array_join("keywords", ",").alias("keywords"))


# -- structured text --------------------------------------------------------------------------

@_query
def log_text(spark, sf):
    rows = logs(spark, sf)
    return rows.select("log_id", text.log_text(metadata=readers.metadata_map()).alias("text"))


def _texts(spark, sf):
    rows = logs(spark, sf)
    return rows.select(text.log_text(metadata=readers.metadata_map()).alias("text"), F.col("timestamp").alias("updated_at"))


@_query
def text_distribution(spark, sf):
    return embedding.text_distribution(_texts(spark, sf))


@_query
def store_stats(spark, sf):
    return embedding.store_stats(_texts(spark, sf))


# -- vectors ----------------------------------------------------------------------------------

@_query
def normalize_vectors(spark, sf):
    """Vectors stretched by their label and brought back to unit length."""
    given = table(spark, sf, "embeddings")
    factor = F.col("label").cast("double") + 0.5
    stretched = given.withColumn("s", F.transform("embedding", lambda x: x.cast("double") * factor))
    unit = stretched.withColumn("u", vectors.normalize("s"))
    return unit.select(
        "vec_id",
        F.round(vectors.norm("s"), 5).alias("norm_before"),
        F.round(vectors.norm("u"), 5).alias("norm_after"),
        F.round(F.array_max("u"), 5).alias("greatest"),
        F.round(F.array_min("u"), 5).alias("least"),
    )


@_query
def semantic_topk(spark, sf):
    """The stored rows closest to the first vector."""
    store = log_embeddings(spark, sf)
    given = table(spark, sf, "embeddings")
    probe = given.orderBy("vec_id").limit(1).first()["embedding"]
    found = knn.semantic_search(store, probe, 10)
    return found.select("log_id", "message", "timestamp", "host", "file", F.round("score", 5).alias("score"))


def _self_knn(spark, sf, k, **bounds):
    given = table(spark, sf, "embeddings")
    asked = given.withColumnRenamed("vec_id", "qid")
    return knn.knn(given, asked, k, dimension(given), corpus_key="vec_id", **bounds)


@_query
def knn_batch(spark, sf):
    """The five nearest of every vector."""
    return _self_knn(spark, sf, 5).select("qid", "vec_id", F.round("score", 5).alias("score"), "rank")


@_query
def knn_blocks(spark, sf):
    """The same through the block join that serves query sets beyond the broadcast bound."""
    near = _self_knn(spark, sf, 5, max_broadcast=0, rows_per_block=512, queries_per_block=256)
    return near.select("qid", "vec_id", F.round("score", 5).alias("score"), "rank")


@_query
def knn_quantised(spark, sf):
    """The five nearest of every hundredth vector, by a first pass over vectors stored as bytes."""
    given = table(spark, sf, "embeddings")
    dim, path = dimension(given), scratch_path(spark, "quantised")
    quantised.store_coded(given, path, dim, "vec_id")
    asked = given.filter(F.col("vec_id") % 100 == 0).withColumnRenamed("vec_id", "qid")
    near = quantised.search(*quantised.open_store(spark, path), asked, 5, dim, corpus_key="vec_id")
    return near.select("qid", "vec_id", F.round("score", 5).alias("score"), "rank")


@_query
def knn_texts(spark, sf):
    """Neighbours with their messages looked up."""
    near = _self_knn(spark, sf, 3)
    texts = logs(spark, sf).select(F.col("log_id").alias("vec_id"), "message")
    return knn.attach(near, texts, "vec_id").select("qid", "vec_id", "rank", "message")


def _asked_aside(given):
    """Queries that aren't rows of the corpus: every vector with a part of its neighbouring components mixed in."""
    n = F.size("embedding")
    mixed = F.transform("embedding", lambda x, i: x + 0.25 * F.element_at("embedding", F.pmod(i + 1, n) + 1))
    return given.select(F.col("vec_id").alias("qid"), mixed.alias("embedding"))


def _cells(spark, sf):
    given = table(spark, sf, "embeddings")
    dim = dimension(given)
    cells = ivf.fit_cells(given, dim, "vec_id")
    path = scratch_path(spark, "cells")
    ivf.with_cell(given, cells, dim, "vec_id").write.partitionBy("cell").parquet(path)
    return ivf.search_cells(spark.read.parquet(path), _asked_aside(given), cells, 5, dim, corpus_key="vec_id")


@_query
def knn_lsh(spark, sf):
    """Approximate neighbours from the cells closest to each query; see ``knn_lsh_recall``."""
    return _cells(spark, sf).select("qid", "vec_id", F.round("score", 5).alias("score"), "rank")


@_query
def knn_lsh_recall(spark, sf):
    """Whether nine tenths of the exact neighbours are found, and in how many answers."""
    given = table(spark, sf, "embeddings")
    exact = knn.knn(given, _asked_aside(given), 5, dimension(given), corpus_key="vec_id")
    recall = knn.recall_at_k(_cells(spark, sf), exact, "qid", "vec_id")
    return recall.select((F.col("recall") >= 0.9).alias("recall_reached"), F.lit(given.count()).cast("bigint").alias("queries"))


@_query
def pending_messages(spark, sf):
    done = table(spark, sf, "embeddings").select(F.col("vec_id").alias("log_id"))
    return embedding.pending(logs(spark, sf), done).select("log_id", "message", "timestamp", "host", "file")


# -- embedding --------------------------------------------------------------------------------

@_query
def document_embeddings(spark, sf):
    docs = embedding.spread(table(spark, sf, "documents").select("doc_id", "text"))
    encoder = embedding.lexical_encoder(embedding.fit_lexical(docs, "text"))
    done = embedding.embed(docs, encoder, "text")
    return done.select("doc_id", F.size("embedding").alias("dim"), F.round(vectors.norm("embedding"), 3).alias("norm"))


@_query
def embed_backfill(spark, sf):
    """New rows of the vector table for all messages that have no vector yet."""
    rows = as_logs(embedding.spread(table(spark, sf, "events")))
    done = table(spark, sf, "embeddings").select(F.col("vec_id").alias("log_id"))
    encoder = embedding.lexical_encoder(embedding.fit_lexical(rows))
    filled = embedding.backfill_rows(rows, done, encoder)
    return filled.select("log_id", "message", F.size("embedding").alias("dim"))


@_query
def backfill_copies(spark, sf):
    """The vector table after raw rows came with copies, in two runs: one row per key, with how many rows share it."""
    path = scratch_path(spark, "vectors")
    raw = logs(spark, sf).withColumn("timestamp", F.col("timestamp").cast("string")).drop("log_id")
    twice = raw.select("timestamp", "host", "file", F.lower("message").alias("message"))
    encoder = embedding.lexical_encoder(embedding.fit_lexical(twice))
    jobs.backfill(twice.unionByName(twice.filter("message like '%panic%'")), path, encoder)
    jobs.backfill(twice, path, encoder)
    stored = spark.read.parquet(path)
    moment = F.col("timestamp").cast("timestamp_ntz").alias("timestamp")
    return stored.select(moment, "host", "file", "message", "copies", F.size("embedding").alias("dim"))


@_query
def text_vector_rebuild(spark, sf):
    """The vector set rebuilt over all log texts, stored, and read back through its pointer."""
    rows = logs(spark, sf)
    metadata = readers.metadata_map()
    fitted = embedding.fit_lexical(rows.select(text.log_text(metadata=metadata).alias("text")), "text")
    path = scratch_path(spark, "vectors")
    writers.replace_vectors(embedding.text_vectors(rows, embedding.lexical_encoder(fitted), metadata), path)
    return writers.load_vectors(spark, path).select("text", F.size("embedding").alias("dim"))


# -- questions --------------------------------------------------------------------------------

@_query
def keyword_search(spark, sf):
    """The newest distinct hits of every search category."""
    hits = search.keyword_hits(logs(spark, sf))
    return hits.withColumn("score", F.lit(search.KEYWORD_SCORE).cast("double"))


def _questions(store: DataFrame) -> DataFrame:
    """Every stored message asked as a question, with its vector."""
    return store.select(F.col("log_id").alias("qid"), F.col("message").alias("query"), "embedding")


def _hybrid(spark, sf, threshold):
    # Joined once: the store is read for the questions, the vectors and the messages of the hits.
    path = scratch_path(spark, "store")
    log_embeddings(spark, sf).write.parquet(path)
    store = spark.read.parquet(path)
    found = search.hybrid_search(
        _questions(store), logs(spark, sf), store, 10, dimension(store), threshold
    )
    return found.withColumn("score", F.round("score", 5))


@_query
def hybrid_search(spark, sf):
    return _hybrid(spark, sf, search.SEMANTIC_THRESHOLD)


@_query
def hybrid_search_loose(spark, sf):
    """With a lower threshold, so that vector hits besides the question itself come through."""
    return _hybrid(spark, sf, 0.3)


@_query
def hybrid_search_shown(spark, sf):
    """What a result page shows of each answer, and how many hits it had."""
    found = _hybrid(spark, sf, 0.3)
    best = search.shown(found).withColumn("match_percent", text.percent("score"))
    return best.join(search.hit_counts(found), "qid").select("qid", "position", "match_percent", "count")


# -- classifier -------------------------------------------------------------------------------

@_query
def training_rows(spark, sf):
    store = log_embeddings(spark, sf)
    rows = classification.training_rows(store, dimension(store))
    return rows.select("log_id", "message", "timestamp", "label")


def _predicted(spark, sf):
    """A prediction that both engines can compute: right for even ids, the next class for odd."""
    given = table(spark, sf, "embeddings")
    return given.withColumn("prediction", ((F.col("label") + F.col("vec_id") % 2) % 10).cast("int"))


@_query
def confusion_matrix(spark, sf):
    return classification.confusion_matrix(_predicted(spark, sf))


@_query
def confusion_table(spark, sf):
    matrix = classification.confusion_matrix(_predicted(spark, sf))
    wide = classification.confusion_table(matrix, list(range(10)))
    return wide.select("label", *[F.col(str(i)).alias(f"p{i}") for i in range(10)])


@_query
def accuracy(spark, sf):
    return classification.accuracy(_predicted(spark, sf))


@_query
def classification_report(spark, sf):
    return classification.classification_report(classification.confusion_matrix(_predicted(spark, sf)))


@_query
def split_shares(spark, sf):
    """Rows of every label, and whether its train rows are four fifths of them to within one row
    (and the accuracy of the quantile, one row in 100,000)."""
    labelled = classification.with_label(logs(spark, sf))
    split = classification.stratified_split(labelled)
    counted = split.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_train").alias("t"))
    off = F.abs(F.col("t") - F.col("n") * 0.8)
    return counted.select("label", "n", (off <= 1 + F.col("n") / 100_000).alias("is_four_fifths"))


def _trained(spark, sf):
    given = table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("label"))
    split = classification.stratified_split(given, "vec_id")
    model = classification.train_classifier(split.filter("is_train"))
    return classification.predict(model, split)


@_query
def classifier_predictions(spark, sf):
    """Label and probabilities of every row; ``is_train`` tells which the classifier was made from."""
    return _trained(spark, sf).drop("embedding")


@_query
def classifier_checks(spark, sf):
    """By label: rows, those whose probabilities sum to 1, and those predicted to be of a class with the greatest one."""
    scored = _trained(spark, sf)
    shares = {c.removeprefix("proba_"): F.col(c) for c in scored.columns if c.startswith("proba_")}
    total = sum(shares.values(), F.lit(0.0))
    own = F.element_at(F.create_map(*[part for name, share in shares.items() for part in (F.lit(name), share)]), F.col("prediction"))
    return scored.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.abs(total - 1) < 1e-9).alias("n_sum_one"),
        F.count_if(own == F.array_max(F.array(*shares.values()))).alias("n_greatest"),
    )


@_query
def largest_entry(spark, sf):
    """The name of each vector's greatest entry, the first of equal ones."""
    given = table(spark, sf, "embeddings")
    names = [f"e{i}" for i in range(dimension(given))]
    return given.select("vec_id", vectors.argmax("embedding", names).alias("entry"))


@_query
def classifier_report(spark, sf):
    return classification.classification_report(classification.confusion_matrix(_trained(spark, sf).filter("not is_train")))


# -- tables on storage ------------------------------------------------------------------------

def _full_logs(spark, sf):
    """Log rows with typed time, as the writers take them."""
    return logs(spark, sf).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


@_query
def stored_table_scan(spark, sf):
    """All logs written in the table layout and a time range read back."""
    path = scratch_path(spark, "logs")
    writers.write_logs(_full_logs(spark, sf), path)
    rows = filters.within(spark.read.parquet(path), "2024-01-20 00:00:00", "2024-01-25 00:00:00")
    return rows.select("log_id", "timestamp", "source", "level", "ym")


@_query
def stored_flags_summary(spark, sf):
    """The summary over flags that ingest has stored: no message is read."""
    path = scratch_path(spark, "logs")
    writers.write_logs(_full_logs(spark, sf), path, enrich=True)
    return reports.insights_summary(spark.read.parquet(path))


@_query
def json_entries(spark, sf):
    """Entries appended as JSON lines and the last day read back."""
    path = scratch_path(spark, "entries")
    entries = _full_logs(spark, sf).select(
        "timestamp", "source", "level", "message", readers.metadata_map().alias("metadata")
    )
    writers.append_json(entries, path)
    back = readers.recent_entries(spark, path, 24 * 60, _as_of(spark, sf))
    return back.select("timestamp", "source", "level", "message", F.col("metadata")["k"].alias("k"))


@_query
def os_log_lines(spark, sf):
    """Events written as OS log records, one JSON text a line with a trailing comma, and read back."""
    path = scratch_path(spark, "oslog")
    record = F.to_json(
        F.struct(
            F.date_format(F.col("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
            F.when(F.col("log_id") % 3 != 0, F.col("source")).alias("source"),
            F.col("message").alias("eventMessage"),
            F.col("host").alias("process"),
            F.col("thread_id").alias("thread"),
        )
    )
    _full_logs(spark, sf).select(F.concat(record, F.lit(",")).alias("value")).write.text(path)
    back = readers.read_os_log_lines(spark, path, _as_of(spark, sf))
    return back.select(
        "timestamp", "source", "level", "message", text.fetch("metadata", "process", "").alias("process"),
        text.fetch("metadata", "subsystem", "?").alias("subsystem"), text.fetch("metadata", "absent", "-").alias("absent"),
    )


@_query
def raw_rows_normalised(spark, sf):
    """Raw rows with textual time brought to the log schema."""
    raw = logs(spark, sf).withColumn("timestamp", F.col("timestamp").cast("string"))
    rows = readers.normalise(raw, _as_of(spark, sf))
    return rows.select("timestamp", F.round("timestamp_unix", 3).alias("unix"), "source", "level", "message", "host", "pid")


@_query
def csv_roundtrip(spark, sf):
    """A report exported with a header and read back."""
    report = reports.top_sources(logs(spark, sf))
    path = writers.export_csv(report, scratch_path(spark, "csv"), "top_sources")
    return spark.read.option("header", True).schema(report.schema).csv(path)


@_query
def newest_stored_rows(spark, sf):
    """The newest rows of the stored table, found without reading all its months."""
    path = scratch_path(spark, "logs")
    writers.write_logs(_full_logs(spark, sf), path)
    return reports.newest_rows(spark.read.parquet(path), 100)


@_query
def stored_keyword_search(spark, sf):
    """Keyword hits from the flags that ingest has stored."""
    path = scratch_path(spark, "logs")
    writers.write_logs(_full_logs(spark, sf), path, enrich=True)
    return search.keyword_hits(spark.read.parquet(path)).withColumn("score", F.lit(0.85).cast("double"))


def _indexed(spark, sf):
    """The table in its layout with its file index; the newest files come after the index was made."""
    path = scratch_path(spark, "logs")
    rows = _full_logs(spark, sf)
    writers.write_logs(rows.filter("day(timestamp) < 28"), path)
    file_index.refresh(spark, path)
    writers.write_logs(rows.filter("day(timestamp) >= 28"), path)
    return path


@_query
def newest_indexed_rows(spark, sf):
    """The newest rows by the files' own times, with files that the index doesn't know yet."""
    return reports.newest_rows(file_index.newest(spark, _indexed(spark, sf), 100), 100)


@_query
def indexed_summary(spark, sf):
    """Summary and severity estimate as sums over files."""
    found = file_index.summary(spark, _indexed(spark, sf))
    names = {"is_error": "errors", "is_security": "security_issues", "is_hardware": "hardware_issues"}
    severity = [F.col(f"est_{name}").alias(f"severity_{name}") for name in taxonomy.SEVERITY_WORDS]
    return found.select(F.col("rows").alias("total_logs"), *[F.col(a).alias(b) for a, b in names.items()], *severity, "least", "greatest")


@_query
def word_rows(spark, sf):
    """Rows with one of a few words, from the files that may hold one."""
    found = file_index.matching(spark, _indexed(spark, sf), ("libxpc", "slow query", "délai"))
    return found.select("log_id", "timestamp", "message")


@_query
def indexed_keyword_search(spark, sf):
    """Keyword hits of every category, each from the newest files that may hold its words."""
    keep = lambda rows: rows.filter(text.longer_than("message") & text.without_any("message", text.NOISE_KEYWORD))
    path = _indexed(spark, sf)
    found = file_index.newest_hits(spark, path, taxonomy.SEARCH_WORDS, 10, ("timestamp", "message", "host"), keep)
    return found.withColumn("score", F.lit(0.85).cast("double"))


@_query
def line_ingest(spark, sf):
    """Log lines in files, followed as they come in two batches, in the log table with its flags."""
    path = scratch_path(spark, "lines")
    lines = logs(spark, sf).select(F.regexp_replace("message", "\\n", " ").alias("value"), (F.col("log_id") % 3 == 0).alias("late"))
    for late in (False, True):
        lines.filter(F.col("late") == late).select("value").write.mode("append").text(f"{path}/in")
        jobs.ingest_lines(spark, f"{path}/in", f"{path}/logs", f"{path}/checkpoint", pattern="part-*", once=True).awaitTermination()
    stored = spark.read.parquet(f"{path}/logs")
    return stored.groupBy("message", "level", "label", "is_error", "find_hardware").agg(F.count(F.lit(1)).alias("n"))


@_query
def retention_cleanup(spark, sf):
    """The table after a clean-up of rows older than ten days, and how many rows went."""
    path = scratch_path(spark, "logs")
    stored = writers.write_logs(_full_logs(spark, sf), path)
    removed = retention.cleanup(spark, path, _as_of(spark, sf), days=10)
    left = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("kept"), F.min("timestamp").alias("earliest"))
    return left.withColumns(
        {"removed": F.lit(removed).cast("bigint"), "stored": F.lit(stored).cast("bigint")}
    )


# -- streams ----------------------------------------------------------------------------------

def _stream(spark, sf):
    schema = table(spark, sf, "events").schema
    events = ingest.read_table_stream(spark, sf, schema, "events.parquet")
    return as_logs(events)


def _level_view(spark, sf, level):
    path = scratch_path(spark, "views")
    stream = _stream(spark, sf)
    view_schema = stream.select(*filters.VIEW_COLUMNS).schema
    ingest.maintain_views(stream, {level: f"{path}/{level}"}, f"{path}/checkpoint", once=True).awaitTermination()
    return ingest.read_view(spark, f"{path}/{level}", view_schema)


@_query
def error_view(spark, sf):
    return _level_view(spark, sf, "error")


@_query
def warning_view(spark, sf):
    return _level_view(spark, sf, "warning")


@_query
def hourly_stream(spark, sf):
    path = scratch_path(spark, "hourly")
    counts = trends.hourly(trends.event_time(_stream(spark, sf)))
    trends.keep_current(counts, f"{path}/out", f"{path}/checkpoint", once=True).awaitTermination()
    return trends.read_current(spark, f"{path}/out", "hour")


@_query
def daily_from_hours(spark, sf):
    """Days from the hours that a stream keeps, with distinct sources from merged sketches."""
    path = scratch_path(spark, "hours")
    counts = trends.hourly(trends.event_time(_stream(spark, sf)), sketch=True)
    trends.keep_current(counts, f"{path}/out", f"{path}/checkpoint", once=True).awaitTermination()
    return trends.rolled_up(trends.read_current(spark, f"{path}/out", "hour"))


@_query
def error_minutes_stream(spark, sf):
    """Errors per minute as a stream; its distinct sources are a sketch, so only the errors show."""
    path = scratch_path(spark, "minutes")
    counts = trends.error_minutes(trends.event_time(_stream(spark, sf)))
    trends.keep_current(counts, f"{path}/out", f"{path}/checkpoint", once=True).awaitTermination()
    return trends.read_current(spark, f"{path}/out", "minute").select("minute", "error_count")


@_query
def stream_ingest(spark, sf):
    """The stream without replays in a month-partitioned table."""
    path = scratch_path(spark, "ingest")
    rows = trends.without_replays(trends.event_time(_stream(spark, sf)))
    ingest.to_table(rows, f"{path}/logs", f"{path}/checkpoint", once=True, by_month=True).awaitTermination()
    return spark.read.parquet(f"{path}/logs").select("log_id", "timestamp", "level", "ym")


@_query
def stream_retention(spark, sf):
    """A stream's table after rows older than ten days went and small files were merged, and the next batch."""
    path = scratch_path(spark, "landed")
    stream = _stream(spark, sf).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    landing.land_stream(stream, f"{path}/logs", f"{path}/checkpoint", once=True).awaitTermination()
    removed = landing.expire(spark, f"{path}/logs", _as_of(spark, sf), days=10)
    landing.land(_full_logs(spark, sf).filter(filters.has_level("error")).withColumn("log_id", -F.col("log_id") - 1), f"{path}/logs", 1)
    landing.compact(spark, f"{path}/logs")
    rows = landing.read_landed(spark, f"{path}/logs")
    kept = rows.select("log_id", "timestamp", "source", "level", "message")
    return kept.withColumn("removed", F.lit(removed).cast("bigint"))


@_query
def view_retention(spark, sf):
    """A maintained view of errors in the same layout, expired."""
    path = scratch_path(spark, "landed")
    stream = _stream(spark, sf).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    errors = stream.filter(filters.has_level("error")).select(*filters.VIEW_COLUMNS)
    landing.land_stream(errors, f"{path}/errors", f"{path}/checkpoint", once=True).awaitTermination()
    landing.expire(spark, f"{path}/errors", _as_of(spark, sf), days=5)
    return landing.read_landed(spark, f"{path}/errors").drop("ym")


@_query
def os_log_arrays(spark, sf):
    """Events written as large JSON arrays and read back in small byte ranges."""
    path = scratch_path(spark, "arrays")
    record = F.struct(
        F.date_format(F.col("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.when(F.col("log_id") % 3 != 0, F.col("source")).alias("source"),
        F.concat(F.lit('say "'), F.col("message"), F.lit('" \\ ]}[{')).alias("eventMessage"),
        F.col("host").alias("process"),
    )
    # One array per hour, each a line of a text file; objects of all lines of a file are records.
    hours = F.date_trunc("hour", F.col("timestamp"))
    arrays = _full_logs(spark, sf).groupBy(hours.alias("h")).agg(F.to_json(F.collect_list(record)).alias("value"))
    arrays.select("value").write.text(path)
    found = readers.read_os_log_arrays(spark, path, _as_of(spark, sf), range_bytes=1 << 18)
    return found.select("timestamp", "source", "message", text.fetch("metadata", "process", "").alias("process"))


@_query
def stream_enrich(spark, sf):
    """Vectors added to the stream by weights learnt beforehand."""
    path = scratch_path(spark, "enrich")
    encoder = embedding.lexical_encoder(embedding.fit_lexical(logs(spark, sf)))
    stream = _stream(spark, sf).filter(text.not_empty("message")).select("log_id", "message")
    encode = lambda rows: embedding.embed(rows, encoder)
    ingest.enrich(stream, encode, f"{path}/vectors", f"{path}/checkpoint", once=True).awaitTermination()
    stored = spark.read.parquet(f"{path}/vectors")
    return stored.select("log_id", "message", F.size("embedding").alias("dim"))
