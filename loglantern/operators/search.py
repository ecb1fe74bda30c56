"""Questions: routing, keyword hits, and the keyword-then-vector search."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import taxonomy, text
from ..session import shared_dir
from .knn import attach, knn, semantic_search
from .ranking import from_newest, keep_first, newest_distinct, top_per_group

# Score shown for a keyword hit, least score of a vector hit, and the number of keyword hits below
# which vectors are asked too. Fixed values.
KEYWORD_SCORE = 0.85
SEMANTIC_THRESHOLD = 0.4
ENOUGH_HITS = 3
SEMANTIC_CATEGORY = "semantic"
PREFIX = 150

HIT_COLUMNS = ("message", "timestamp", "host")


def check_question(question: str) -> str:
    if not isinstance(question, str) or not question:
        raise ValueError("a question must be a non-empty text")
    return question


def route_questions(questions: DataFrame, query: str = "query") -> DataFrame:
    """Adds the category of each question and the words to look up; both null without a route."""
    routed = questions.withColumn("category", taxonomy.route_of(query))
    return routed.withColumn("keywords", taxonomy.search_words_of("category"))


def keyword_candidates(logs: DataFrame, lists: taxonomy.WordLists = taxonomy.SEARCH_WORDS) -> DataFrame:
    """Long, noise-free rows with the search categories whose words they hold. Where ingest has
    stored ``find_<category>`` flags of the same words, they reach the scan in place of the text tests."""
    stored = [f"find_{name}" for name, words in lists.items() if taxonomy.stored_flag(logs, name, words, "find_")]
    if len(stored) == len(lists):
        logs = logs.filter(reduce(or_, (F.col(flag) for flag in stored)))
    useful = logs.filter(text.longer_than("message") & text.without_any("message", text.NOISE_KEYWORD))
    return taxonomy.explode_matches(useful.select(*HIT_COLUMNS, *stored), lists, "category", prefix="find_")


def keyword_hits(
    logs: DataFrame, top: int = 10, lists: taxonomy.WordLists = taxonomy.SEARCH_WORDS, salts: int = 64
) -> DataFrame:
    """The newest ``top`` distinct (message, timestamp, host) rows of every search category.

    The hits depend on the category only, so any number of questions shares this one pass. Each scan task keeps its newest
    ``top`` distinct rows of a category and no copies, so the first shuffle carries at most tasks * ``top`` rows a
    category; of those, ``salts`` part groups leave the rows that are put in order.
    """
    order = [F.col("timestamp").desc(), F.col("message").asc(), F.col("host").asc()]
    part = Window.partitionBy("category", "__part").orderBy(*order)

    def run(rows: DataFrame) -> DataFrame:
        newest = newest_distinct(keyword_candidates(rows, lists), "category", ("timestamp", "message", "host"), top)
        newest = newest.withColumn("__part", F.pmod(F.xxhash64(*HIT_COLUMNS), F.lit(salts))).distinct()
        newest = newest.withColumn("__place", F.row_number().over(part)).filter(F.col("__place") <= top)
        return top_per_group(newest.select("category", *HIT_COLUMNS), ["category"], order, top, rank="rank", salts=1)

    return from_newest(logs, run, lambda found: found.count() >= top * len(lists))


def keyword_search(
    logs: DataFrame, keywords: list[str], category: str, top: int = 10, score: float = KEYWORD_SCORE
) -> DataFrame:
    """One category's keyword hits, newest first."""
    hits = keyword_hits(logs, top, {category: tuple(keywords)})
    return hits.withColumn("score", F.lit(score).cast("double")).orderBy("rank")


def semantic_corpus(embeddings: DataFrame) -> DataFrame:
    """Vector rows that may answer a question: long messages without the known noise."""
    return embeddings.filter(text.longer_than("message") & text.without_any("message", text.NOISE_SEMANTIC))


def above(scored: DataFrame, threshold: float = SEMANTIC_THRESHOLD) -> DataFrame:
    """Drops weak hits. Applied to the limited hits, never before the limit."""
    return scored.filter(F.col("score") > F.lit(threshold).cast("double"))


def hybrid_search(
    questions: DataFrame,
    logs: DataFrame,
    embeddings: DataFrame,
    top: int = 10,
    dim: int = 384,
    threshold: float = SEMANTIC_THRESHOLD,
    key: str = "log_id",
) -> DataFrame:
    """Answers every question (qid, query, embedding) at once.

    A routed question takes its category's keyword hits. A question with fewer than three of them
    also takes its nearest vectors above the threshold. Hits that agree in the first 150
    characters count once, keyword hits first, and ``top`` rows per question remain. Questions
    without text are refused and get no rows.
    """
    spark = questions.sparkSession
    # Routed once and kept: the questions are read again for each stage, and their vectors may have
    # taken an encoder to get.
    shared_dir(spark)
    asked = (
        questions.filter(text.not_empty("query"))
        .select("qid", taxonomy.route_of("query").alias("category"), "embedding")
        .checkpoint()
    )
    # At most four categories times ``top`` rows, whatever the size of the logs: held once, so that
    # the logs are scanned once for the hits and for the number of hits. Categories that no question
    # goes to aren't looked for.
    routed = {row["category"] for row in asked.select("category").distinct().collect()}
    lists = {name: words for name, words in taxonomy.SEARCH_WORDS.items() if name in routed}
    found = keyword_hits(logs, top, lists) if lists else None
    empty = spark.createDataFrame([], keyword_hits(logs, top, {"none": ("none",)}).schema) if found is None else None
    hits = spark.createDataFrame(found.collect(), found.schema) if found is not None else empty
    sizes = hits.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    by_words = asked.select("qid", "category").join(F.broadcast(hits), "category").select(
        "qid",
        F.lit(0).alias("stage"),
        "rank",
        *HIT_COLUMNS,
        F.lit(KEYWORD_SCORE).cast("double").alias("score"),
        "category",
    )
    unsure = (
        asked.join(F.broadcast(sizes), "category", "left")
        .filter(F.coalesce("n", F.lit(0)) < ENOUGH_HITS)
        .select("qid", "embedding")
    )
    corpus = semantic_corpus(embeddings)
    near = above(knn(corpus, unsure, top, dim, corpus_key=key), threshold)
    by_vectors = attach(near, embeddings.select(key, *HIT_COLUMNS), key).select(
        "qid",
        F.lit(1).alias("stage"),
        "rank",
        *HIT_COLUMNS,
        "score",
        F.lit(SEMANTIC_CATEGORY).alias("category"),
    )
    order = [F.col("stage").asc(), F.col("rank").asc()]
    merged = by_words.unionByName(by_vectors).withColumn("__prefix", text.prefix("message", PREFIX))
    unique = keep_first(merged, ["qid", "__prefix"], order).drop("__prefix")
    best = top_per_group(unique, ["qid"], order, top, rank="position", salts=1)
    return best.select("qid", "position", *HIT_COLUMNS, "score", "category")


def hit_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("qid").agg(F.count(F.lit(1)).alias("count"))


def shown(results: DataFrame, n: int = 8) -> DataFrame:
    """The rows a result page shows of each answer."""
    return results.filter(F.col("position") <= n)


def ask(
    question: str,
    vector: list[float],
    logs: DataFrame,
    embeddings: DataFrame,
    top: int = 10,
    threshold: float = SEMANTIC_THRESHOLD,
    key: str = "log_id",
) -> DataFrame:
    """``hybrid_search`` for one question; refuses an empty one."""
    row = [(0, check_question(question), [float(x) for x in vector])]
    asked = logs.sparkSession.createDataFrame(row, "qid bigint, query string, embedding array<double>")
    return hybrid_search(asked, logs, embeddings, top, len(vector), threshold, key).orderBy("position")


def similar_logs(store: DataFrame, vector: list[float], k: int = 10, key: str = "log_id") -> DataFrame:
    """The k stored messages closest to a question vector."""
    return semantic_search(store, vector, k, tie=(key,), stored_unit=True).drop("embedding")
