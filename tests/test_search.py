import datetime as dt

import pytest
from pyspark.sql import functions as F

from loglantern.functions import taxonomy
from loglantern.operators import embedding, reports, search
from loglantern.plans import jobs, tables
from loglantern.sources import writers

START = dt.datetime(2024, 1, 1)
PAD = " and a long enough tail so that the row passes the eighty byte limit of the search"


@pytest.fixture(scope="module")
def logs(spark):
    """Security rows, of which one exact copy group is a third of the table; few hardware rows."""
    rows = []
    for i in range(400):
        rows.append((START + dt.timedelta(minutes=i), f"sandbox violation {i % 90:03d}" + PAD, f"h{i % 3}"))
    newest = START + dt.timedelta(days=3)
    rows += [(newest, "security notice repeated" + PAD, "h0")] * 300
    rows += [(START, f"thermal event {i}" + PAD, "h1") for i in range(2)]
    rows += [(START, "usb assertion failed" + PAD, "h1"), (START, "disk --enable-x" + PAD, "h1"), (START, "usb short", "h1")]
    rows += [(START, "Statistics: battery" + PAD, "h1")]
    return spark.createDataFrame(rows, "timestamp timestamp, message string, host string").repartition(5)


@pytest.fixture(scope="module")
def store(spark):
    vectors = {
        "alpha one" + PAD: [1.0, 0.0, 0.0],
        "alpha two" + PAD: [0.9, 0.1, 0.0],
        "x" * 150 + " first": [0.0, 1.0, 0.0],
        "x" * 150 + " second": [0.0, 0.99, 0.05],
        "Statistics: alpha" + PAD: [1.0, 0.0, 0.01],
        "alpha --enable-y" + PAD: [0.8, 0.2, 0.0],
        "short": [1.0, 0.0, 0.0],
    }
    rows = [(f"v{i}", m, START, "h9", v) for i, (m, v) in enumerate(vectors.items())]
    return spark.createDataFrame(rows, "log_id string, message string, timestamp timestamp, host string, embedding array<float>")


def _brute_hits(logs, words, top):
    keep = set()
    for r in logs.collect():
        low = r.message.lower()
        noisy = any(x in r.message for x in ("assertion failed", "Statistics:", "--enable-"))
        if any(w in low for w in words) and len(r.message.encode()) > 80 and not noisy:
            keep.add((r.timestamp, r.message, r.host))
    return sorted(keep, key=lambda t: (-t[0].timestamp(), t[1], t[2]))[:top]


@pytest.mark.parametrize("top", [1, 10, 1000])
def test_hits_match_brute_force(logs, top):
    found = search.keyword_hits(logs, top).collect()
    for category, words in taxonomy.SEARCH_WORDS.items():
        mine = [(r.timestamp, r.message, r.host) for r in sorted(found, key=lambda r: r.rank) if r.category == category]
        assert mine == _brute_hits(logs, words, top), category


def test_keyword_search_scores(logs):
    rows = search.keyword_search(logs, ["Thermal"], "heat", 10).collect()
    assert len(rows) == 2 and {(r.score, r.category) for r in rows} == {(0.85, "heat")}


def _ask(spark, logs, store, rows, **options):
    asked = spark.createDataFrame(rows, "qid bigint, query string, embedding array<float>")
    found = search.hybrid_search(asked, logs, store, dim=3, **options).orderBy("qid", "position").collect()
    answers = {}
    for r in found:
        answers.setdefault(r.qid, []).append(r)
    return answers


def test_hybrid(spark, logs, store):
    answers = _ask(
        spark,
        logs,
        store,
        [
            (1, "security please", [1.0, 0.0, 0.0]),  # enough keyword hits: no vectors
            (2, "thermal", [1.0, 0.0, 0.0]),  # two hits: vectors are added after them
            (3, "what about alpha", [2.0, 0.0, 0.0]),  # no route: vectors only
            (4, "ex", [0.0, 5.0, 0.0]),  # equal first 150 characters count once
            (5, "nothing near", [0.0, 0.0, 1.0]),  # all below the threshold
            (6, "", [1.0, 0.0, 0.0]),  # refused
        ],
    )
    assert {r.category for r in answers[1]} == {"security"} and len(answers[1]) == 10
    assert answers[1][0].message.startswith("security notice")
    assert [r.category for r in answers[2]] == ["hardware"] * 2 + ["semantic"] * 3
    assert [r.message.split(" and a")[0] for r in answers[3]] == ["alpha one", "alpha two", "alpha --enable-y"]
    assert answers[3][0].score == pytest.approx(1)
    assert [r.message[-6:] for r in answers[4]] == [" first"]
    assert 5 not in answers and 6 not in answers
    counts = search.hit_counts(spark.createDataFrame(answers[2])).first()
    assert counts["count"] == 5


def test_top_and_threshold(spark, logs, store):
    rows = [(3, "what about alpha", [1.0, 0.0, 0.0])]
    assert len(_ask(spark, logs, store, rows, top=2)[3]) == 2
    assert len(_ask(spark, logs, store, rows, threshold=0.995)[3]) == 1


def test_duplicate_keyword_hits_do_not_ask_vectors(spark, store):
    """The rule counts hits before equal prefixes are merged."""
    rows = [(START + dt.timedelta(seconds=i), "slow query" + PAD, "h") for i in range(5)]
    logs = spark.createDataFrame(rows, "timestamp timestamp, message string, host string")
    answers = _ask(spark, logs, store, [(1, "why slow", [1.0, 0.0, 0.0])])
    assert [r.category for r in answers[1]] == ["performance"]


def test_ask(logs, store):
    rows = search.ask("alpha?", [1.0, 0.0, 0.0], logs, store).collect()
    assert [r.position for r in rows] == [1, 2, 3]
    assert len(search.shown(search.ask("security", [1.0, 0, 0], logs, store)).collect()) == 8
    for bad in ("", None):
        with pytest.raises(ValueError):
            search.ask(bad, [1.0, 0.0, 0.0], logs, store)


def test_similar_logs(store):
    found = search.similar_logs(store, [0.0, 7.0, 0.0], 2).collect()
    assert [r.log_id for r in found] == ["v2", "v3"] and "embedding" not in found[0]


def test_questions_are_encoded_like_the_logs(spark):
    """From plain questions to answers, by way of the lexical encoder."""
    rows = [(f"v{i}", START + dt.timedelta(minutes=i), f"h{i}", m + PAD) for i, m in enumerate(["printer jam", "login by root", "queue drained"])]
    logs = spark.createDataFrame(rows, "log_id string, timestamp timestamp, host string, message string")
    encoder = embedding.lexical_encoder(embedding.fit_lexical(logs, dim=256))
    store = embedding.embed(logs, encoder)
    asked = spark.createDataFrame([(1, "who saw a printer jam?"), (2, "root login")], "qid bigint, query string")
    found = jobs.answer(asked, logs, store, encoder, dim=256, threshold=0.1).orderBy("qid", "position").collect()
    best = {r.qid: r.message for r in reversed(found)}
    assert best[1].startswith("printer jam") and best[2].startswith("login by root")


def test_stored_flags_serve_only_their_own_words(spark, sf_dir):
    plain = tables.logs(spark, sf_dir)
    stored = writers.with_ingest_columns(plain)
    words = {"security": ("thermal sensor",)}
    for table in (plain, stored):
        assert reports.insights_summary(table, lists={"error": ("no such word",)}).first().errors == 0
    found = [search.keyword_candidates(table, words).count() for table in (plain, stored)]
    assert found[0] == found[1]
