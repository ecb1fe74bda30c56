import numpy as np
import pytest
from pyspark.sql import functions as F

from loglantern.operators import classification, embedding
from loglantern.plans import jobs
from loglantern.sources import readers

DIM = 6


@pytest.fixture(scope="module")
def rows(spark):
    """Messages of three labels with vectors that tell them apart; a third is one message."""
    rng = np.random.default_rng(11)
    kinds = [("request failed", 0), ("sandbox hit", 1), ("all quiet", 2)]
    out = []
    for i in range(600):
        message, axis = kinds[i % 3] if i % 2 else kinds[2]
        v = rng.normal(scale=0.1, size=DIM)
        v[axis] += 1
        out.append((f"id{i:04d}", f"{message} {i}" if i % 3 else message, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", v.tolist()))
    out += [("bad1", "x", "2024-01-02 00:00:00", [1.0]), ("bad2", "", "2024-01-02 00:00:00", [0.0] * DIM), ("bad3", "x", "2024-01-02", None)]
    return spark.createDataFrame(out, "log_id string, message string, timestamp string, embedding array<float>")


def test_limit_comes_before_validity(rows):
    assert classification.training_rows(rows, DIM, 3).count() == 0
    assert classification.training_rows(rows, DIM, 4).count() == 1
    assert classification.training_rows(rows, DIM, None).count() == 600


def test_split_is_stratified_and_stable(rows):
    labelled = classification.training_rows(rows, DIM)
    split = classification.stratified_split(labelled)
    shares = split.groupBy("label").agg(F.avg(F.col("is_train").cast("double")).alias("s")).collect()
    assert len(shares) == 3 and all(abs(r.s - 0.8) < 0.02 for r in shares)
    again = classification.stratified_split(labelled.repartition(7))
    pick = lambda d: {r.log_id for r in d.filter("is_train").collect()}
    assert pick(split) == pick(again)
    assert pick(split) != pick(classification.stratified_split(labelled, seed=7))


def test_train_store_load_predict(spark, rows, tmp_path):
    path = str(tmp_path / "models")
    assert readers.load_newest_model(spark, path) is None
    metadata = jobs.train(rows, path, DIM, max_iterations=50)
    assert metadata["samples_trained"] + metadata["samples_validated"] == 600 == metadata["embeddings_count"]
    assert metadata["accuracy"] > 0.97
    stored = readers.model_runs(spark, path).first()
    assert stored.label_distribution == metadata["label_distribution"] and stored.model_path == metadata["model_path"]
    # The report and the confusion counts are stored with the run and agree with its accuracy.
    counts = {(r.label, r.prediction): r["count"] for r in stored.confusion_matrix}
    assert sum(counts.values()) == metadata["samples_validated"]
    right = sum(n for (label, found), n in counts.items() if label == found)
    assert metadata["accuracy"] == pytest.approx(right / metadata["samples_validated"])
    by_name = {r.name: r for r in stored.report}
    assert set(by_name) == {"error", "info", "security", "accuracy", "macro avg", "weighted avg"}
    assert by_name["accuracy"].f1 == pytest.approx(metadata["accuracy"], abs=1e-4)
    assert by_name["error"].support == sum(n for (label, _), n in counts.items() if label == "error")
    assert metadata["report"] == [r.asDict() for r in stored.report]
    model = readers.load_newest_model(spark, path)
    assert classification.classes_of(model) == ["error", "info", "security"]
    probe = spark.createDataFrame([([5.0] + [0.0] * 5,), ([0.0, 2.0] + [0.0] * 4,)], "embedding array<float>")
    got = classification.predict(model, probe).collect()
    assert [r.prediction for r in got] == ["error", "security"]
    for r in got:
        shares = [r.proba_error, r.proba_info, r.proba_security]
        assert sum(shares) == pytest.approx(1) and max(shares) == r[f"proba_{r.prediction}"]


def test_classify_texts(spark, rows, tmp_path):
    encoder = embedding.lexical_encoder(embedding.fit_lexical(rows, dim=32))
    store = embedding.embed(rows.drop("embedding").filter("message != ''"), encoder)
    path = str(tmp_path / "models")
    jobs.train(store, path, 32, max_iterations=30)
    model = readers.load_newest_model(spark, path)
    texts = spark.createDataFrame([("request failed",), ("sandbox hit",), ("all quiet",)], "message string")
    got = {r.message: r.prediction for r in jobs.classify(texts, encoder, model).collect()}
    assert got == {"request failed": "error", "sandbox hit": "security", "all quiet": "info"}


def test_report_with_zero_divisors(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] + [("b", "a")] * 2 + [("c", "a"), ("b", "d")]
    df = spark.createDataFrame(pairs, "label string, prediction string")
    matrix = classification.confusion_matrix(df)
    got = {r.name: r for r in classification.classification_report(matrix).collect()}
    assert (got["a"].precision, got["a"].recall, got["a"].support) == (0.5, 0.75, 4)
    assert (got["b"].precision, got["b"].recall, got["b"].f1) == (0.0, 0.0, 0.0)
    assert (got["c"].precision, got["c"].recall, got["c"].support) == (0.0, 0.0, 1)
    assert (got["d"].recall, got["d"].support) == (0.0, 0)
    assert got["accuracy"].f1 == 0.375 and got["accuracy"].precision is None
    assert got["macro avg"].f1 == 0.15 and got["weighted avg"].recall == 0.375
    assert classification.accuracy(df).first().accuracy == 0.375
    table = {r.label: r for r in classification.confusion_table(matrix, ["a", "b", "c", "d"]).collect()}
    assert (table["a"].a, table["a"].b, table["a"].c) == (3, 1, 0)


def test_report_of_nothing(spark):
    empty = spark.createDataFrame([], "label string, prediction string")
    assert classification.classification_report(classification.confusion_matrix(empty)).count() == 0


def test_split_is_exact_at_size(spark):
    rows = spark.range(750_000).withColumn("label", F.when(F.col("id") % 2 == 0, "info").otherwise("error"))
    split = classification.stratified_split(rows, "id")
    assert {r.label: r.t for r in split.groupBy("label").agg(F.count_if("is_train").alias("t")).collect()} == {"info": 300_000, "error": 300_000}


def test_split_of_repeated_keys(spark):
    for n, copies in ((7, 1), (7, 2), (40, 2), (1, 9)):
        rows = spark.range(n).select("id", F.lit("info").alias("label"), F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
        sides = classification.stratified_split(rows, "id").groupBy("id").agg(F.count_if("is_train").alias("t")).collect()
        assert {r.t for r in sides} <= {0, copies}  # copies stay together
        assert n == 1 or abs(sum(r.t for r in sides) - 0.8 * n * copies) <= 1
