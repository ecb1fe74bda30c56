import pytest
from pyspark.sql import functions as F

from loglantern.functions import taxonomy, text, times, vectors
from loglantern.schemas import is_known_level, level_rank, log_id


def _one(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expression.alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "message, label",
    [
        ("permission denied", "error"),
        ("access blocked", "security"),
        ("disk slow", "hardware"),
        ("retry", "warning"),
        ("hello", "info"),
        ("", "info"),
    ],
)
def test_label_priority(spark, message, label):
    assert _one(spark, [message], taxonomy.label_of("x")) == [label]


def test_level_priority(spark):
    messages = ["warning: failed", "debug warn", "critical", "Debug", "hello"]
    assert _one(spark, messages, taxonomy.level_of("x")) == ["error", "warning", "error", "debug", "info"]


def test_routes(spark):
    questions = [
        "What errors occurred on my laptop?",
        "What security violations happened?",
        "What hardware problems occurred?",
        "Show performance problems",
        "Show me recent system crashes",
        "security error",
        "flag day",
        "hello",
    ]
    routes = ["error", "security", "hardware", "performance", "error", "security", "performance", None]
    assert _one(spark, questions, taxonomy.route_of("x")) == routes
    words = _one(spark, ["security", None], taxonomy.search_words_of("x"))
    assert words == [["violation", "sandbox", "deny", "unauthorized", "blocked", "security"], None]


def test_lists_can_be_replaced(spark):
    lists = {"net": ("Socket",), "other": ("x",)}
    assert _one(spark, ["SOCKET x", "x", "y"], taxonomy.first_match("x", lists, "none")) == ["net", "other", "none"]


def test_a_row_may_be_in_several_lists(spark):
    df = spark.createDataFrame([(1, "usb failed"), (2, "fine"), (3, "DENY disk")], "i int, message string")
    rows = taxonomy.explode_matches(df, taxonomy.CATEGORY_WORDS, "c").select("i", "c").collect()
    assert sorted(map(tuple, rows)) == [(1, "error"), (1, "hardware"), (3, "hardware"), (3, "security")]


def test_stored_flags_are_used(spark):
    df = spark.createDataFrame([("nothing", True, False, False)], "message string, is_error boolean, is_security boolean, is_hardware boolean")
    assert [r.c for r in taxonomy.explode_matches(df, taxonomy.CATEGORY_WORDS, "c").collect()] == ["error"]


def test_noise_respects_case(spark):
    messages = ["Assertion failed", "assertion failed", "statistics: 1", "Statistics: 1", "a --enable-b"]
    assert _one(spark, messages, text.without_any("x", text.NOISE_KEYWORD)) == [True, False, True, False, False]
    assert _one(spark, messages, text.without_any("x", text.NOISE_SEMANTIC)) == [True, False, True, False, True]


def test_length_is_in_bytes(spark):
    values = ["é" * 41, "e" * 80, "e" * 81, "é" * 50, ""]
    assert _one(spark, values, text.longer_than("x")) == [True, False, True, True, False]
    assert _one(spark, values, text.length_bucket("x")) == [0, 0, 0, 100, 0]


def test_cuts_are_in_characters(spark):
    values = ["é" * 81, "ab"]
    assert _one(spark, values, text.prefix("x", 80)) == ["é" * 80, "ab"]
    assert _one(spark, values, text.prefix("x", 80, ellipsis=True)) == ["é" * 80 + "...", "ab..."]
    assert _one(spark, values, text.prefix("x", 80, ellipsis=False)) == ["é" * 80 + "...", "ab"]
    assert _one(spark, ["a\nb" + "c" * 200], text.one_line("x")) == ["a b" + "c" * 157]


def test_strip_and_blank(spark):
    values = [" a b \n", "\t\n ", "", "\ta"]
    assert _one(spark, values, text.strip("x")) == ["a b", "", "", "a"]
    assert _one(spark, values, text.not_blank("x")) == [True, False, False, True]


def test_log_text_and_back(spark):
    df = spark.createDataFrame(
        [("s", "info", "m", {"b": "2", "a": "1"}), ("s | t", "x", "Source: no", {}), ("s", "l", "m", None)],
        "source string, level string, message string, metadata map<string,string>",
    ).withColumn("t", text.log_text())
    rows = df.select("t", text.parse_source("t").alias("s"), text.parse_level("t").alias("l")).collect()
    assert rows[0].t == "Source: s | Level: info | Message: m | a: 1 | b: 2"
    assert (rows[0].s, rows[0].l) == ("s", "info")
    assert rows[1].s == "s"
    assert rows[2].t == "Source: s | Level: l | Message: m"
    assert _one(spark, ["no markers"], text.parse_source("x")) == [None]


def test_timestamps(spark):
    values = ["2024-01-01T00:00:00Z", "2024-01-01T02:00:00+02:00", "nonsense"]
    got = _one(spark, values, text.to_timestamp_utc("x").cast("string"))
    assert got == ["2024-01-01 00:00:00", "2024-01-01 00:00:00", None]
    assert _one(spark, ["2024-03-05 06:07:08.9"], text.minute_key("x")) == ["2024-03-05 06:07"]
    assert _one(spark, ["2024-03-05 06:07:08"], text.year_month(F.col("x").cast("timestamp"))) == [202403]


def test_buckets_floor_before_1970(spark):
    values = ["1969-12-31 23:59:59.5", "1970-01-01 00:00:00", "2024-01-01 10:59:59.999"]
    kind = spark.createDataFrame([], "t timestamp").schema["t"].dataType
    start = times.bucket_start(times.bucket(F.col("x").cast("timestamp"), 3600), 3600, kind).cast("string")
    assert _one(spark, values, start) == ["1969-12-31 23:00:00", "1970-01-01 00:00:00", "2024-01-01 10:00:00"]


def test_fetch_default(spark):
    assert _one(spark, [{"a": "1"}, {}], text.fetch("x", "a", "?"), "map<string,string>") == ["1", "?"]


def test_vectors(spark):
    zero, three = [0.0, 0.0], [3.0, 4.0]
    got = _one(spark, [zero, three], vectors.normalize("x"), "array<float>")
    assert got[0] == [0.0, 0.0] and got[1] == pytest.approx([0.6, 0.8])
    assert _one(spark, [three], vectors.dot("x", vectors.literal([1, 2])), "array<float>") == [11.0]
    bad = [None, [1.0], [1.0, 2.0, 3.0], three, [None, 1.0]]
    assert _one(spark, bad, vectors.is_valid("x", 2), "array<float>") == [False, False, False, True, False]
    assert _one(spark, [[0.2, 0.5, 0.5]], vectors.argmax("x", ["a", "b", "c"]), "array<double>") == ["b"]


def test_levels(spark):
    values = ["info", "warning", "error", "debug", "critical", None]
    assert _one(spark, values, level_rank("x")) == [1, 2, 3, 4, None, None]
    assert _one(spark, values, is_known_level("x")) == [True] * 4 + [False] * 2


def test_log_id_is_content(spark):
    rows = [("t", "h", "f", "m"), ("t", "h", "f", "m"), ("t", "h", "fm", "")]
    df = spark.createDataFrame(rows, "timestamp string, host string, file string, message string")
    ids = [r.i for r in df.select(log_id().alias("i")).collect()]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 64


def test_percent_rounds_the_product(spark):
    # Products of doubles such as 54.949999999999996; ``round(x * 100, 1)`` in SQL gives the same.
    shares = [0.5495, 0.5445, 0.6385, -0.6395, 0.85, 1.0, 0.0, None]
    assert _one(spark, shares, text.percent("x"), "double") == [55.0, 54.5, 63.9, -64.0, 85.0, 100.0, 0.0, None]
