"""The file index against plain reads of the whole table."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from loglantern.functions import taxonomy
from loglantern.operators import ranking, reports
from loglantern.sources import file_index, writers

SCHEMA = "log_id long, timestamp timestamp, source string, level string, message string, host string, pid long"
START = dt.datetime(2024, 1, 1)
LISTS = {"rare": ("zebra",), "common": ("panic", "usb"), "two": ("connection refused",), "none": ("unheard-of",)}


def _rows(first, count, seed, start=START):
    rng = random.Random(seed)
    out = []
    for i in range(first, first + count):
        text = rng.choice(["kernel Panic at 5", "USB disk", "idle", "", "Connection refused by peer", "connection was refused"])
        if i % 4999 == 0:
            text = "a ZEBRA² crossed"
        out.append((i, start + dt.timedelta(seconds=i // 3), f"s{i % 4}", "info", text, f"h{i % 2}", i % 5))
    return out


@pytest.fixture
def path(spark, tmp_path):
    path = str(tmp_path / "logs")
    for k in range(6):
        writers.write_logs(spark.createDataFrame(_rows(2000 * k, 2000, k), SCHEMA), path, files=2)
    assert file_index.refresh(spark, path) == len(file_index._listed(spark, path))
    assert file_index.refresh(spark, path) == 0
    return path


def _late(spark, path):
    """Rows that the index doesn't know, one of them far ahead of its time."""
    rows = _rows(12_000, 50, 9) + [(99_999, START + dt.timedelta(days=4000), "s", "info", "zebra panic", "h", 1)]
    writers.write_logs(spark.createDataFrame(rows, SCHEMA), path, files=1)


def _opened(monkeypatch):
    names = []
    real = file_index._open
    monkeypatch.setattr(file_index, "_open", lambda spark, path, some: names.extend(some) or real(spark, path, some))
    return names


def _ids(df):
    return [r.log_id for r in df.collect()]


def test_newest_opens_few_files(spark, path, monkeypatch):
    opened = _opened(monkeypatch)
    want = _ids(ranking.newest(spark.read.parquet(path), 40))
    got = file_index.newest(spark, path, 40)
    assert _ids(ranking.newest(got, 40)) == want and len(opened) == file_index.FIRST_FILES
    _late(spark, path)
    opened.clear()
    want = _ids(ranking.newest(spark.read.parquet(path), 40))
    assert want[0] == 99_999 and _ids(ranking.newest(file_index.newest(spark, path, 40), 40)) == want
    # Once known, the row of the future costs its file and no more.
    file_index.refresh(spark, path)
    opened.clear()
    assert _ids(ranking.newest(file_index.newest(spark, path, 40), 40)) == want and len(opened) == file_index.FIRST_FILES
    assert file_index.newest(spark, path, 100_000).count() == spark.read.parquet(path).count()


def test_newest_with_a_condition(spark, path):
    keep = lambda rows: rows.filter("message like '%ZEBRA%'")
    want = _ids(ranking.newest(keep(spark.read.parquet(path)), 5))
    assert _ids(ranking.newest(file_index.newest(spark, path, 5, keep), 5)) == want


def test_words_open_the_files_that_hold_them(spark, path, monkeypatch):
    files = len(file_index._listed(spark, path))
    for words in (("zebra²",), ("ebr",), ("connection refused", "nothing"), ("usb", "5"), ("5",), ("unheard-of",), ("n r",), ("a zebra² cr",)):
        opened = _opened(monkeypatch)
        want = sorted(_ids(spark.read.parquet(path).filter(taxonomy.has_any("message", words))))
        assert sorted(_ids(file_index.matching(spark, path, words))) == want
        assert len(opened) <= files
        if words == ("unheard-of",):
            assert not opened
        monkeypatch.undo()
    held = {r.f for r in spark.read.parquet(path).filter("message like '%ZEBRA%'").select(F.col("_metadata.file_path").alias("f")).collect()}
    assert file_index.files_with(spark, path, ("zebra",)).count() == len(held) < files


def test_summary_is_a_sum_over_files(spark, path, monkeypatch):
    def want():
        rows = spark.read.parquet(path)
        flags = {**taxonomy.flags("message", taxonomy.CATEGORY_WORDS, "is_"), **taxonomy.flags("message", taxonomy.SEVERITY_WORDS, "est_")}
        return rows.agg(F.count("*").alias("rows"), *[F.count_if(c).alias(n) for n, c in flags.items()], F.min("timestamp").alias("least"), F.max("timestamp").alias("greatest")).first()

    opened = _opened(monkeypatch)
    assert file_index.summary(spark, path).first() == want() and not opened
    _late(spark, path)
    assert file_index.summary(spark, path).first() == want() and len(opened) == 2  # two months
    # Files that are gone no longer count.
    os.remove(file_index._listed(spark, path)[0].removeprefix("file:"))
    assert file_index.summary(spark, path).first().rows == spark.read.parquet(path).count()


def test_hits_of_each_list_end_by_themselves(spark, path, monkeypatch):
    _late(spark, path)
    columns = ("timestamp", "message", "host")
    rows = spark.read.parquet(path)
    want = []
    for name, words in LISTS.items():
        hits = {tuple(r) for r in rows.filter(taxonomy.has_any("message", words)).select(*columns).collect()}
        best = sorted(hits, key=lambda r: (-r[0].timestamp(), r[1], r[2]))[:10]
        want += [(name, *r, i) for i, r in enumerate(best, 1)]
    got = [tuple(r) for r in file_index.newest_hits(spark, path, LISTS, 10, columns).collect()]
    assert sorted(got) == sorted(want) and {r[0] for r in got} == {"rare", "common", "two"}
    file_index.refresh(spark, path)
    opened = _opened(monkeypatch)
    file_index.newest_hits(spark, path, {"rare": ("zebra",), "none": ("unheard-of",)}, 10, columns)
    assert 0 < len(opened) == len(set(opened)) == file_index.files_with(spark, path, ("zebra",)).count()


def test_newest_distinct_passes_on_few_rows(spark):
    """200,000 copies at the newest instant, nulls, and a list that is rare."""
    copies = spark.range(200_000).select(F.lit("a").alias("category"), F.lit(START).alias("timestamp"), F.lit("same").alias("message"), F.lit("h").alias("host"))
    rows = [("a", START, f"m{i % 30}", None if i % 3 else f"h{i % 2}") for i in range(400)] + [("b", None, None, None), ("b", START, "x", "y"), (None, START, "z", "z")]
    other = spark.createDataFrame(rows, "category string, timestamp timestamp, message string, host string")
    df = copies.unionByName(other).repartition(8)
    state = ranking.newest_distinct(df, "category", ("timestamp", "message", "host"), 10, held_rows=1000)
    assert state.count() <= 8 * 10 * 3
    order = [F.col("timestamp").desc(), F.col("message").asc(), F.col("host").asc()]
    top = lambda d: sorted(map(tuple, ranking.top_per_group(d.distinct(), ["category"], order, 10, rank="rank", salts=1).collect()), key=repr)
    assert top(state) == top(df)
    assert ranking.newest_distinct(df.limit(0), "category", ("timestamp", "message", "host"), 10).count() == 0


def test_reports_agree_with_the_index(spark, path):
    summary = file_index.summary(spark, path).first()
    report = reports.insights_summary(spark.read.parquet(path)).first()
    assert (summary["rows"], summary.is_error, summary.is_hardware) == (report.total_logs, report.errors, report.hardware_issues)
