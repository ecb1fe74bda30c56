"""What the plans must look like: pushed bounds, pruned columns, and no products of tables."""

import re

import pytest

import __spark_entry__ as entry
from loglantern.operators import filters, reports, search
from loglantern.plans.tables import logs

QUERIES = entry.queries()
# Queries that train, write or stream first and end in a plain file scan.
EAGER = ("classifier", "stream", "_view", "stored", "retention", "csv", "json", "os_log", "rebuild", "recall", "indexed", "word_rows", "line_ingest", "knn_lsh")
LAZY = sorted(name for name in QUERIES if not any(part in name for part in EAGER))


def _read_schemas(text):
    return re.findall(r"ReadSchema: struct<([^>]*)>", text)


@pytest.mark.parametrize("name", LAZY)
def test_no_products(name, spark, sf_dir, plan):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text  # no function called row by row


@pytest.mark.parametrize("name", ["hourly_counts", "error_trend", "retained_logs", "logs_by_source", "log_statistics"])
def test_time_bound_reaches_the_scan(name, spark, sf_dir, plan):
    assert "GreaterThanOrEqual(ts," in plan(QUERIES[name](spark, sf_dir))


def test_columns_are_pruned(spark, sf_dir, plan):
    rows = logs(spark, sf_dir)
    assert _read_schemas(plan(reports.total_count(rows))) == [""]
    assert _read_schemas(plan(reports.range_stats(rows))) == ["ts:timestamp_ntz"]
    assert _read_schemas(plan(reports.top_hosts(rows))) == ["user_id:bigint"]
    assert _read_schemas(plan(reports.level_counts(rows))) == ["event_type:string"]


def test_summary_is_one_scan(spark, sf_dir, plan):
    text = plan(reports.insights_summary(logs(spark, sf_dir)))
    assert text.count("FileScan") == 1 and text.count("Exchange SinglePartition") == 1


def test_statistics_are_one_scan(spark, sf_dir, plan):
    text = plan(reports.log_statistics(logs(spark, sf_dir), None))
    assert text.count("FileScan") == 1 and "Expand" not in text


def test_limits_are_top_n(spark, sf_dir, plan):
    rows = logs(spark, sf_dir)
    for df in (reports.newest_rows(rows, 5), reports.sample_export(rows), reports.top_sources(rows), reports.per_minute(rows)):
        text = plan(df)
        assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_groups_are_cut_before_the_shuffle(spark, sf_dir, plan):
    rows = logs(spark, sf_dir)
    text = plan(reports.category_samples(rows))
    lowest = text[text.rindex("Exchange"):]
    assert "WindowGroupLimit" in lowest and "Partial" in lowest
    text = plan(search.keyword_hits(rows))
    assert "MapInArrow" in text[text.rindex("Exchange"):]  # a bounded state without copies


def test_level_filter_is_pushed(spark, sf_dir, tmp_path, plan):
    path = str(tmp_path / "logs")
    logs(spark, sf_dir).write.parquet(path)
    text = plan(filters.error_rows(spark.read.parquet(path)))
    assert "EqualTo(level,error)" in text
