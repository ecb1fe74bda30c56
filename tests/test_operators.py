import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loglantern.operators import filters, ranking, reports
from loglantern.sources import writers

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def skewed(spark):
    """Rows of which a third share one message, source and level, many at the same instant."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        hot = i % 3 == 0
        moment = START + dt.timedelta(seconds=rng.randrange(0, 6 * 86400) // 60 * 60)
        rows.append(
            (
                i,
                moment,
                "hot" if hot else f"s{rng.randrange(40)}",
                "error" if hot else rng.choice(["info", "warning", "debug", "critical"]),
                "usb disk failed " + "z" * 90 if hot else rng.choice(["deny", "ok", "", "camera error", "panic %_"]) + f" {i % 50}",
                f"h{i % 5}",
                f"/f{i % 3}",
                "file",
                i % 7,
                f"t{i % 4}",
                "{}",
            )
        )
    schema = (
        "log_id bigint, timestamp timestamp, source string, level string, message string, host string, file string, "
        "source_type string, pid bigint, thread_id string, metadata string"
    )
    return spark.createDataFrame(rows, schema).repartition(6)


def _py(df):
    return [r.asDict() for r in df.collect()]


def test_time_bounds_are_inclusive(spark):
    rows = [(i, START + dt.timedelta(minutes=i)) for i in range(5)]
    df = spark.createDataFrame(rows, "log_id int, timestamp timestamp")
    ids = lambda d: sorted(r.log_id for r in d.collect())
    assert ids(filters.recent(df, "2024-01-01 00:04:00", minutes=2)) == [2, 3, 4]
    assert ids(filters.within(df, "2024-01-01 00:01:00", "2024-01-01 00:03:00")) == [1, 2, 3]
    aware = dt.datetime(2024, 1, 1, 2, 4, tzinfo=dt.timezone(dt.timedelta(hours=2)))
    assert ids(filters.recent(df, aware, minutes=2)) == [2, 3, 4]
    old = df.filter(filters.expired(df, "2024-01-02 00:02:00", days=1))
    assert ids(old) == [0, 1]
    assert ids(filters.retained(df, "2024-01-02 00:02:00", days=1)) == [2, 3, 4]


def test_now_is_the_default(spark):
    df = spark.sql("select 1 as log_id, current_timestamp() as timestamp union all select 2, timestamp '2020-01-01'")
    assert [r.log_id for r in filters.recent(df, minutes=5).collect()] == [1]


def test_search_term_is_plain_text(spark, skewed):
    found = reports.search_logs(skewed, "%_", limit=5000).collect()
    assert found and all("%_" in r.message for r in found)
    with_all = reports.search_logs(skewed, "FAILED", "hot", "error", 10).collect()
    assert len(with_all) == 10
    assert [r.timestamp for r in with_all] == sorted((r.timestamp for r in with_all), reverse=True)
    assert reports.search_logs(skewed, "no such text").count() == 0


def test_top_groups_break_ties_by_key(spark):
    df = spark.createDataFrame([(x,) for x in "ccbbad"], "host string")
    assert [r.host for r in reports.top_hosts(df, 3).collect()] == ["b", "c", "a"]


@pytest.mark.parametrize("salts", [1, 5])
def test_top_per_group_matches_brute_force(skewed, salts):
    rows = _py(skewed)
    got = ranking.top_per_group(
        skewed, ["source"], [F.col("timestamp").desc(), F.col("log_id").asc()], 3, rank="r", salts=salts
    ).collect()
    expected = set()
    for source in {r["source"] for r in rows}:
        best = sorted(
            (r for r in rows if r["source"] == source), key=lambda r: (-r["timestamp"].timestamp(), r["log_id"])
        )[:3]
        expected |= {(source, r["log_id"], i + 1) for i, r in enumerate(best)}
    assert {(r.source, r.log_id, r.r) for r in got} == expected


def test_keep_first_matches_brute_force(skewed):
    rows = sorted(_py(skewed), key=lambda r: (-r["timestamp"].timestamp(), r["log_id"]))
    first = {}
    for r in rows:
        first.setdefault(r["message"][:150], r["log_id"])
    got = reports.keep_first_by_prefix(skewed, [F.col("timestamp").desc(), F.col("log_id").asc()])
    assert {r.log_id for r in got.collect()} == set(first.values())


def test_pages_cover_every_row_once(skewed):
    seen, position = [], None
    while True:
        page = ranking.page_after(skewed, position, 700, ("timestamp", "log_id")).select("timestamp", "log_id").collect()
        if not page:
            break
        seen += [r.log_id for r in page]
        last = page[-1]
        position = (F.lit(last.timestamp.isoformat(sep=" ")).cast("timestamp"), F.lit(last.log_id))
    rows = sorted(_py(skewed), key=lambda r: (r["timestamp"], r["log_id"]))
    assert seen == [r["log_id"] for r in rows]


def test_newest_first_scan_gives_the_same(spark, skewed, tmp_path):
    path = str(tmp_path / "logs")
    assert writers.write_logs(skewed, path) == 3000
    stored = spark.read.parquet(path)
    for n in (1, 40, 2999, 5000):
        a = reports.newest_rows(skewed, n).collect()
        b = reports.newest_rows(stored, n).collect()
        assert [tuple(r) for r in a] == [tuple(r) for r in b]
    for n in (2, 50):
        a = sorted(map(tuple, reports.category_samples(skewed, n).select("category", "rank", "log_id").collect()))
        b = sorted(map(tuple, reports.category_samples(stored, n).select("category", "rank", "log_id").collect()))
        assert a == b
    a = sorted(map(tuple, reports.search_logs(skewed, "deny", limit=30).collect()))
    assert a == sorted(map(tuple, reports.search_logs(stored, "deny", limit=30).collect()))


def test_statistics_fill_levels_with_zero(spark, skewed):
    empty = reports.log_statistics(skewed.filter("false"), None)
    assert {(r.kind, r.key, r["count"]) for r in empty.collect()} == {("total", "", 0)} | {
        ("level", level, 0) for level in ("debug", "info", "warning", "error", "critical")
    }
    rows = _py(skewed)
    got = {(r.kind, r.key): r["count"] for r in reports.log_statistics(skewed, None).collect()}
    assert got["total", ""] == 3000 and got["source", "hot"] == 1000 and got["level", "error"] == 1000
    assert got["level", "critical"] == sum(r["level"] == "critical" for r in rows)


def test_unreported_levels_count_in_the_total_only(spark):
    df = spark.createDataFrame([("trace", "s"), ("info", "s")], "level string, source string")
    got = {(r.kind, r.key): r["count"] for r in reports.log_statistics(df, None).collect()}
    assert ("level", "trace") not in got and got["total", ""] == 2 and got["source", "s"] == 2


def test_error_trend_counts_sources(skewed):
    exact = reports.error_trend(skewed, 24 * 10, "2024-01-08 00:00:00").collect()
    assert sum(r.error_count for r in exact) == 1000 and {r.unique_sources for r in exact} == {1}
    sketch = reports.error_trend(skewed, 24 * 10, "2024-01-08 00:00:00", approximate=True).collect()
    assert [r.error_count for r in sketch] == [r.error_count for r in exact]


def test_shares_sum_to_100(skewed):
    shares = [r.percentage for r in reports.level_share(skewed).collect()]
    assert abs(sum(shares) - 100) < 0.5 and shares[0] == 33.3
    assert reports.level_share(skewed.filter("false")).count() == 0


def test_collection_summary(spark, skewed):
    row = reports.collection_summary(skewed, skewed, 60 * 24 * 30, "2024-01-08 00:00:00").first()
    assert row.message == "Parsed 3000 system log entries from lastmin.log"
    assert row.metadata["total_logs"] == "3000" and '"error":1000' in row.metadata["by_level"]
    assert '"hot":1000' in row.metadata["by_source"]
    assert reports.collection_summary(skewed, skewed, 1, "2030-01-01 00:00:00").count() == 0


def test_summary_on_stored_flags(spark, skewed):
    flagged = writers.with_ingest_columns(skewed)
    assert reports.insights_summary(flagged).collect() == reports.insights_summary(skewed).collect()
    assert reports.severity_estimate(flagged).collect() == reports.severity_estimate(skewed).collect()
    since = F.lit("2024-01-03 00:00:00").cast("timestamp")
    part = reports.insights_summary(skewed, since).first().total_logs
    assert part == skewed.filter(F.col("timestamp") >= since).count() < 3000


def test_display_samples(skewed):
    rows = reports.dashboard_samples(skewed).collect()
    assert len(rows) == 6 and all(r.preview.endswith("...") for r in rows)
