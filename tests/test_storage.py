import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from loglantern import schemas
from loglantern.operators import embedding, filters, retention
from loglantern.plans import jobs
from loglantern.plans.tables import logs
from loglantern.sources import readers, writers


def _write(path, text):
    path.mkdir(parents=True, exist_ok=True)
    (path / "part.json").write_text(text, encoding="utf-8")
    return str(path)


RECORDS = [
    {"timestamp": "2024-01-01T10:00:00Z", "source": "kernel", "eventMessage": "Login Failure", "process": "p"},
    {"source": "net", "eventMessage": "debug: no time"},
    {"timestamp": "never", "source": "x", "eventMessage": "dropped"},
    {"timestamp": "2024-01-01T12:00:00+02:00", "eventMessage": "a Warn"},
]
AS_OF = "2024-02-02 00:00:00"


def _check_entries(df):
    got = {r.message: r for r in df.collect()}
    assert set(got) == {"Login Failure", "debug: no time", "a Warn"}
    assert [got[m].level for m in ("Login Failure", "debug: no time", "a Warn")] == ["error", "debug", "warning"]
    moments = {m: str(r.timestamp) for m, r in got.items()}
    assert moments["Login Failure"] == moments["a Warn"] == "2024-01-01 10:00:00"
    assert moments["debug: no time"] == AS_OF
    assert got["a Warn"].source == "system" and got["Login Failure"].metadata["process"] == "p"
    assert got["a Warn"].metadata == {k: "" for k in ("subsystem", "category", "process", "thread", "eventType", "messageType")}


def test_os_log_array(spark, tmp_path):
    path = _write(tmp_path / "in", json.dumps(RECORDS, indent=1))
    _check_entries(readers.read_os_log_arrays(spark, path, AS_OF))


def test_os_log_lines(spark, tmp_path):
    lines = ["["] + [json.dumps(r) + "," for r in RECORDS] + ["not json", "", '{"timestamp": 1', "]"]
    _check_entries(readers.read_os_log_lines(spark, _write(tmp_path / "in", "\n".join(lines)), AS_OF))


def test_empty_record_gets_defaults(spark, tmp_path):
    row = readers.read_os_log_lines(spark, _write(tmp_path / "in", "{}\n"), AS_OF).first()
    assert (row.source, row.level, row.message, str(row.timestamp)) == ("system", "info", "", AS_OF)


def test_json_entries_skip_bad_lines(spark, tmp_path):
    good = {"timestamp": "2024-01-01T00:00:00Z", "source": "s", "level": "info", "message": "m", "metadata": {"a": "1"}}
    old = {**good, "timestamp": "2023-12-31T23:49:59Z"}
    lines = [json.dumps(good), "not json", "", json.dumps(old), json.dumps({"source": "no time"})]
    path = _write(tmp_path / "in", "\n".join(lines))
    assert readers.read_json_entries(spark, path).count() == 2
    recent = readers.recent_entries(spark, path, 10, "2024-01-01 00:00:00").collect()
    assert [r.metadata for r in recent] == [{"a": "1"}]
    assert readers.recent_entries(spark, str(tmp_path / "absent")).count() == 0


def test_append_json_twice(spark, tmp_path):
    path = str(tmp_path / "out")
    entries = spark.createDataFrame([("s", "info", "m")], "source string, level string, message string").withColumns(
        {"timestamp": F.lit("2024-01-01").cast("timestamp"), "metadata": F.create_map(F.lit("k"), F.lit("v"))}
    )
    writers.append_json(entries, path)
    writers.append_json(entries, path)
    assert readers.read_json_entries(spark, path).count() == 2


@pytest.fixture(scope="module")
def typed(spark, sf_dir):
    return logs(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def test_table_layout(spark, typed, tmp_path, plan):
    path = str(tmp_path / "logs")
    later = typed.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 45 DAYS"))
    assert writers.write_logs(typed.unionByName(later), path, files=6) == 2 * typed.count()
    stored = spark.read.parquet(path)
    assert stored.count() == 2 * typed.count()
    assert {r.ym for r in stored.select("ym").distinct().collect()} == {202401, 202402, 202403}
    files = [f for f in (tmp_path / "logs" / "ym=202401").iterdir() if f.suffix == ".parquet"]
    assert len(files) > 1  # a month is spread over files
    ranges = sorted(
        (r.lo, r.hi)
        for r in spark.read.parquet(str(tmp_path / "logs" / "ym=202401"))
        .groupBy(F.input_file_name())
        .agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
        .collect()
    )
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))  # files do not overlap in time
    text = plan(filters.within(stored, "2024-03-01 00:00:00", "2024-03-02 00:00:00"))
    assert "PartitionFilters: [isnotnull(ym" in text and ">= 202403" in text
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp" in text


def test_stored_schema(spark, tmp_path):
    raw = spark.createDataFrame([("2024-01-01 00:00:00", "h", "f", "file", "disk failed")], schemas.RAW_LOGS)
    rows = readers.normalise(raw, AS_OF)
    assert rows.schema.names == schemas.LOGS.names
    assert [f.dataType for f in rows.schema.fields] == [f.dataType for f in schemas.LOGS.fields]
    path = str(tmp_path / "logs")
    assert writers.store_logs(rows, path) == 1
    back = readers.read_logs(spark, path).first()
    assert (back.level, back.ym, back.timestamp_unix, back.metadata) == ("error", 202401, 1704067200.0, '{"file":"f"}')


def test_csv_export(spark, tmp_path):
    report = spark.createDataFrame([("a", 1)], "k string, n int")
    path = writers.export_csv(report, str(tmp_path), "top", epoch=123)
    assert path.endswith("top_123.csv")
    assert spark.read.option("header", True).csv(path).collect() == [("a", "1")]
    assert writers.export_csv(report.filter("false"), str(tmp_path), "none") == ""
    assert not list(tmp_path.glob("none*"))


def test_reports_job(spark, typed, tmp_path):
    paths = jobs.run_reports(typed, str(tmp_path), epoch=5)
    assert set(paths) == {"top_hosts", "top_files", "per_minute", "message_length_hist", "severity_estimate", "sample_10k"}
    severity = spark.read.option("header", True).csv(paths["severity_estimate"]).first()
    assert (severity.errors, severity.warnings, severity.debugs) == ("189", "63", "63")
    buckets = {r.bucket: r["count"] for r in spark.read.option("header", True).csv(paths["message_length_hist"]).collect()}
    assert buckets == {"0": "374", "100": "564"}


def test_vectors_are_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "vectors")
    assert writers.load_vectors(spark, path).count() == 0
    make = lambda texts: spark.createDataFrame([(t, [1.0]) for t in texts], "text string, embedding array<float>").withColumn(
        "updated_at", F.current_timestamp()
    )
    writers.replace_vectors(make(["a", "b"]), path)
    writers.replace_vectors(make(["c"]), path)
    assert [r.text for r in writers.load_vectors(spark, path).collect()] == ["c"]
    assert writers.replace_vectors(make(["c"]).filter("false"), path) is None
    assert [r.text for r in writers.load_vectors(spark, path).collect()] == ["c"]


def test_missing_store_is_empty_and_a_broken_one_fails(spark, tmp_path):
    assert readers.read_or_empty(spark, str(tmp_path / "absent"), schemas.EMBEDDINGS).count() == 0
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="not a Parquet file|FAILED_READ_FILE"):
        readers.read_or_empty(spark, str(broken), schemas.EMBEDDINGS).count()


def test_backfill_is_incremental(spark, typed, tmp_path):
    path = str(tmp_path / "embeddings")
    encoder = embedding.lexical_encoder(embedding.fit_lexical(typed, dim=16))
    raw = typed.select("timestamp", "host", "file", "source_type", "message")
    with_text = raw.filter("message != ''").count()
    assert jobs.backfill(raw, path, encoder, max_rows=100) == 100
    assert jobs.backfill(raw, path, encoder) == with_text - 100
    assert jobs.backfill(raw, path, encoder) == 0
    stored = readers.read_or_empty(spark, path, schemas.EMBEDDINGS)
    assert stored.count() == with_text == stored.select("log_id").distinct().count()


def test_collect_job(spark, tmp_path):
    export = _write(tmp_path / "in", json.dumps(RECORDS))
    table, entries = str(tmp_path / "table"), str(tmp_path / "entries")
    assert jobs.collect_logs(spark, export, table, entries, AS_OF) == 3
    kept = readers.read_json_entries(spark, entries)
    summary = kept.filter("source = 'system_log_parser'").first()
    assert kept.count() == 4 and summary.message.startswith("Parsed 3 ")
    assert summary.metadata["total_logs"] == "1"  # one row of the last minute


# -- retention --------------------------------------------------------------------------------

def _retention_table(spark, path, days):
    rows = [(i, dt.datetime(2024, 3, 15, 12) - dt.timedelta(days=d)) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "log_id int, timestamp timestamp").withColumns(
        {"source": F.lit("s"), "level": F.lit("info"), "message": F.lit("m"), "pid": F.lit(1).cast("bigint")}
    )
    writers.write_logs(df, path)


def test_cutoff_itself_stays(spark, tmp_path):
    path = str(tmp_path / "logs")
    _retention_table(spark, path, [0, 9, 10, 10.00001, 20, 60, 61])
    assert retention.cleanup(spark, path, "2024-03-15 12:00:00", days=10) == 4
    left = spark.read.parquet(path)
    assert sorted(r.log_id for r in left.collect()) == [0, 1, 2]
    assert {p.name for p in tmp_path.joinpath("logs").glob("ym=*")} == {"ym=202403"}
    assert retention.cleanup(spark, path, "2024-03-15 12:00:00", days=10) == 0


def test_everything_expired(spark, tmp_path):
    path = str(tmp_path / "logs")
    _retention_table(spark, path, [1, 2, 50])
    assert retention.cleanup(spark, path, "2024-03-31 12:00:00", days=1) == 3
    assert not list(tmp_path.joinpath("logs").glob("ym=*"))


def test_cut_short_run_is_finished(spark, tmp_path):
    """Staged and committed, but not yet moved: the next run completes it and loses nothing."""
    path = str(tmp_path / "logs")
    _retention_table(spark, path, [0, 5, 12])
    kept = spark.read.parquet(f"{path}/ym=202403").filter("log_id < 2")
    kept.write.parquet(f"{path}/_retention/ym=202403")
    assert spark.read.parquet(path).count() == 3  # readers do not see the staging folder
    assert retention.cleanup(spark, path, "2024-03-15 12:00:00", days=10) == 0
    assert sorted(r.log_id for r in spark.read.parquet(path).collect()) == [0, 1]


def test_uncommitted_staging_is_discarded(spark, tmp_path):
    path = str(tmp_path / "logs")
    _retention_table(spark, path, [0, 5])
    (tmp_path / "logs" / "_retention" / "ym=202403").mkdir(parents=True)
    assert retention.cleanup(spark, path, "2024-03-15 12:00:00", days=10) == 0
    assert spark.read.parquet(path).count() == 2
