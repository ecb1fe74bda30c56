import datetime as dt
import time

from pyspark.sql import functions as F

from loglantern import schemas
from loglantern.operators import embedding, filters
from loglantern.sources import readers
from loglantern.streaming import ingest, trends

START = dt.datetime(2024, 1, 1)
SCHEMA = (
    "log_id bigint, timestamp timestamp, source string, level string, message string, pid bigint, thread_id string, metadata string"
)


def _rows(spark, ids):
    levels = ["error", "warning", "info"]
    rows = [
        (i, START + dt.timedelta(minutes=i), f"s{i % 4}", levels[i % 3], f"message {i % 9}", i % 7, "t", "{}") for i in ids
    ]
    return spark.createDataFrame(rows, SCHEMA).coalesce(1)


def _stream(spark, path, **options):
    return ingest.read_table_stream(spark, path, spark.createDataFrame([], SCHEMA).schema, **options)


def test_lines_become_raw_rows(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text("first\nerror: second\n" + "x" * 100 + "\n", encoding="utf-8")
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    stream = ingest.read_lines(spark, str(folder), host="web1", max_line_bytes=50)
    ingest.to_table(stream, out, check, once=True).awaitTermination()
    (folder / "b.log").write_text("third\n", encoding="utf-8")
    ingest.to_table(ingest.read_lines(spark, str(folder), host="web1", max_line_bytes=50), out, check, once=True).awaitTermination()
    raw = spark.read.parquet(out)
    assert raw.columns == schemas.RAW_LOGS.names
    got = {r.message: r for r in raw.collect()}
    assert set(got) == {"first", "error: second", "third"}  # nothing twice, the long line left out
    assert got["third"].file.endswith("b.log") and got["first"].host == "web1"
    levels = {r.message: r.level for r in readers.normalise(raw).collect()}
    assert levels["error: second"] == "error"


def test_start_at_the_end(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "old.log").write_text("old\n", encoding="utf-8")
    time.sleep(1.1)
    start = dt.datetime.now(dt.timezone.utc)
    time.sleep(0.1)
    (folder / "new.log").write_text("new\n", encoding="utf-8")
    out = str(tmp_path / "out")
    stream = ingest.read_lines(spark, str(folder), start=start)
    ingest.to_table(stream, out, str(tmp_path / "check"), once=True).awaitTermination()
    assert [r.message for r in spark.read.parquet(out).collect()] == ["new"]


def test_console(spark, tmp_path):
    _rows(spark, range(3)).write.parquet(str(tmp_path / "in"))
    query = ingest.to_console(_stream(spark, str(tmp_path / "in")), str(tmp_path / "check"), once=True)
    query.awaitTermination()
    assert query.exception() is None


def test_views_equal_the_batch_filter(spark, tmp_path):
    source = str(tmp_path / "in")
    for start in range(0, 90, 30):
        _rows(spark, range(start, start + 30)).write.mode("append").parquet(source)
    paths = {"error": str(tmp_path / "error"), "warning": str(tmp_path / "warning")}
    everything = str(tmp_path / "logs")
    for _ in range(2):  # the second run finds nothing new
        stream = _stream(spark, source, max_files=1)
        ingest.maintain_views(stream, paths, str(tmp_path / "check"), once=True, logs_path=everything).awaitTermination()
    batch = spark.read.parquet(source)
    schema = batch.select(*filters.VIEW_COLUMNS).schema
    for level, expected in (("error", filters.error_rows(batch)), ("warning", filters.warning_rows(batch))):
        got = ingest.read_view(spark, paths[level], schema)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    assert ingest.read_view(spark, everything, batch.schema).count() == 90


def test_replayed_batch_counts_once(spark, tmp_path):
    """Losing the checkpoint replays the batch; its folder is overwritten."""
    source, path = str(tmp_path / "in"), str(tmp_path / "error")
    _rows(spark, range(30)).write.parquet(source)
    for attempt in range(2):
        ingest.maintain_views(
            _stream(spark, source), {"error": path}, str(tmp_path / f"check{attempt}"), once=True
        ).awaitTermination()
    schema = spark.read.parquet(source).select(*filters.VIEW_COLUMNS).schema
    assert ingest.read_view(spark, path, schema).count() == 10


def test_hourly_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    for start in range(0, 300, 100):
        _rows(spark, range(start, start + 100)).write.mode("append").parquet(source)
    counts = trends.hourly(trends.event_time(_stream(spark, source, max_files=1)))
    trends.keep_current(counts, str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination()
    got = {str(r.hour): (r["count"], r.errors, r.warnings) for r in trends.read_current(spark, str(tmp_path / "out"), "hour").collect()}
    batch = trends.hourly(spark.read.parquet(source))
    assert got == {str(r.hour): (r["count"], r.errors, r.warnings) for r in batch.collect()}
    assert sum(v[0] for v in got.values()) == 300


def test_error_minutes_sketch(spark, tmp_path):
    source = str(tmp_path / "in")
    _rows(spark, range(60)).write.parquet(source)
    counts = trends.error_minutes(trends.event_time(_stream(spark, source)), "1 hour")
    trends.keep_current(counts, str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination()
    row = trends.read_current(spark, str(tmp_path / "out"), "minute").first()
    assert (row.error_count, row.unique_sources) == (20, 4)


def test_replays_are_dropped(spark, tmp_path):
    source = str(tmp_path / "in")
    _rows(spark, range(40)).write.mode("append").parquet(source)
    _rows(spark, range(20, 60)).write.mode("append").parquet(source)
    rows = trends.without_replays(trends.event_time(_stream(spark, source, max_files=1), lateness="2 hours"))
    out = str(tmp_path / "out")
    ingest.to_table(rows, out, str(tmp_path / "check"), once=True, by_month=True).awaitTermination()
    stored = spark.read.parquet(out)
    assert sorted(r.log_id for r in stored.collect()) == list(range(60)) and "ym" in stored.columns


def test_enrichment_adds_new_rows_only(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = _rows(spark, range(10))
    first.write.mode("append").parquet(source)
    encoder = embedding.lexical_encoder(embedding.fit_lexical(first, dim=16))
    encode = lambda rows: embedding.embed(rows.select("log_id", "message"), encoder)
    run = lambda: ingest.enrich(_stream(spark, source), encode, out, str(tmp_path / "check"), once=True).awaitTermination()
    run()
    _rows(spark, range(10, 15)).write.mode("append").parquet(source)
    run()
    stored = {r.log_id: r.embedding for r in spark.read.parquet(out).collect()}
    assert sorted(stored) == list(range(15)) and len(stored[0]) == 16
    batch = {r.log_id: r.embedding for r in embedding.embed(first, encoder).collect()}
    assert all(stored[i] == batch[i] for i in batch)


def test_periodic_trigger(spark, tmp_path):
    """A running query takes in what arrives between two triggers."""
    assert ingest.COLLECTION_INTERVAL == 600
    source = str(tmp_path / "in")
    _rows(spark, range(3)).write.mode("append").parquet(source)
    query = ingest.to_table(_stream(spark, source), str(tmp_path / "out"), str(tmp_path / "check"), seconds=1)
    try:
        query.processAllAvailable()
        _rows(spark, range(3, 5)).write.mode("append").parquet(source)
        query.processAllAvailable()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    finally:
        query.stop()
