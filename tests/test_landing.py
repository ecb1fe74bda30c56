"""Tables that streams add to, expired and merged while they do; and JSON arrays in byte ranges."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglantern import schemas
from loglantern.sources import json_ranges, landing, readers

SCHEMA = "log_id long, timestamp timestamp, message string"
NOW = dt.datetime(2024, 3, 20, 12)


def _rows(spark, first, count, day):
    return spark.createDataFrame([(i, NOW - dt.timedelta(days=day, minutes=i), f"m{i}") for i in range(first, first + count)], SCHEMA)


def _ids(spark, path):
    rows = [r.log_id for r in landing.read_landed(spark, path).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def _names(spark, path):
    store = landing._Store(spark, path)
    return [name for month in landing._months(store, path) for name, _ in landing._files(store, path, month)]


def test_a_batch_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    assert landing.read_landed(spark, path, _rows(spark, 0, 1, 0).schema).count() == 0
    landing.land(_rows(spark, 0, 50, 1).repartition(3), path, 0)
    landing.land(_rows(spark, 50, 50, 40), path, 1)
    landing.land(_rows(spark, 0, 60, 1).filter("log_id < 50").repartition(1), path, 0)
    assert _ids(spark, path) == set(range(100))
    landing.land(_rows(spark, 0, 0, 1), path, 2)
    assert _ids(spark, path) == set(range(100)) and not landing._Store(spark, path).entries(f"{path}/_batches")


def test_expiry_and_merging_leave_what_comes_meanwhile(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    for k in range(6):
        landing.land(_rows(spark, 100 * k, 100, 10 * k).repartition(2), path, k)
    real, late = landing._finish, []

    def slow(store, run):
        if not late:  # a batch lands between the listing and the swap
            late.append(1)
            landing.land(_rows(spark, 900, 100, 0), path, 90)
        real(store, run)

    monkeypatch.setattr(landing, "_finish", slow)
    kept = {i for k in range(6) for i in range(100 * k, 100 * k + 100) if dt.timedelta(days=10 * k, minutes=i) <= dt.timedelta(days=20, hours=4)}
    cut = (NOW - dt.timedelta(hours=4)).isoformat()
    assert landing.expire(spark, path, cut, days=20) == 600 - len(kept)
    assert 0 < len(kept) < 600
    kept |= set(range(900, 1000)) if late else set()
    assert _ids(spark, path) == kept and landing.expire(spark, path, cut, days=20) == 0
    before = len(_names(spark, path))
    fewer = landing.compact(spark, path)
    assert fewer > 0 and len(_names(spark, path)) == before - fewer and _ids(spark, path) >= kept
    assert landing.compact(spark, path) == 0


@pytest.mark.parametrize("step", ["before the marker", "after the marker", "half moved"])
def test_upkeep_that_stopped_half_way(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    for k in range(3):
        landing.land(_rows(spark, 100 * k, 100, 1), path, k)

    before = len(_names(spark, path))

    def stop(*_):
        raise RuntimeError("stopped")

    if step == "before the marker":
        monkeypatch.setattr(landing._Store, "write", stop)
    elif step == "after the marker":
        monkeypatch.setattr(landing, "_finish", stop)
    else:
        monkeypatch.setattr(landing._Store, "drop", lambda self, name: stop() if "/b0" in name and name.endswith(".parquet") else self.fs.delete(self.path_of(name), True))
    with pytest.raises(RuntimeError):
        landing.compact(spark, path)
    monkeypatch.undo()
    landing.recover(spark, path)
    assert _ids(spark, path) == set(range(300)) and not landing._Store(spark, path).entries(f"{path}/_upkeep")
    assert len(_names(spark, path)) == (before if step == "before the marker" else 1)


def test_a_stream_lands_and_goes_on_after_upkeep(spark, tmp_path):
    path, source = str(tmp_path / "t"), str(tmp_path / "in")
    run = lambda: landing.land_stream(spark.readStream.schema(SCHEMA).parquet(source), path, f"{tmp_path}/cp", once=True).awaitTermination()
    _rows(spark, 0, 100, 60).write.mode("append").parquet(source)
    run()
    _rows(spark, 100, 100, 1).write.mode("append").parquet(source)
    run()
    assert landing.expire(spark, path, NOW.isoformat(), days=30) == 100 and landing.compact(spark, path) >= 0
    _rows(spark, 200, 100, 0).write.mode("append").parquet(source)
    run()
    run()
    assert _ids(spark, path) == set(range(100, 300))


# -- JSON arrays ------------------------------------------------------------------------------

TEXTS = ["plain", 'a "quote"', "back\\slash\\", "]}{[", "\\\\\"", "é😀\n", "", "\\", '"]},{"']


def _entries(rng, n):
    return [{"timestamp": "2024-01-01T00:00:00Z", "eventMessage": rng.choice(TEXTS) + rng.choice(TEXTS), "extra": {"a": [1, {"b": "}"}]}, "source": f"s{i}"} for i in range(n)]


def test_structure_matches_a_plain_reading():
    rng = random.Random(1)
    for _ in range(300):
        data = np.frombuffer("".join(rng.choices('\\"{}[]a', k=rng.randint(0, 40))).encode(), np.uint8)
        for in_text in (False, True):
            for escaped in (False, True):
                text, slash, want = in_text, escaped, []
                for b in data.tolist():
                    inside = text
                    quote = b == 0x22 and not slash
                    if quote:
                        text = not text
                    want.append((0 if inside or quote else (b in b"[{") - (b in b"]}")))
                    slash = b == 0x5C and not slash
                change, _, ends_text, ends_slash = json_ranges.structure(data, in_text, escaped)
                assert change.tolist() == want and (ends_text, ends_slash) == (text, slash)


@pytest.mark.parametrize("range_bytes", [1, 3, 17, 100, 1 << 20])
def test_ranges_give_all_records(spark, tmp_path, monkeypatch, range_bytes):
    rng = random.Random(range_bytes)
    entries = _entries(rng, 3 if range_bytes < 3 else 20)
    monkeypatch.setattr(json_ranges, "_CHUNK", 64)
    path = tmp_path / "a.json"
    path.write_text(json.dumps(entries, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5))
    size, got = path.stat().st_size, []
    state = (False, False, 0)
    for first in range(0, size, range_bytes):
        last = min(first + range_bytes, size)
        got += json_ranges.records(str(path), first, last, size, *state, json_ranges._level(str(path), size))
        end = json_ranges._summary(str(path), first, last)[2 * state[0] + state[1]]
        state = (end[0], end[1], state[2] + end[2])
    assert [json.loads(x) for x in got] == entries and state == (False, False, 0)


def test_arrays_are_read_as_by_one_task(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rng = random.Random(4)
    entries = _entries(rng, 300)
    (folder / "a.json").write_text(json.dumps(entries[:200]))
    (folder / "b.json").write_text(json.dumps(entries[200:], indent=2))
    (folder / "c.json").write_text("[]")
    (folder / "d.json").write_text("")
    (folder / "e.json").write_text('{"timestamp": "2024-01-01T00:00:00Z", "source": "one", "eventMessage": "{"}\n{"source": "two", "timestamp": "x"}')
    (folder / "f.json").write_text('[{"source": "s", "eventMessage": "cut sho')
    (folder / "g.json").write_text('[{"source": nonsense}, {"source": "fine", "timestamp": "2024-01-01T00:00:00Z"}]')
    found = json_ranges.read_records(spark, str(folder), range_bytes=1000)
    assert found.rdd.getNumPartitions() > 10
    rows = readers.read_os_log_arrays(spark, str(folder), "2024-05-01 00:00:00", range_bytes=1000)
    got = sorted((r.source, r.message) for r in rows.collect())
    want = [(e["source"], e["eventMessage"]) for e in entries] + [("one", "{"), ("fine", "")]
    assert got == sorted(want)
    assert json_ranges.parsed_or_refused(found, schemas.OS_LOG_RECORD).filter("refused").count() == 1
    (tmp_path / "none").mkdir()
    assert json_ranges.read_records(spark, str(tmp_path / "none")).count() == 0
    assert rows.select(F.col("metadata")["subsystem"].alias("s")).distinct().collect()[0].s == ""


def test_small_ranges_share_tasks_and_read_little(spark, tmp_path, monkeypatch):
    path = tmp_path / "a.json"
    path.write_text(json.dumps([{"source": "s", "eventMessage": "m" * 50}] * 500))
    found = json_ranges.read_records(spark, str(path), range_bytes=100)
    assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert found.count() == 500
    seen = []
    monkeypatch.setattr(json_ranges, "structure", lambda data, *state, real=json_ranges.structure: seen.append(len(data)) or real(data, *state))
    size = path.stat().st_size
    assert len(list(json_ranges.records(str(path), 0, 100, size, False, False, 0, 1))) == 2
    seen.clear()
    monkeypatch.setattr(json_ranges, "_CHUNK", 1 << 10)
    list(json_ranges.records(str(path), 0, 100, size, False, False, 0, 1))
    assert sum(seen) < 400
    seen.clear()
    json_ranges._summary(str(path), 0, 1000)
    assert sum(seen) == 1000  # not once for each of four beginnings


def test_merged_files_have_bounded_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(4_000).select("id", F.timestamp_seconds(F.lit(1_700_000_000) + F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("timestamp"))
    for batch in range(4):
        landing.land(rows.withColumn("id", F.col("id") + 4_000 * batch), path, batch)
    before = landing.read_landed(spark, path).count()
    assert landing.compact(spark, path, file_rows=2_000) > 0
    assert landing.compact(spark, path, file_rows=2_000) == 0  # full files stay
    sizes = landing.read_landed(spark, path).groupBy(landing._file_name().alias("name")).count().collect()
    assert sum(r["count"] for r in sizes) == before == 16_000 and max(r["count"] for r in sizes) <= 4_000
