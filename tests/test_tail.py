"""Lines of files that grow: appended, rotated, cut short, read in ranges, and after a stop."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from loglantern.plans import jobs
from loglantern.sources import tail


class _Folder:
    def __init__(self, spark, root):
        self.spark, self.root = spark, str(root)
        os.mkdir(f"{self.root}/in")

    def put(self, name, data, mode="ab"):
        with open(f"{self.root}/in/{name}", mode) as f:
            f.write(data if isinstance(data, bytes) else data.encode())

    def run(self, **options):
        lines = tail.follow(self.spark, f"{self.root}/in", pattern="*.log*", **options)
        writer = lines.writeStream.format("parquet").option("path", f"{self.root}/out").option("checkpointLocation", f"{self.root}/cp")
        writer.trigger(availableNow=True).start().awaitTermination()
        return sorted(r.value for r in self.spark.read.schema(tail.SCHEMA).parquet(f"{self.root}/out").collect())


@pytest.fixture
def folder(spark, tmp_path):
    return _Folder(spark, tmp_path)


def test_appended_lines_come_once(folder):
    folder.put("a.log", "one\ntwo\nthr")
    folder.put("note.txt", "not a log\n")
    assert folder.run() == ["one", "two"]
    folder.put("a.log", "ee\r\n\nfo")
    assert folder.run() == ["", "one", "three", "two"]
    assert folder.run() == ["", "one", "three", "two"]
    folder.put("a.log", b"ur \xff\n")
    folder.put("b.log", "five\n")
    assert folder.run() == ["", "five", "four �", "one", "three", "two"]


def test_rotation(folder):
    folder.put("a.log", "one\ntwo\n")
    assert folder.run() == ["one", "two"]
    folder.put("a.log", "three\n")
    os.rename(f"{folder.root}/in/a.log", f"{folder.root}/in/a.log.1")
    folder.put("a.log", "four\n")
    assert folder.run() == ["four", "one", "three", "two"]
    os.rename(f"{folder.root}/in/a.log.1", f"{folder.root}/in/a.log.2")
    os.rename(f"{folder.root}/in/a.log", f"{folder.root}/in/a.log.1")
    assert folder.run() == ["four", "one", "three", "two"]
    folder.put("a.log.1", "cut\n", "wb")  # cut short and begun anew
    assert folder.run() == ["cut", "four", "one", "three", "two"]
    os.remove(f"{folder.root}/in/a.log.2")
    folder.put("a.log.1", "more\n")
    assert folder.run() == ["cut", "four", "more", "one", "three", "two"]


def test_from_end(folder):
    folder.put("a.log", "old\nunfin")
    assert folder.run(from_end=True) == []
    folder.put("a.log", "ished\nnew\n")
    assert folder.run(from_end=True) == ["new", "unfinished"]


@pytest.mark.parametrize("split", [1, 2, 7, 50])
def test_ranges_hold_each_line_once(tmp_path, split):
    rng = random.Random(split)
    lines = ["x" * rng.choice([0, 0, 1, 3, 20, 60]) for _ in range(200)]
    (tmp_path / "a").write_text("\n".join(lines) + "\n" + "open")
    reader = tail._Reader({"path": str(tmp_path), "splitBytes": str(split)})
    start, end = reader.initialOffset(), reader.latestOffset()
    parts = reader.partitions(start, end)
    got = [row for part in parts for row in reader.read(part)]
    assert [g[0] for g in got] == lines and len({g[2] for g in got}) == len(lines)
    assert json.loads(end["files"])[str(tmp_path / "a")]["at"] == sum(len(x) + 1 for x in lines)


def test_long_lines_and_no_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "_CHUNK", 16)
    (tmp_path / "a").write_text("y" * 1000 + "\nshort\n" + "z" * 100)
    (tmp_path / "b").write_text("")
    (tmp_path / "c").write_text("no end")
    reader = tail._Reader({"path": str(tmp_path), "splitBytes": "64"})
    got = [row for part in reader.partitions(reader.initialOffset(), reader.latestOffset()) for row in reader.read(part)]
    assert [g[0] for g in got] == ["y" * 1000, "short"]
    none = tail._Reader({"path": str(tmp_path / "absent")})
    assert none.partitions(none.initialOffset(), none.latestOffset()) == []


def test_lines_reach_the_table_with_flags(spark, folder):
    folder.put("a.log", "kernel panic\nall is well\n")
    table = f"{folder.root}/table"
    run = lambda: jobs.ingest_lines(spark, f"{folder.root}/in", table, f"{folder.root}/cp2", host="h1", once=True).awaitTermination()
    run()
    folder.put("a.log", "disk failed\n")
    run()
    run()
    rows = {r.message: r for r in spark.read.parquet(table).collect()}
    assert len(rows) == spark.read.parquet(table).count() == 3
    assert rows["kernel panic"].is_error and not rows["all is well"].is_error and rows["disk failed"].find_hardware
    assert {r.host for r in rows.values()} == {"h1"} and all(r.metadata.endswith('a.log"}') for r in rows.values())
    assert spark.read.parquet(table).filter(F.col("ym").isNull()).count() == 0


def test_a_batch_that_is_run_again_stores_nothing_twice(spark, folder):
    """A stop after the rows were written and before the batch was marked as done."""
    folder.put("a.log", "one\n")
    assert folder.run() == ["one"]
    folder.put("a.log", "two\n")
    assert folder.run() == ["one", "two"]
    os.remove(f"{folder.root}/cp/commits/1")
    for name in os.listdir(f"{folder.root}/cp/commits"):
        if name.startswith(".1"):
            os.remove(f"{folder.root}/cp/commits/{name}")
    folder.put("a.log", "three\n")
    folder.run()  # the batch again
    assert folder.run() == ["one", "three", "two"]
