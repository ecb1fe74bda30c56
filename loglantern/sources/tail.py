"""Lines of files that grow, as a stream.

Spark's file source takes a file once and never sees what is appended to it. This source keeps a byte position for each
file of a folder: a batch is the complete lines between two sets of positions, so what a checkpoint holds says exactly
what was read. A line counts once its line end is there.

A file is known again by a digest of its first bytes. One that was renamed (rotated) goes on from its position under its
new name, a new file under the old name begins at 0, and so does a file that was cut short.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "growing_lines"
SCHEMA = "value string, file string, at bigint"
# Bytes of a file's start that tell it from others.
HEAD_BYTES = 256
# Bytes of a file that one task reads.
SPLIT_BYTES = 32 << 20
_CHUNK = 1 << 20


@dataclass
class Range(InputPartition):
    """The lines of a file that begin at or behind ``first`` and before ``last``."""

    def __init__(self, path: str, first: int, last: int, end: int):
        self.path, self.first, self.last, self.end = path, first, last, end


class _Folder:
    """A folder in any store that pyarrow reads."""

    def __init__(self, path: str, pattern: str):
        if path.startswith("file:"):
            path = "/" + path[5:].lstrip("/")
        self.fs, self.path = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self.pattern = pattern

    def files(self) -> list[tuple[str, int]]:
        found = self.fs.get_file_info(fs.FileSelector(self.path, allow_not_found=True))
        names = [(f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern)]
        return sorted(n for n in names if not n[0].rsplit("/", 1)[-1].startswith((".", "_")))

    def read(self, path: str, first: int, size: int) -> bytes:
        with self.fs.open_input_file(path) as f:
            f.seek(first)
            return f.read(size)

    def head(self, path: str, size: int) -> str:
        return hashlib.blake2b(self.read(path, 0, size), digest_size=12).hexdigest()

    def last_line_end(self, path: str, first: int, size: int) -> int:
        """The place behind the last line end within ``first`` to ``size``; ``first`` if there is none."""
        end = size
        while end > first:
            start = max(first, end - _CHUNK)
            at = self.read(path, start, end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
        return first


class GrowingLines(DataSource):
    """Options: ``path`` (a folder), ``pattern`` (of file names), ``start`` ("beginning" or "end"), ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


class _Reader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder = _Folder(options["path"], options.get("pattern", "*"))
        self.start = options.get("start", "beginning")
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.known: dict[str, dict] | None = None

    def initialOffset(self) -> dict:
        """Nothing, or all complete lines that are there when the stream starts for the first time."""
        return {"files": json.dumps(self._positions({}) if self.start == "end" else {}, sort_keys=True)}

    def latestOffset(self) -> dict:
        # After a restart the positions come back through partitions() or commit(); files keep what is known of them.
        self.known = self._positions(self.known or {})
        return {"files": json.dumps(self.known, sort_keys=True)}

    def _positions(self, known: dict[str, dict]) -> dict[str, dict]:
        """For each file the place behind its last complete line, and the digest that tells it from others."""
        out: dict[str, dict] = {}
        listed = self.folder.files()
        for path, size in listed:
            before = self._same(path, size, known)
            first = before["at"] if before else 0
            head = min(size, HEAD_BYTES)
            out[path] = {"at": self.folder.last_line_end(path, first, size), "n": head, "head": self.folder.head(path, head)}
        return out

    def _same(self, path: str, size: int, known: dict[str, dict]) -> dict | None:
        """What is known of the file, under this name or the one it had."""
        candidates = [known[path]] if path in known else []
        candidates += [entry for other, entry in known.items() if other != path and entry["n"]]
        for entry in candidates:
            if entry["at"] <= size and entry["n"] <= size and self.folder.head(path, entry["n"]) == entry["head"]:
                return entry
        return None

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        if self.known is None:
            self.known = after
        out = []
        for path, entry in after.items():
            old = self._was(path, entry, before)
            first = old["at"] if old else 0
            while first < entry["at"]:
                last = min(first + self.split, entry["at"])
                out.append(Range(path, first, last, entry["at"]))
                first = last
        return out

    def _was(self, path: str, entry: dict, before: dict[str, dict]) -> dict | None:
        """The earlier position of a file: by name if its start is the same, else by its start."""
        candidates = [before[path]] if path in before else []
        candidates += [old for other, old in before.items() if other != path and old["n"]]
        for old in candidates:
            if old["at"] <= entry["at"] and old["n"] <= entry["n"] and (old["n"], old["head"]) == (entry["n"], entry["head"]):
                return old
            if old["at"] <= entry["at"] and old["n"] < entry["n"] and self.folder.head(path, old["n"]) == old["head"]:
                return old
        return None

    def commit(self, end: dict) -> None:
        pass

    def read(self, partition: Range) -> Iterator[tuple]:
        """Lines are decoded as UTF-8, bytes that aren't any are replaced; a carriage return at the end goes."""
        at, held = partition.first, b""
        if at:  # a line that began in the range before belongs to that
            at -= 1
        skip = bool(partition.first)
        place = at
        with self.folder.fs.open_input_file(partition.path) as f:
            f.seek(at)
            while place < partition.end:
                chunk = f.read(min(_CHUNK, partition.end - place))
                if not chunk:
                    break
                place += len(chunk)
                lines = (held + chunk).split(b"\n")
                held = lines.pop()
                for line in lines:
                    begin, at = at, at + len(line) + 1
                    if skip:
                        skip = False
                        continue
                    if begin >= partition.last:
                        return
                    yield (line.removesuffix(b"\r").decode("utf-8", "replace"), partition.path, begin)
                if at >= partition.last and not skip:
                    return


def follow(spark: SparkSession, path: str, pattern: str = "*", from_end: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A stream of ``value`` (line), ``file`` and ``at`` (its first byte) from the files of a folder, appended lines included.

    ``from_end`` passes over what is there when the stream first starts. All workers must reach the folder. Empty lines
    count, an unfinished last line waits for its end. Two files with the same start are taken for one if one takes the
    other's place.
    """
    spark.dataSource.register(GrowingLines)
    reader = spark.readStream.format(FORMAT).option("path", path).option("pattern", pattern)
    return reader.option("start", "end" if from_end else "beginning").option("splitBytes", split_bytes).load()


def raw_rows(lines: DataFrame, host: str = "") -> DataFrame:
    """Followed lines as raw log rows, stamped with the time they are read at."""
    return lines.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss.SSS").alias("timestamp"),
        F.lit(host).alias("host"),
        F.col("file"),
        F.lit("file").alias("source_type"),
        F.col("value").alias("message"),
    )
