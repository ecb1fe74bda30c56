"""The records of large JSON arrays, read in byte ranges by many tasks.

Whether a byte range begins inside a text, behind a backslash or how deep in brackets is only known from all that stands
before it. So each range is first read as a function: for each way it may begin, how it ends and by how much the depth
changes. Functions of neighbouring ranges compose, and the composition over the ranges before gives each its beginning.
In a second pass a range then finds the records that begin in it, and reads on to the end of the last one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

RANGE_BYTES = 32 << 20
_CHUNK = 1 << 20
_QUOTE, _BACKSLASH = 0x22, 0x5C
_OPEN, _CLOSE = np.zeros(256, bool), np.zeros(256, bool)
_OPEN[[0x5B, 0x7B]] = True
_CLOSE[[0x5D, 0x7D]] = True


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _names(path: str) -> list[tuple[str, int]]:
    """The file, or the files of the folder, with their sizes."""
    store, inside = _store(path)
    info = store.get_file_info(inside)
    found = store.get_file_info(fs.FileSelector(inside)) if info.type == fs.FileType.Directory else [info]
    files = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    prefix = path[: len(path) - len(inside)] if path.endswith(inside) else ""
    return sorted((prefix + f.path, f.size) for f in files)


def structure(data: np.ndarray, in_text: bool, escaped: bool) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """Change of depth at each byte and whether it is inside a text, and how the bytes end (in a text, behind a backslash)."""
    if not len(data):
        return np.zeros(0, np.int8), np.zeros(0, bool), in_text, escaped
    quote = data == _QUOTE
    at = np.flatnonzero(data == _BACKSLASH)
    ends_escaped = False
    if escaped and data[0] == _QUOTE:
        quote[0] = False
    if len(at):
        # A byte is escaped if an odd number of backslashes stands right before it.
        breaks = np.flatnonzero(np.diff(at) > 1)
        firsts, lasts = at[np.r_[0, breaks + 1]], at[np.r_[breaks, len(at) - 1]]
        odd = ((lasts - firsts + 1 + (escaped & (firsts == 0))) & 1).astype(bool)
        behind = lasts[odd] + 1
        ends_escaped = bool(odd[-1] and lasts[-1] == len(data) - 1)
        quote[behind[behind < len(data)]] = False
    flips = quote.view(np.uint8)
    inside = ((np.bitwise_xor.accumulate(flips) ^ flips) ^ np.uint8(in_text)).astype(bool)
    outside = ~inside & ~quote
    change = (_OPEN[data] & outside).astype(np.int8) - (_CLOSE[data] & outside).astype(np.int8)
    ends_in_text = bool((int(np.count_nonzero(quote)) + in_text) & 1)
    return change, inside, ends_in_text, ends_escaped


def _read(path: str, first: int, last: int, end: int | None = None) -> Iterator[np.ndarray]:
    """The bytes of the range, and if ``end`` is given those behind it, in pieces that grow from small ones."""
    store, inside = _store(path)
    with store.open_input_file(inside) as f:
        f.seek(first)
        more = max(1, _CHUNK >> 6)
        while first < max(last, end or 0):
            if first >= last:
                more = min(2 * more, _CHUNK)
            data = f.read(min(_CHUNK, last - first) if first < last else min(more, end - first))
            if not data:
                return
            first += len(data)
            yield np.frombuffer(data, np.uint8)


def _summary(path: str, first: int, last: int) -> list[tuple[bool, bool, int]]:
    """For each beginning (in a text or not, behind a backslash or not): how the range ends, and the change of depth."""
    ends = [(bool(k & 2), bool(k & 1), 0) for k in range(4)]
    for data in _read(path, first, last):
        # Read once for each way the chunk's first byte may be escaped that matters; a text outside is one inside if it begins in one.
        known = {}
        for escaped in sorted({escaped for _, escaped, _ in ends}):
            if escaped and data[0] not in (_QUOTE, _BACKSLASH) and False in known:
                known[True] = known[False]
                continue
            _, inside, in_text, last_escaped = structure(data, False, escaped)
            bracket = _OPEN[data].astype(np.int8) - _CLOSE[data].astype(np.int8)
            known[escaped] = [(in_text, last_escaped, int(bracket[~inside].sum(dtype=np.int64))), (not in_text, last_escaped, int(bracket[inside].sum(dtype=np.int64)))]
        ends = [(*known[escaped][in_text][:2], depth + known[escaped][in_text][2]) for in_text, escaped, depth in ends]
    return ends


def _level(path: str, size: int) -> int:
    """Depth at which records begin: 1 in an array, 0 in a file of plain objects."""
    for data in _read(path, 0, size):
        solid = np.flatnonzero(~np.isin(data, [0x20, 0x09, 0x0A, 0x0D, 0xEF, 0xBB, 0xBF]))
        if len(solid):
            return int(data[solid[0]] == 0x5B)
    return 1


def records(path: str, first: int, last: int, size: int, in_text: bool, escaped: bool, depth: int, level: int) -> Iterator[str]:
    """The texts of the objects at depth ``level`` that begin in the range."""
    held: list[bytes] = []  # of a record that has begun
    place = first
    for data in _read(path, first, last, size):
        if place >= last and not held:
            return
        change, _, in_text, escaped = structure(data, in_text, escaped)
        after = depth + np.cumsum(change, dtype=np.int64)
        starts = np.flatnonzero((change == 1) & (after == level + 1) & (data == 0x7B))
        starts = starts[place + starts < last]
        stops = np.flatnonzero((change == -1) & (after == level)) + 1
        raw, at = data.tobytes(), 0
        if held:
            if not len(stops):
                held.append(raw)
                place, depth = place + len(raw), int(after[-1])
                continue
            at = int(stops[0])
            yield b"".join([*held, raw[:at]]).decode("utf-8", "replace")
            held = []
        for start in starts[np.searchsorted(starts, at) :].tolist():
            k = int(np.searchsorted(stops, start, side="right"))
            if k < len(stops):
                yield raw[start : stops[k]].decode("utf-8", "replace")
            else:
                held = [raw[start:]]
        place, depth = place + len(raw), int(after[-1]) if len(after) else depth


def read_records(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``value``: the text of each object of the JSON arrays in a file or folder, ``file`` and ``at`` (range).

    Objects of a file without an array are records too. A record that the file ends within is left out, as is all that
    isn't an object; commas aren't checked. All workers must reach the path. Empty files and folders give no rows.
    """
    ranges = []
    for name, size in _names(path):
        ranges += [(name, first, min(first + range_bytes, size), size) for first in range(0, size, range_bytes)]
    if not ranges:
        return spark.createDataFrame([], "value string, file string, at bigint")
    # Small ranges are many a task: a task for each would cost more than its work, and shuffles the square of their number.
    tasks = min(len(ranges), max(4 * spark.sparkContext.defaultParallelism, -(-sum(last - first for _, first, last, _ in ranges) // RANGE_BYTES)))
    dealt = spark.createDataFrame(ranges, "file string, first bigint, last bigint, size bigint").repartition(tasks, "file", "first")
    ends = ", ".join(f"t{k} boolean, e{k} boolean, d{k} bigint" for k in range(4))

    def summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[*r.values(), *[x for end in _summary(r["file"], r["first"], r["last"]) for x in end]] for r in batch.to_pylist()]
            if rows:
                names = ["file", "first", "last", "size", *[f"{c}{k}" for k in range(4) for c in "ted"]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    def composed(frame: pd.DataFrame) -> pd.DataFrame:
        """How each range of a file begins: a few numbers a range."""
        frame, state, out = frame.sort_values("first"), (False, False, 0), []
        level = _level(frame["file"].iloc[0], int(frame["size"].iloc[0]))
        for row in frame.to_dict("records"):
            out.append((row["file"], row["first"], row["last"], row["size"], *state, level))
            k = 2 * state[0] + state[1]
            state = (bool(row[f"t{k}"]), bool(row[f"e{k}"]), state[2] + int(row[f"d{k}"]))
        return pd.DataFrame(out, columns=["file", "first", "last", "size", "in_text", "escaped", "depth", "level"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                some: list[str] = []
                for record in records(r["file"], r["first"], r["last"], r["size"], r["in_text"], r["escaped"], r["depth"], r["level"]):
                    some.append(record)
                    if len(some) == 4096:
                        yield _rows(some, r)
                        some = []
                if some:
                    yield _rows(some, r)

    known = dealt.mapInArrow(summarised, f"file string, first bigint, last bigint, size bigint, {ends}")
    begun = known.groupBy("file").applyInPandas(
        composed, "file string, first bigint, last bigint, size bigint, in_text boolean, escaped boolean, depth bigint, level bigint"
    )
    return begun.repartition(tasks, "file", "first").mapInArrow(read, "value string, file string, at bigint")


def _rows(values: list[str], r: dict) -> pa.RecordBatch:
    arrays = [pa.array(values, pa.string()), pa.array([r["file"]] * len(values), pa.string()), pa.array([r["first"]] * len(values), pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["value", "file", "at"])


def parsed(records_: DataFrame, schema) -> DataFrame:
    """The records' fields; the number of those that don't parse is ``refused`` of ``parsed_or_refused``."""
    return parsed_or_refused(records_, schema).filter(~F.col("refused")).select("r.*")


def parsed_or_refused(records_: DataFrame, schema) -> DataFrame:
    checked = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    record = F.from_json("value", checked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return records_.select(record.alias("r"), "file").withColumn("refused", F.col("r._corrupt_record").isNotNull())
