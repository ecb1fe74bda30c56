"""Exact duplicates by MSD radix partitioning: groups are split by successive bytes until they are single or ended.

Three steps, none of which compares digests:

1. Inside each task, texts are split by successive bytes of growing width. Equal texts become one entry, so a text
   with any number of copies leaves a task once for each batch.
2. Across tasks, a radix tree grows over the first bytes: a group of entries that holds more bytes than a task should
   take is split by the bytes that follow, as deep as it needs. Its leaves say to which partition an entry goes.
3. In its partition an entry meets all others of its leaf, and step 1 is repeated there.

Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal texts the row with the
largest ``doc_id`` stays, a null id only if there is no other; of rows that are equal in that too, exactly one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from loglantern.llm.frames import trimmed, written
from loglantern.llm.pieces import balanced

# Bytes of text that a partition should take.
LEAF_BYTES = 16 << 20
# Bytes of the first digit; each following one is twice as wide.
FIRST_DIGIT = 16
# Text bytes that are split together in a task.
BATCH_BYTES = 32 << 20


def split_equal(texts: list[bytes]) -> list[list[int]]:
    """Groups of equal texts: each group is split by its next bytes until it is single or ended.

    Lengths are parted first, so that all texts of a group end together.
    """
    done: list[list[int]] = []
    by_length: dict[int, list[int]] = {}
    for i, text in enumerate(texts):
        by_length.setdefault(len(text), []).append(i)
    stack = [(members, 0, FIRST_DIGIT) for members in by_length.values()]
    while stack:
        members, at, width = stack.pop()
        if len(members) == 1 or at >= len(texts[members[0]]):
            done.append(members)
            continue
        parts: dict[bytes, list[int]] = {}
        for i in members:
            parts.setdefault(texts[i][at : at + width], []).append(i)
        stack += [(part, at + width, min(2 * width, 1 << 16)) for part in parts.values()]
    return done


def _normal(column: pa.Array) -> list[bytes]:
    return pc.ascii_lower(pc.fill_null(column, "")).cast(pa.large_binary()).to_pylist()


def _rank(value: int | None) -> tuple[bool, int]:
    return value is not None, value or 0


def _entries(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """One entry for the equal texts of a task's batch: its ids, and all columns of the row that would stay.

    Columns are renamed by position; returns the names that the text and the id have then.
    """
    names = docs.columns
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    text, key = f"_c{names.index('text')}", f"_c{names.index('doc_id')}"
    extra = [
        T.StructField("_ids", T.ArrayType(plain.schema[key].dataType)),
        T.StructField("_best", T.IntegerType()),
        T.StructField("_length", T.LongType()),
        T.StructField("_head", T.BinaryType()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column(text)), 0).to_pylist()
            for first, last in balanced(sizes, BATCH_BYTES):
                batch = whole.slice(first, last - first)
                texts, ids = _normal(batch.column(text)), batch.column(key).to_pylist()
                groups = split_equal(texts)
                best = [max(range(len(g)), key=lambda j: _rank(ids[g[j]])) for g in groups]
                offsets = np.zeros(len(groups) + 1, np.int32)
                np.cumsum([len(g) for g in groups], out=offsets[1:])
                members = pa.array([i for g in groups for i in g], pa.int64())
                stay = [g[j] for g, j in zip(groups, best)]
                rows = batch.take(pa.array(stay, pa.int64()))
                arrays = [
                    pa.ListArray.from_arrays(offsets, batch.column(key).take(members)),
                    pa.array(best, pa.int32()),
                    pa.array([len(texts[i]) for i in stay], pa.int64()),
                    pa.array([texts[i][:FIRST_DIGIT] for i in stay], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([*rows.columns, *arrays], names=[*rows.schema.names, *(f.name for f in extra)])

    return plain.mapInArrow(trimmed(run), T.StructType([*plain.schema.fields, *extra])), text, key


def _node(text: str, depth: int) -> Column:
    """The group that texts of equal length and equal first ``depth`` bytes share: where to go, not what is equal."""
    if depth <= FIRST_DIGIT:
        return F.xxhash64("_length", "_head")
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.xxhash64("_length", F.substring(lower.cast("binary"), 1, depth))


def _with_leaf(entries: DataFrame, text: str, leaf_bytes: int) -> DataFrame:
    """Entries with ``_leaf``, the deepest group of the radix tree that they belong to.

    Only groups of different texts grow: a level looks at the entries of groups that were too large one level up, and
    a group that has ended is never split. Large groups are joined as a table.
    """
    placed, depth = entries.withColumn("_leaf", _node(text, FIRST_DIGIT)), FIRST_DIGIT
    while True:
        sizes = placed.filter(F.col("_length") > depth).groupBy("_leaf").agg(F.sum("_length").alias("_sum"), F.count("*").alias("_n"))
        large = written(sizes.filter((F.col("_sum") > leaf_bytes) & (F.col("_n") > 1)).select(F.col("_leaf").alias("_large")), "radix")
        if large.isEmpty():
            return placed
        depth *= 3
        placed = placed.join(large, F.col("_leaf") == F.col("_large"), "left")
        deeper = F.when(F.col("_large").isNotNull(), _node(text, depth)).otherwise(F.col("_leaf"))
        placed = placed.withColumn("_leaf", deeper).drop("_large")


def _grouped(docs: DataFrame, leaf_bytes: int) -> tuple[DataFrame, DataFrame, str]:
    """Entries by number, and for each number the id that stays, the size of the group, whether it is the one that
    holds the row that stays, and the digest of the normalised text."""
    found, text, key = _entries(docs)
    entries = written(found.withColumn("_entry", F.monotonically_increasing_id()), "entries")
    total = entries.agg(F.sum("_length")).first()[0] or 0
    slim = entries.select("_entry", "_length", "_head", text, F.col(key).alias("_id"), F.size("_ids").cast("long").alias("_n"))
    placed = _with_leaf(slim, text, leaf_bytes).select("_entry", "_id", "_n", text, "_leaf")
    dealt = placed.repartition(max(1, math.ceil(total / leaf_bytes)), "_leaf")
    schema = T.StructType(
        [
            T.StructField("_entry", T.LongType()),
            T.StructField("_keep", slim.schema["_id"].dataType),
            T.StructField("_size", T.LongType()),
            T.StructField("_stays", T.BooleanType()),
            T.StructField("_sha256", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held) if held else None
        if table is None or not table.num_rows:
            return
        texts = [t for chunk in table.column(text).chunks for t in _normal(chunk)]
        entry, ids, counts = (table.column(c).to_pylist() for c in ("_entry", "_id", "_n"))
        out: list[tuple] = []
        for group in split_equal(texts):
            # Ties go to the first entry by number, so that reruns agree.
            best = min(group, key=lambda i: (not _rank(ids[i])[0], -_rank(ids[i])[1], entry[i]))
            size, digest = sum(counts[i] for i in group), hashlib.sha256(texts[group[0]]).hexdigest()
            out += [(entry[i], ids[best], size, i == best, digest) for i in group]
        columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), table.column("_id").type, pa.int64(), pa.bool_(), pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return entries, dealt.mapInArrow(trimmed(run), schema), key


def exact_groups(docs: DataFrame, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``keep_id`` is the id of the row that stays, ``text_sha256`` the digest of the normalised text. Empty table: no rows.
    """
    entries, groups, _ = _grouped(docs.select("doc_id", "text"), leaf_bytes)
    rows = entries.select(F.col("_entry").alias("_of"), "_best", F.posexplode("_ids").alias("_at", "doc_id"))
    return rows.join(groups, F.col("_of") == F.col("_entry")).select(
        "doc_id",
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_stays") & (F.col("_at") == F.col("_best"))).alias("kept"),
        F.col("_sha256").alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    entries, groups, _ = _grouped(docs, leaf_bytes)
    stay = groups.filter("_stays").select(F.col("_entry").alias("_of"))
    plain = [f"_c{i}" for i in range(len(docs.columns))]
    return entries.join(stay, F.col("_of") == F.col("_entry"), "left_semi").select(*plain).toDF(*docs.columns)
