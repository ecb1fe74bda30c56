"""Approximate nearest neighbours by an inverted file: cells, a few of them probed for each query.

Cells come from a bounded sample; every row is then indexed under the cell of its closest centre. A query scores only the
rows of the cells whose centres are closest to it, so the work per query falls with the number of cells. Cells and
queries meet in blocks of bounded size: a block holds the rows of many small cells, a crowded cell is many blocks, and so
are the queries that all probe one block. A query is sent once to each block with cells that it probes, however many.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .knn import QUERIES_PER_BLOCK, ROWS_PER_BLOCK, _arrow_type, _Best, _prepared, _raw_rows, _unit_rows
from .ranking import SALTS, top_per_group

# Rows that the centres are made from: those with the least hash of their key.
SAMPLE_ROWS = 20_000
ITERATIONS = 8
# Greatest number of cells; the centres of that many are sent to every task.
MOST_CELLS = 4_096
# Share of the true neighbours that the probes are chosen to find, among the rows of the sample, and from how many of them.
RECALL = 0.93
TRIED_ROWS = 1_000
TRIED_NEIGHBOURS = 10
# Vectors whose distances to all centres are held at a time.
_PROBED_ROWS = 1_024


@dataclass(frozen=True)
class Cells:
    """Unit vectors, one for each cell, and how many cells a query probes unless told otherwise."""

    centres: np.ndarray
    probes: int = 1

    def nearest(self, rows: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` closest cells of each unit row, best first; equal ones by number."""
        score = rows @ self.centres.T
        return np.argsort(-score, axis=1, kind="stable")[:, :n]


def fit_cells(corpus: DataFrame, dim: int, key: str = "log_id", embedding: str = "embedding", cells: int | None = None, sample_rows: int = SAMPLE_ROWS, recall: float = RECALL, seed: int = 7) -> Cells:
    """Centres of a sample of at most ``sample_rows`` rows, by spherical k-means. As many cells as the square root of the
    rows, unless ``cells`` says otherwise. An empty corpus has one cell.

    The number of probes is the least that finds ``recall`` of the neighbours that rows of the sample have in it: few where
    vectors lie in clusters, more than half of the cells where they lie anywhere.
    """
    rows = _prepared(corpus, key, embedding, dim, "c")
    if cells is None:
        cells = math.isqrt(rows.count())
    sample = rows.orderBy(F.xxhash64("c", F.lit(seed)), "c").limit(sample_rows).toArrow()
    if not sample.num_rows:
        return Cells(np.eye(1, dim))
    _, unit = _unit_rows(sample, "c", dim)
    rng = np.random.default_rng(seed)
    count = max(1, min(cells, MOST_CELLS, len(unit)))
    centres = unit[np.sort(rng.choice(len(unit), count, replace=False))] if len(unit) else np.eye(1, dim)
    for _ in range(ITERATIONS if len(unit) else 0):
        owner = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, unit)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-12)[:, None], centres)
    return Cells(centres, _probes(unit, centres, recall, rng))


def _probes(unit: np.ndarray, centres: np.ndarray, recall: float, rng: np.random.Generator) -> int:
    if len(unit) < 2:
        return 1
    tried = rng.choice(len(unit), min(TRIED_ROWS, len(unit)), replace=False)
    score = unit[tried] @ unit.T
    score[np.arange(len(tried)), tried] = -np.inf
    near = np.argsort(-score, axis=1)[:, : min(TRIED_NEIGHBOURS, len(unit) - 1)]
    owner = np.argmax(unit @ centres.T, axis=1)
    place = np.argsort(np.argsort(-(unit[tried] @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(place[np.arange(len(tried))[:, None], owner[near]].ravel())
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1


def with_cell(corpus: DataFrame, cells: Cells, dim: int, key: str = "log_id", embedding: str = "embedding") -> DataFrame:
    """``c`` (key), ``v`` (vector) and ``cell`` of every row with a vector of that size. Store it partitioned by cell to
    search it again and again."""
    rows = _prepared(corpus, key, embedding, dim, "c")
    schema = T.StructType([rows.schema["c"], rows.schema["v"], T.StructField("cell", T.IntegerType())])
    shared, kind = rows.sparkSession.sparkContext.broadcast(cells), _arrow_type(rows.schema["c"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, whole, found in _probes_of(batches, shared.value, 1, dim):
            arrays = [batch.column("c").cast(kind).take(whole), batch.column("v").take(whole), pa.array(found[:, 0].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["c", "v", "cell"])

    return rows.select("c", "v").mapInArrow(run, schema)


def _probes_of(batches: Iterator[pa.RecordBatch], cells: Cells, n: int, dim: int) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """Slices, the places of their rows without null or NaN in the vector, and the ``n`` closest cells of those."""
    for batch in batches:
        for start in range(0, batch.num_rows, _PROBED_ROWS):
            part = batch.slice(start, _PROBED_ROWS)
            unit = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None] + 1e-12
            whole = np.flatnonzero(np.isfinite(unit).all(axis=1))
            yield part, pa.array(whole), cells.nearest(unit[whole], n)


def _asked(rows: DataFrame, cells: Cells, n: int, dim: int, first: np.ndarray, parts: np.ndarray) -> DataFrame:
    """``q``, ``v``, ``b`` and ``cells``: each query once for each block with cells it probes, and which those are. A cell's
    rows are in ``parts`` blocks from ``first`` on; none for an empty cell."""
    schema = T.StructType([rows.schema["q"], rows.schema["v"], T.StructField("b", T.IntegerType()), T.StructField("cells", T.ArrayType(T.IntegerType()))])
    shared, kind = rows.sparkSession.sparkContext.broadcast((cells, first, parts)), _arrow_type(rows.schema["q"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first, parts = shared.value
        holds: dict[int, list[int]] = {}
        for cell in np.flatnonzero(parts).tolist():
            for b in range(first[cell], first[cell] + parts[cell]):
                holds.setdefault(int(b), []).append(cell)
        for part, whole, found in _probes_of(batches, known, n, dim):
            probed = np.zeros((len(whole), len(known.centres)), bool)
            probed[np.arange(len(whole))[:, None], found] = True
            part = part.take(whole)
            for b, of in holds.items():
                mine = probed[:, of]
                at = np.flatnonzero(mine.any(axis=1))
                if not len(at):
                    continue
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(mine[at].sum(axis=1))]).astype(np.int32)),
                    pa.array(np.asarray(of, np.int32)[np.nonzero(mine[at])[1]]),
                )
                some = part.take(pa.array(at))
                arrays = [some.column("q").cast(kind), some.column("v"), pa.array(np.full(len(at), b, np.int32)), lists]
                yield pa.RecordBatch.from_arrays(arrays, names=["q", "v", "b", "cells"])

    return rows.select("q", "v").mapInArrow(run, schema)


def search_cells(
    index: DataFrame,
    queries: DataFrame,
    cells: Cells,
    k: int,
    dim: int,
    probes: int | None = None,
    corpus_key: str = "log_id",
    query_key: str = "qid",
    embedding: str = "embedding",
    rows_per_block: int = ROWS_PER_BLOCK,
    queries_per_block: int = QUERIES_PER_BLOCK,
) -> DataFrame:
    """The k best rows of the probed cells of each query: (query_key, corpus_key, score, rank). ``index`` is ``with_cell``.

    NOT exact: report its recall against ``knn``. With as many probes as cells it is.
    """
    probes = min(cells.probes if probes is None else probes, len(cells.centres))
    spark, count = index.sparkSession, len(cells.centres)
    # At most one row for each cell. Small cells share a block, crowded ones are several.
    sizes = np.zeros(count, np.int64)
    for row in index.groupBy("cell").count().collect():
        sizes[row["cell"]] = row["count"]
    first, parts, block, filled = np.zeros(count, np.int64), -(-sizes // rows_per_block), 0, 0
    for cell in np.flatnonzero(sizes).tolist():
        if filled and filled + sizes[cell] > rows_per_block:
            block, filled = block + 1, 0
        first[cell] = block
        block, filled = block + int(parts[cell]) - 1, filled + int(sizes[cell] // parts[cell])
    places = spark.createDataFrame([(i, int(first[i]), int(parts[i])) for i in np.flatnonzero(sizes).tolist()], "cell int, first int, parts int")

    asked = _asked(_prepared(queries, query_key, embedding, dim, "q"), cells, probes, dim, first, parts)
    # Queries of each block, and the cells of it that any of them probes.
    wanted = asked.select("b", F.explode(F.concat("cells", F.array(F.lit(-1)))).alias("cell")).groupBy("b", "cell").count()
    wanted = spark.createDataFrame(wanted.collect(), "b int, cell int, n bigint")
    split = wanted.filter("cell = -1").select("b", F.ceil(F.col("n") / queries_per_block).cast("int").alias("ps"))
    probed = wanted.filter("cell >= 0").select("cell").distinct()
    left = index.join(F.broadcast(places.join(probed, "cell")), "cell")
    left = left.withColumn("b", (F.col("first") + F.pmod(F.xxhash64("c"), F.col("parts"))).cast("int"))
    left = left.join(F.broadcast(split), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("ps") - 1)).alias("p"), "cell", "c", "v")
    right = asked.join(F.broadcast(split), "b").withColumn("p", F.pmod(F.xxhash64("q"), F.col("ps")).cast("int")).select("b", "p", "q", "v", "cells")
    kinds = (right.schema["q"].dataType, left.schema["c"].dataType)
    out = T.StructType([T.StructField("q", kinds[0]), T.StructField("c", kinds[1]), T.StructField("score", T.DoubleType())])
    arrow = pa.schema([("q", _arrow_type(kinds[0])), ("c", _arrow_type(kinds[1])), ("score", pa.float64())])

    def score(rows: pa.Table, some: pa.Table) -> pa.Table:
        if not rows.num_rows or not some.num_rows:
            return arrow.empty_table()
        query_ids, matrix = _raw_rows(some, "q", dim)
        best = _Best(matrix, k)
        lists = some["cells"].combine_chunks()
        asks = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        of = lists.flatten().to_numpy()
        order = np.argsort(of, kind="stable")
        asks, of = asks[order], of[order]
        rows = rows.sort_by("cell")
        ids, stored = _raw_rows(rows, "c", dim)
        cell = rows["cell"].to_numpy()
        for one in np.unique(cell):
            lower, upper = np.searchsorted(cell, [one, one + 1])
            which = asks[slice(*np.searchsorted(of, [one, one + 1]))]
            if len(which):
                best.add(ids[lower:upper], stored[lower:upper], which)
        return pa.Table.from_batches([best.rows(query_ids, arrow)])

    keys = ["b", "p"]
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, out)
    best = top_per_group(partial, ["q"], [F.col("score").desc(), F.col("c").asc()], k, rank="rank", salts=SALTS)
    return best.select(F.col("q").alias(query_key), F.col("c").alias(corpus_key), "score", "rank")
