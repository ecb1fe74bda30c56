"""Exact nearest neighbours over vectors that are first read as small integers.

A vector at unit length is stored as one byte per entry with a scale and with the distance between the vector and what
the bytes stand for. For a query at unit length that distance bounds the error of a score made from the bytes, so the
first pass reads a quarter of the data and keeps every row that may still be among the best; only those rows are read
as stored and scored exactly. The answer is that of ``knn.knn``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import vectors
from ..session import shared_dir
from .knn import BROADCAST_HITS, _arrow_type, _unit_rows, broadcast_bound
from .ranking import SALTS, top_per_group

LEVELS = 127
# Candidates that a task holds before it passes those on that its own best don't exclude.
HELD_ROWS = 200_000
# Key ranges that a scan of the stored vectors is narrowed to, and the most candidates they are made from.
RANGES = 64
RANGE_KEYS = 50_000
# Rows of the stored vectors are found by page statistics, so pages are small.
PAGE_BYTES = 64 << 10
GROUP_BYTES = 16 << 20


def coded(store: DataFrame, dim: int, key: str = "log_id", embedding: str = "embedding") -> DataFrame:
    """``key``, ``code`` (a byte per entry), ``scale``, ``error`` and ``same`` (equal for equal vectors).

    Rows without a whole vector of ``dim`` entries get none, as they are never found. A zero vector has zeros.
    """
    given = store.filter(vectors.is_valid(embedding, dim)).select(
        F.col(key), F.col(embedding).alias("v"), F.sha2(F.to_json(F.array(embedding)), 256).alias("same")
    )
    kind = given.schema[key].dataType
    out = T.StructType(
        [
            T.StructField(key, kind),
            T.StructField("code", T.BinaryType()),
            T.StructField("scale", T.DoubleType()),
            T.StructField("error", T.DoubleType()),
            T.StructField("same", T.BinaryType()),
        ]
    )
    arrow = pa.schema(
        [(key, _arrow_type(kind)), ("code", pa.binary()), ("scale", pa.float64()), ("error", pa.float64()), ("same", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            rows = flat / (np.sqrt(np.einsum("ij,ij->i", flat, flat))[:, None] + vectors.EPSILON)
            whole = np.isfinite(rows).all(axis=1)
            rows = rows[whole]
            scale = np.abs(rows).max(axis=1, initial=0.0) / LEVELS
            codes = np.rint(rows / np.where(scale > 0, scale, 1.0)[:, None]).astype(np.int8)
            off = rows - codes * scale[:, None]
            error = np.sqrt(np.einsum("ij,ij->i", off, off))
            keys = batch.column(key).filter(pa.array(whole))
            same = [bytes.fromhex(s)[:16] for s in batch.column("same").filter(pa.array(whole)).to_pylist()]
            packed = [row.tobytes() for row in codes]
            columns = [keys.cast(arrow.field(0).type), packed, scale, error, same]
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow
            )

    return given.mapInArrow(run, out)


def store_coded(
    store: DataFrame, path: str, dim: int, key: str = "log_id", embedding: str = "embedding", mode: str = "errorifexists"
) -> None:
    """Writes ``path``/exact, the vectors in order of their key, and then ``path``/codes, made from them."""
    exact = store.select(F.col(key), F.col(embedding)).repartitionByRange(key).sortWithinPartitions(key)
    writer = exact.write.mode(mode).option("parquet.page.size", PAGE_BYTES).option("parquet.block.size", GROUP_BYTES)
    writer.parquet(f"{path}/exact")
    coded(store.sparkSession.read.parquet(f"{path}/exact"), dim, key, embedding).write.mode(mode).parquet(f"{path}/codes")


# Of a vector's ``same``: two numbers take far less than a text for each candidate.
_SAME = np.dtype([("a", "<u8"), ("b", "<u8")])


def _first_copies(ids: np.ndarray, same: np.ndarray, k: int, q: np.ndarray | None = None) -> np.ndarray:
    """Places without those that follow k smaller keys of an equal vector (of the same query)."""
    keys = [same["a"], same["b"], *([] if q is None else [q])]
    order = np.lexsort((ids, *keys))
    new = np.ones(len(order), bool)
    new[1:] = np.any([key[order][1:] != key[order][:-1] for key in keys], axis=0)
    at = np.arange(len(order))
    return order[at - np.maximum.accumulate(np.where(new, at, 0)) < k]


class _Bounds:
    """Candidates of every query: rows whose greatest possible score reaches the k-th of the least possible ones."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries.astype(np.float32), k
        # What rounding can add to a product of two vectors of length one, summed in single precision.
        self.slack = 4 * queries.shape[1] * float(np.finfo(np.float32).eps)
        # The k greatest lower bounds of each query; the first of them is its floor.
        self.least = np.full((len(queries), k), -np.inf)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    @property
    def floor(self) -> np.ndarray:
        return self.least.min(axis=1)

    def add(self, ids: np.ndarray, codes: np.ndarray, scale: np.ndarray, error: np.ndarray, same: np.ndarray) -> None:
        if not len(ids):
            return
        first = np.sort(_first_copies(ids, same, self.k))
        ids, codes, scale, error, same = (a[first] for a in (ids, codes, scale, error, same))
        about = (self.queries @ codes.astype(np.float32).T).astype(np.float64) * scale
        wide = error + self.slack
        # Lower bounds raise the floors first, so that few pairs are left to be held.
        low = about - wide
        raised = np.flatnonzero((low > self.floor[:, None]).any(axis=1))
        best = np.concatenate([self.least[raised], low[raised]], axis=1)
        self.least[raised] = np.partition(best, best.shape[1] - self.k, axis=1)[:, best.shape[1] - self.k :]
        q, row = np.nonzero(about + wide >= self.floor[:, None])
        about = about[q, row]
        self.held.append((q, ids[row], about + wide[row], about - wide[row], same[row]))
        self.n += len(q)

    def cut(self) -> None:
        """Lets go what the floor excludes by now, and of equal vectors all but the k smallest keys."""
        if not self.held:
            return
        q, ids, high, low, same = (np.concatenate(parts) for parts in zip(*self.held))
        keep = np.flatnonzero(high >= self.floor[q])
        keep = keep[_first_copies(ids[keep], same[keep], self.k, q[keep])]
        self.held, self.n = [tuple(a[keep] for a in (q, ids, high, low, same))], len(keep)

    def taken(self, query_ids: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
        self.cut()
        empty = tuple(np.empty(0, dtype) for dtype in (np.int64, np.int64, float, float, _SAME))
        q, ids, high, low, same = self.held[0] if self.held else empty
        self.held, self.n = [], 0
        names = [f"{a:016x}{b:016x}" for a, b in same.tolist()]
        columns = (query_ids[q] if len(q) else [], ids if len(q) else [], high, low, names)
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def candidates(
    codes: DataFrame, asked: tuple[np.ndarray, np.ndarray], k: int, dim: int, kinds: tuple[T.DataType, T.DataType], key: str = "log_id"
) -> DataFrame:
    """``q`` and ``c``: for each query (ids and unit vectors) all rows that may be among its k best.

    A task passes on what its own bounds can't exclude; the k-th greatest lower bound over all tasks then decides, with
    equal vectors counted up to k times.
    """
    spark = codes.sparkSession
    shared = spark.sparkContext.broadcast(asked)
    out = T.StructType(
        [
            T.StructField("q", kinds[0]),
            T.StructField("c", kinds[1]),
            T.StructField("high", T.DoubleType()),
            T.StructField("low", T.DoubleType()),
            T.StructField("same", T.StringType()),
        ]
    )
    arrow = pa.schema(
        [("q", _arrow_type(kinds[0])), ("c", _arrow_type(kinds[1])), ("high", pa.float64()), ("low", pa.float64()), ("same", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix = shared.value
        bounds = _Bounds(matrix, k)
        for batch in batches:
            # A share of the batch at a time, so that queries x rows stays small.
            step = max(k, (2 << 20) // max(1, len(matrix)))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                ids = part.column(key).to_numpy(zero_copy_only=False)
                ids = ids.astype(str) if ids.dtype == object else ids
                code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.int8).reshape(-1, dim)
                same = np.frombuffer(b"".join(part.column("same").to_pylist()), _SAME)
                numbers = [part.column(c).to_numpy() for c in ("scale", "error")]
                bounds.add(ids, code, *numbers, same)
                if bounds.n > HELD_ROWS:
                    bounds.cut()
                    if bounds.n > HELD_ROWS // 2:
                        yield bounds.taken(query_ids, arrow)
        yield bounds.taken(query_ids, arrow)

    shared_dir(spark)
    found = codes.select(key, "code", "scale", "error", "same").mapInArrow(run, out).checkpoint()
    lowest = top_per_group(found, ["q"], [F.col("low").desc(), F.col("c").asc()], k, rank="n", salts=SALTS)
    floors = lowest.groupBy(F.col("q").alias("fq")).agg(F.min("low").alias("floor"), F.max("n").alias("n"))
    # With fewer than k rows in all there is nothing to exclude.
    floors = floors.withColumn("floor", F.when(F.col("n") >= k, F.col("floor")).otherwise(F.lit(float("-inf"))))
    open_ = found.join(F.broadcast(floors), F.col("q") == F.col("fq")).filter(F.col("high") >= F.col("floor"))
    return top_per_group(open_.select("q", "c", "same"), ["q", "same"], [F.col("c").asc()], k, rank="n", salts=1).select("q", "c")


def _within(keys: list, key: str) -> Column:
    """A test that scans can push down: at most ``RANGES`` ranges of neighbouring keys."""
    step = max(1, -(-len(keys) // RANGES))
    test = F.lit(False)
    for start in range(0, len(keys), step):
        part = keys[start : start + step]
        test = test | F.col(key).between(F.lit(part[0]), F.lit(part[-1]))
    return test


def search(
    codes: DataFrame,
    exact: DataFrame,
    queries: DataFrame,
    k: int,
    dim: int,
    corpus_key: str = "log_id",
    query_key: str = "qid",
    embedding: str = "embedding",
    query_embedding: str = "embedding",
) -> DataFrame:
    """Exact k nearest stored rows of every query: (query_key, corpus_key, score, rank), as ``knn.knn`` gives them.

    Keys of the store are unique. More queries than may be broadcast take a first pass for each block of them.
    """
    spark = codes.sparkSession
    right = queries.filter(vectors.is_valid(query_embedding, dim)).select(
        F.col(query_key).alias("q"), F.col(query_embedding).alias("v")
    )
    kinds = (right.schema["q"].dataType, codes.schema[corpus_key].dataType)
    near = spark.createDataFrame([], T.StructType([T.StructField("q", kinds[0]), T.StructField("c", kinds[1])]))
    # Half full on average, so that a block by hash stays within the bound.
    blocks = 1 + 2 * right.count() // broadcast_bound(dim)
    for i in range(blocks):
        asked = _unit_rows(right.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).toArrow(), "q", dim)
        if len(asked[0]):
            near = near.unionByName(candidates(codes, asked, k, dim, kinds, corpus_key))
    near = near.checkpoint()

    stored = exact.select(F.col(corpus_key).alias("sc"), F.col(embedding).alias("sv"))
    keys = near.select("c").distinct().limit(RANGE_KEYS + 1).toPandas()["c"].tolist()
    if len(keys) <= RANGE_KEYS:
        stored = exact.filter(_within(sorted(keys), corpus_key)).select(F.col(corpus_key).alias("sc"), F.col(embedding).alias("sv"))
    side = F.broadcast(near) if near.count() <= BROADCAST_HITS else near
    pairs = stored.join(side, F.col("sc") == F.col("c"))
    pairs = pairs.join(right.select(F.col("q").alias("rq"), F.col("v").alias("rv")), F.col("q") == F.col("rq"))
    lengths = (vectors.norm("sv") + F.lit(vectors.EPSILON)) * (vectors.norm("rv") + F.lit(vectors.EPSILON))
    scored = pairs.select("q", "c", (vectors.dot("sv", "rv") / lengths).alias("score"))
    best = top_per_group(scored, ["q"], [F.col("score").desc(), F.col("c").asc()], k, rank="rank", salts=1)
    return best.select(F.col("q").alias(query_key), F.col("c").alias(corpus_key), "score", "rank")


def open_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The two tables that ``store_coded`` wrote: codes, and vectors as stored."""
    return spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/exact")
