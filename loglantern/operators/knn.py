"""Nearest neighbours by inner product over unit vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import vectors
from ..session import shared_dir
from .ranking import SALTS, keep_first, top_per_group

# Greatest size of the query block sent to every executor, and of a hit table joined by broadcast.
BROADCAST_BYTES = 32 << 20
BROADCAST_HITS = 500_000
# Blocks of the joins for larger query sets, as doubles; one of each side fits a Python worker together.
BLOCK_BYTES = 32 << 20
QUERIES_PER_BLOCK = 16_384
ROWS_PER_BLOCK = 65_536
# Greatest tile that is scored at a time: queries and corpus rows. Pairs whose scores are computed again at a time.
_TILE = (256, 4_096)
_PAIRS = 1 << 18


# -- one query --------------------------------------------------------------------------------

def score_against(vector: Sequence[float], embedding: Column | str = "embedding", stored_unit: bool = False) -> Column:
    """Cosine of a stored vector and one query vector.

    ``stored_unit`` says that the stored vectors have unit length, as the encoders here write them;
    their length is then not computed again.
    """
    values = np.asarray(list(vector), dtype=np.float64)
    unit = values / (np.linalg.norm(values) + vectors.EPSILON)
    product = vectors.dot(embedding, vectors.literal(unit.tolist()))
    return product if stored_unit else product / (vectors.norm(embedding) + F.lit(vectors.EPSILON))


def semantic_search(
    store: DataFrame,
    vector: Sequence[float],
    k: int = 10,
    embedding: str = "embedding",
    tie: Sequence[str] = ("log_id",),
    stored_unit: bool = False,
) -> DataFrame:
    """The k stored rows closest to one query vector.

    Inside the JVM and planned as a top-n: every task keeps k rows. k above the table size simply
    returns the whole table.
    """
    scored = store.withColumn("score", score_against(vector, embedding, stored_unit))
    return scored.orderBy(F.col("score").desc(), *[F.col(c) for c in tie]).limit(k)


# -- many queries -----------------------------------------------------------------------------

def _raw_rows(batch: pa.RecordBatch | pa.Table, key: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of a batch; rows whose vector holds a null or NaN are left out."""
    if isinstance(batch, pa.Table):
        batch = batch.combine_chunks()
        keys, lists = (batch[name].combine_chunks() for name in (key, "v"))
    else:
        keys, lists = batch.column(key), batch.column("v")
    ids = keys.to_numpy(zero_copy_only=False)
    ids = ids.astype(str) if ids.dtype == object else ids
    rows = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    whole = np.isfinite(rows).all(axis=1)
    return (ids, rows) if whole.all() else (ids[whole], rows[whole])


def _unit_rows(batch: pa.RecordBatch | pa.Table, key: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with vectors at unit length."""
    ids, rows = _raw_rows(batch, key, dim)
    rows /= np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None] + vectors.EPSILON
    return ids, rows


def _in_order(rows: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Products of row pairs, given by column, summed in the order of the entries: the same pair gives the same sum in any
    block, and the one that SQL engines give, which a matrix product doesn't."""
    total = np.zeros(rows.shape[1])
    for x, y in zip(rows, other):
        total += x * y
    return total


def _first_copies(ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows without those that follow k equal vectors of smaller keys."""
    whole = np.ascontiguousarray(rows + 0.0).view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
    _, same = np.unique(whole, return_inverse=True)
    order = np.lexsort((ids, same))
    new = np.r_[True, same[order][1:] != same[order][:-1]]
    at = np.arange(len(order))
    return np.sort(order[at - np.maximum.accumulate(np.where(new, at, 0)) < k])


class _Side:
    """Vectors as stored, by column, with their squared lengths, and at unit length."""

    def __init__(self, rows: np.ndarray):
        self.columns = np.ascontiguousarray(rows.T)
        self.squares = _in_order(self.columns, self.columns)
        length = np.sqrt(self.squares)
        self.unit = (rows / np.where(length > 0, length, 1.0)[:, None]).astype(np.float32)

    def __len__(self) -> int:
        return len(self.unit)


class _Best:
    """The k best (score, id) pairs of every query; greater score first, then smaller id.

    A product in single precision finds the pairs whose score may be among the best. Those are scored again, as SQL does.
    """

    def __init__(self, queries: np.ndarray, k: int, tile: tuple[int, int] = _TILE):
        self.queries, self.k, self.tile = _Side(queries), k, tile
        self.scores = np.full((len(queries), k), -np.inf)
        self.ids: np.ndarray | None = None
        self.slack = [4 * queries.shape[1] * float(np.finfo(kind).eps) for kind in (np.float32, np.float64)]

    def add(self, ids: np.ndarray, rows: np.ndarray, which: np.ndarray | None = None) -> None:
        """More rows, for all queries or for those at the places ``which``."""
        if not len(ids) or not len(self.queries):
            return
        kept = _first_copies(ids, rows, self.k)
        ids, rows = (ids, rows) if len(kept) == len(ids) else (ids[kept], rows[kept])
        kind = ids.dtype if self.ids is None else np.result_type(ids.dtype, self.ids.dtype)
        if self.ids is None:
            self.ids = np.zeros(self.scores.shape, kind)
        elif kind != self.ids.dtype:
            self.ids = self.ids.astype(kind)
        which = np.arange(len(self.queries)) if which is None else which
        queries, width = self.tile
        for start in range(0, len(ids), width):
            some = _Side(rows[start : start + width])
            for first in range(0, len(which), queries):
                self._score(which[first : first + queries], ids[start : start + width], some)

    def _score(self, at: np.ndarray, ids: np.ndarray, rows: _Side) -> None:
        floor = self.scores[at, -1]
        block = self.queries.unit[at] @ rows.unit.T
        reached = self._reached(block, floor, self.slack[0])
        q, r = np.nonzero(reached)
        if len(q) > 8 * self.k * len(at):  # many nearly equal ones, which double precision tells apart
            block = self._exact_unit(self.queries, at) @ self._exact_unit(rows, slice(None)).T
            q, r = np.nonzero(self._reached(block, floor, self.slack[1]))
        if len(q):
            self._merge(at, q, self._again(at[q], r, rows), ids[r])

    @staticmethod
    def _exact_unit(side: _Side, at) -> np.ndarray:
        length = np.sqrt(side.squares[at])
        return (side.columns[:, at] / np.where(length > 0, length, 1.0)).T

    def _reached(self, block: np.ndarray, floor: np.ndarray, slack: float) -> np.ndarray:
        """Pairs that may be among the k best. Equal scores are: the id decides between them."""
        if block.shape[1] > self.k and (new := np.flatnonzero(np.isneginf(floor))).size:
            floor = floor.copy()
            floor[new] = np.partition(block[new], block.shape[1] - self.k, axis=1)[:, block.shape[1] - self.k] - slack
        return block >= (floor - slack)[:, None].astype(block.dtype)

    def _again(self, q: np.ndarray, r: np.ndarray, rows: _Side) -> np.ndarray:
        out = np.empty(len(q))
        for start in range(0, len(q), _PAIRS):
            i, j = q[start : start + _PAIRS], r[start : start + _PAIRS]
            length = np.sqrt(self.queries.squares[i] * rows.squares[j])
            product = np.zeros(len(i))
            for x, y in zip(self.queries.columns, rows.columns):
                product += x[i] * y[j]
            out[start : start + _PAIRS] = np.clip(product / np.where(length > 0, length, np.inf), -1.0, 1.0)
        return out

    def _merge(self, at: np.ndarray, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        better = scores >= self.scores[at[q], -1]
        q, scores, ids = q[better], scores[better], ids[better]
        touched = np.unique(q)
        old_q, old_place = np.nonzero(~np.isneginf(self.scores[at[touched]]))
        held = at[touched[old_q]]
        q = np.concatenate([touched[old_q], q])
        scores = np.concatenate([self.scores[held, old_place], scores])
        ids = np.concatenate([self.ids[held, old_place], ids])
        order = np.lexsort((ids, -scores, q))
        q, scores, ids = q[order], scores[order], ids[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.k
        self.scores[at[q[kept]], place[kept]] = scores[kept]
        self.ids[at[q[kept]], place[kept]] = ids[kept]

    def rows(self, query_ids: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
        q, place = np.nonzero(~np.isneginf(self.scores))
        columns = (query_ids[q], self.ids[q, place], self.scores[q, place]) if len(q) else ([], [], [])
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
        )


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.StringType):
        return pa.string()
    return pa.int32() if isinstance(kind, T.IntegerType) else pa.int64()


def _prepared(df: DataFrame, key: str, embedding: str, dim: int, name: str) -> DataFrame:
    """Key and vector of the rows that hold a vector of the right size, and no other column. The
    vectors leave the JVM as stored; bringing them to unit length is cheaper on a whole batch."""
    return df.filter(F.size(embedding) == dim).select(F.col(key).alias(name), F.col(embedding).alias("v"))


def broadcast_bound(dim: int) -> int:
    """How many query vectors of that size, as doubles, may be broadcast."""
    return BROADCAST_BYTES // (8 * dim)


def knn(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    dim: int,
    corpus_key: str = "log_id",
    query_key: str = "qid",
    embedding: str = "embedding",
    query_embedding: str = "embedding",
    max_broadcast: int | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
    queries_per_block: int = QUERIES_PER_BLOCK,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Exact k nearest corpus rows of every query: (query_key, corpus_key, score, rank).

    A query set within the bound is sent to all tasks; each scores its Arrow batches as matrix
    products and keeps k rows per query, so the shuffle carries queries * tasks * k rows and never
    the product of both sides. A larger set goes through a block join in which both sides are
    spread by hash, and every block pair again yields k rows per query. As many blocks as ``block_bytes`` hold of each side
    meet in one group, so that few copies of a side are shuffled however small the blocks are.
    """
    left = _prepared(corpus, corpus_key, embedding, dim, "c")
    right = _prepared(queries, query_key, query_embedding, dim, "q")
    kinds = (right.schema["q"].dataType, left.schema["c"].dataType)
    out = T.StructType(
        [T.StructField("q", kinds[0]), T.StructField("c", kinds[1]), T.StructField("score", T.DoubleType())]
    )
    arrow = pa.schema([("q", _arrow_type(kinds[0])), ("c", _arrow_type(kinds[1])), ("score", pa.float64())])

    bound = broadcast_bound(dim) if max_broadcast is None else max_broadcast
    block = right.limit(bound + 1).toArrow()
    if block.num_rows <= bound:
        partial = _broadcast_top(left, block, k, dim, out, arrow)
    else:
        partial = _block_top(left, right, k, dim, out, arrow, rows_per_block, queries_per_block, block_bytes)
    best = top_per_group(partial, ["q"], [F.col("score").desc(), F.col("c").asc()], k, rank="rank", salts=SALTS)
    return best.select(F.col("q").alias(query_key), F.col("c").alias(corpus_key), "score", "rank")


def _broadcast_top(
    corpus: DataFrame, block: pa.Table, k: int, dim: int, out: T.StructType, arrow: pa.Schema
) -> DataFrame:
    if block.num_rows == 0:
        return corpus.sparkSession.createDataFrame([], out)
    shared = corpus.sparkSession.sparkContext.broadcast(_raw_rows(block, "q", dim))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix = shared.value
        best = _Best(matrix, k)
        for batch in batches:
            if batch.num_rows:
                best.add(*_raw_rows(batch, "c", dim))
        yield best.rows(query_ids, arrow)

    # Every task passes on k rows per query, so the tasks are kept to a few per core: neighbouring
    # splits are read by one task, without a shuffle.
    spark = corpus.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return corpus.coalesce(tasks).mapInArrow(score, out)


def _block_top(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    dim: int,
    out: T.StructType,
    arrow: pa.Schema,
    rows_per_block: int,
    queries_per_block: int,
    block_bytes: int,
) -> DataFrame:
    """Every pair of corpus blocks and query blocks is one group of bounded size. Keys are unique, so the
    hash spreads both sides evenly whatever the data; the block counts follow the measured sizes."""
    held, tasks = max(1, block_bytes // (8 * dim)), corpus.sparkSession.sparkContext.defaultParallelism
    sides = math.ceil(math.sqrt(2 * tasks))
    # No fewer than give every core a group, if there are so many blocks.
    corpus_blocks, query_blocks = (
        max(1, math.ceil(n / held), min(math.ceil(n / block), sides)) for n, block in ((corpus.count(), rows_per_block), (queries.count(), queries_per_block))
    )
    tile = (min(queries_per_block, _TILE[0]), min(rows_per_block, _TILE[1]))
    left = corpus.withColumn("cb", F.pmod(F.xxhash64("c"), F.lit(corpus_blocks))).withColumn(
        "qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(query_blocks - 1).cast("bigint")))
    )
    right = queries.withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(query_blocks))).withColumn(
        "cb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(corpus_blocks - 1).cast("bigint")))
    )

    def score(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        if not rows.num_rows or not wanted.num_rows:
            return arrow.empty_table()
        query_ids, matrix = _raw_rows(wanted, "q", dim)
        best = _Best(matrix, k, tile)
        best.add(*_raw_rows(rows, "c", dim))
        return pa.Table.from_batches([best.rows(query_ids, arrow)])

    return left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInArrow(score, out)


def attach(hits: DataFrame, texts: DataFrame, key: str = "log_id", max_broadcast: int = BROADCAST_HITS) -> DataFrame:
    """Looks the hit rows up in the text table by key.

    The hits, k per query, are written once and counted; a number within the bound is broadcast,
    so that the text table is scanned where it lies and not shuffled. Beyond it both sides join by
    key. A key that the text table has more than once gives each of its hits once, with the first
    of its rows by the other columns.
    """
    shared_dir(hits.sparkSession)
    kept = hits.checkpoint()
    side = F.broadcast(kept) if kept.count() <= max_broadcast else kept
    joined = texts.join(side, key)
    order = [F.col(c).asc() for c in joined.columns if c not in hits.columns]
    return keep_first(joined, hits.columns, order or [F.lit(0)])


# -- recall of approximate searches (see ``ivf``) ---------------------------------------------

def recall_at_k(found: DataFrame, exact: DataFrame, query_key: str = "qid", corpus_key: str = "log_id") -> DataFrame:
    """Share of the exact neighbours that were found."""
    pairs = [query_key, corpus_key]
    marked = exact.select(*pairs).join(found.select(*pairs, F.lit(1).alias("hit")), pairs, "left")
    return marked.agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))
