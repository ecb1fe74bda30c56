"""Ranked lexical search by best-first document intervals.

Documents of a batch stand in order of id, and each query term has a posting list over them: the documents that hold it
and the impact (score) it has there. A range-maximum sparse table lies over each list. The sum over the terms of a query of
the greatest impact within an interval of documents bounds every score in it. The interval with the best bound goes
first; it is split at the document of its greatest impact, which is scored, and the rest on both sides get bounds of
their own. What can't enter the best ``top`` any more is dropped. The best intervals of all queries take each step
together, as flat arrays.

Two passes: the first writes the posting lists of query terms and counts documents, the second searches them, when the
counts of the whole table are known. Queries come in blocks of bounded size; each task returns at most ``top`` rows a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row, Window, functions as F, types as T

from loglantern.llm import texts
from loglantern.llm.frames import written

TOP = 10
# Bytes of query texts whose terms are broadcast at a time.
QUERY_BYTES = 4 << 20
# Text bytes whose postings are searched together.
BATCH_BYTES = 16 << 20
# Intervals of a query that take a step together at first; doubled at each step up to the greatest.
FIRST_STEP, LAST_STEP = 2, 64
# Groups that the rows of a query are cut in before they meet.
SALTS = 64

# What parts terms: [\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]. Fixed values.
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = True
_TERM[128:] = True


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the terms, and how many lie before each offset. Bytes tell as much as characters do."""
    solid = _TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def _hashes(terms: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(terms), np.uint8)
    ends = np.cumsum([len(t) for t in terms], dtype=np.int64) if terms else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if terms else ends
    return texts.span_hash(texts.prefix_hash(flat), starts, ends), starts, ends, flat


class Vocabulary:
    """The different terms of a block of queries, found in texts by hash and compared byte by byte."""

    def __init__(self, terms: list[bytes]):
        self.terms = terms
        self.hash, self.start, self.end, self.flat = _hashes(terms)
        self.order = np.argsort(self.hash)
        self.sorted = self.hash[self.order]

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each span's term, -1 where it is none."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.terms) or not len(starts):
            return out
        keys = texts.span_hash(texts.prefix_hash(data), starts, ends)
        at = np.minimum(np.searchsorted(self.sorted, keys), len(self.sorted) - 1)
        hit = np.flatnonzero(self.sorted[at] == keys)
        term = self.order[at[hit]]
        size = ends[hit] - starts[hit]
        alike = size == self.end[term] - self.start[term]
        hit, term, size = hit[alike], term[alike], size[alike]
        if len(hit):
            inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            same = data[np.repeat(starts[hit], size) + inner] == self.flat[np.repeat(self.start[term], size) + inner]
            same = np.logical_and.reduceat(same, np.cumsum(size) - size)
            out[hit[same]] = term[same]
        return out


_POSTINGS = "ids binary, missing binary, sizes binary, terms binary, docs binary, counts binary, n_docs long, n_terms long, seen array<int>, df array<long>"


def _postings(docs: DataFrame, shared: Broadcast[Vocabulary]) -> DataFrame:
    """One row per batch of documents: their ids and sizes, and the (term, document, count) triples of query terms."""

    def block(ids: list[pa.Array], sizes: list, found: list) -> pa.RecordBatch:
        column = pa.concat_arrays(ids)
        missing = column.is_null().to_numpy(zero_copy_only=False)
        size = np.concatenate(sizes)
        base = np.cumsum([0, *[len(s) for s in sizes[:-1]]])
        terms = np.concatenate([f[0] for f in found])
        rows = np.concatenate([f[1] + b for f, b in zip(found, base)])
        counts = np.concatenate([f[2] for f in found])
        number = column.fill_null(-(1 << 63)).to_numpy()
        # In order of id, nulls first; documents without a query term are left out, but counted.
        held = np.zeros(len(size), bool)
        held[rows] = True
        order = np.lexsort((np.arange(len(size)), number, ~missing))
        order = order[held[order]]
        place = np.full(len(size), -1, np.int64)
        place[order] = np.arange(len(order))
        rows = place[rows]
        by = np.lexsort((rows, terms))
        seen, df = np.unique(terms, return_counts=True)
        values = [number[order], missing[order], size[order], terms[by].astype(np.int32), rows[by].astype(np.int32), counts[by]]
        arrays = [pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in values]
        arrays += [pa.array([int((size > 0).sum())], pa.int64()), pa.array([int(size.sum())], pa.int64())]
        arrays += [pa.array([seen.tolist()], pa.list_(pa.int32())), pa.array([df.tolist()], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, names=["ids", "missing", "sizes", "terms", "docs", "counts", "n_docs", "n_terms", "seen", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        ids, sizes, found, held = [], [], [], 0
        for batch in batches:
            for first, last, data, offsets in texts.byte_slices(batch.column(1)):
                data = texts.lowered(data)
                starts, ends, before = _terms(data, offsets)
                term = known.find(data, starts, ends)
                row = np.repeat(np.arange(last - first), np.diff(before))
                hit = term >= 0
                keys, counts = np.unique(term[hit] * (last - first) + row[hit], return_counts=True)
                ids.append(batch.column(0).slice(first, last - first))
                sizes.append(np.diff(before))
                found.append((keys // (last - first), keys % (last - first), counts.astype(np.int64)))
                held += len(data)
                if held > BATCH_BYTES:
                    yield block(ids, sizes, found)
                    ids, sizes, found, held = [], [], [], 0
        if ids:
            yield block(ids, sizes, found)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(run, _POSTINGS)


class _Tables:
    """Posting lists of a batch, one after the other, with a sparse table of the places of greatest impacts over all of them."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        self.n_docs = n_docs
        self.docs, self.impact = docs.astype(np.int64), impact
        self.key = terms.astype(np.int64) * (n_docs + 1) + self.docs
        self.first = np.searchsorted(terms, np.arange(n_terms + 1))
        self.levels = [np.arange(len(impact), dtype=np.int32)]
        longest = int(np.diff(self.first).max()) if n_terms else 0
        while 1 << len(self.levels) <= longest:
            below, half = self.levels[-1], 1 << (len(self.levels) - 1)
            left, right = below[:-half], below[half:]
            self.levels.append(np.where(impact[left] >= impact[right], left, right))
        # All levels in one array, for lookups that differ in level.
        self.base = np.cumsum([0, *[len(x) for x in self.levels[:-1]]])
        self.table = np.concatenate(self.levels)

    def best(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of the greatest impact in each range of places [a, b), none of them empty; the leftmost on ties."""
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        base = self.base[level]
        left, right = self.table[base + a], self.table[base + b - (1 << level)]
        return np.where(self.impact[left] >= self.impact[right], left, right)


class _Best:
    """The best rows of each query so far: scores, ids, and whether the id is null."""

    def __init__(self, queries: int, top: int):
        self.top = top
        self.score = np.zeros((queries, top), np.int64)
        self.id = np.full((queries, top), (1 << 63) - 1, np.int64)
        self.null = np.zeros((queries, top), bool)

    def add(self, query: np.ndarray, score: np.ndarray, id_: np.ndarray, null: np.ndarray) -> None:
        some = np.unique(query)
        owner = np.concatenate([np.repeat(some, self.top), query])
        score = np.concatenate([self.score[some].ravel(), score])
        id_ = np.concatenate([self.id[some].ravel(), id_])
        null = np.concatenate([self.null[some].ravel(), null])
        order = np.lexsort((id_, ~null, -score, owner))
        owner = owner[order]
        starts = np.searchsorted(owner, some)
        kept = order[(starts[:, None] + np.arange(self.top)).ravel()]
        shape = (len(some), self.top)
        self.score[some], self.id[some], self.null[some] = score[kept].reshape(shape), id_[kept].reshape(shape), null[kept].reshape(shape)


def _ragged(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members of runs, and the run of each."""
    run = np.repeat(np.arange(len(size)), size)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size), run


def _search(tables: _Tables, ids: np.ndarray, null: np.ndarray, first: np.ndarray, terms: np.ndarray, best: _Best) -> int:
    """Adds the best documents of a batch; ``terms[first[q]:first[q + 1]]`` are those of query q. Returns the documents scored."""
    queries = len(first) - 1
    # An interval: its query, bound, least document, and its parts: ranges of the posting lists within it.
    part, query = _ragged(first[:-1], np.diff(first))
    a, b = tables.first[terms[part]], tables.first[terms[part] + 1]
    some = b > a
    pool = _Intervals.of(tables, query[some], a[some], b[some], np.arange(queries))
    step, scored = FIRST_STEP, 0
    while len(pool.query):
        worst = best.score[pool.query, -1]
        last_id, last_null = best.id[pool.query, -1], best.null[pool.query, -1]
        # Equal scores go by id, and an interval holds no smaller id than that of its first document.
        later = np.where(null[pool.least], last_null, last_null | (ids[pool.least] >= last_id))
        open_ = np.flatnonzero((pool.bound > worst) | ((pool.bound == worst) & ~later))
        pool = pool.take(open_)
        if not len(pool.query):
            break
        order = np.lexsort((-pool.bound, pool.query))
        place = np.arange(len(order)) - np.searchsorted(pool.query[order], pool.query[order])
        now = np.sort(order[place < step])
        rest = np.ones(len(order), bool)
        rest[now] = False
        step = min(2 * step, LAST_STEP)
        going = pool.take(now)
        a, b, at = going.a, going.b, going.owner()
        top = tables.best(a, b)
        # The document of the interval's greatest impact; the first on ties.
        rank = np.lexsort((tables.docs[top], -tables.impact[top], at))
        doc = tables.docs[top[rank[going.start()]]]
        term = tables.key[a] - tables.docs[a]
        split = np.searchsorted(tables.key, term + doc[at])
        split = np.minimum(np.maximum(split, a), b)
        hit = (split < b) & (tables.docs[np.minimum(split, len(tables.docs) - 1)] == doc[at])
        score = np.zeros(len(doc), np.int64)
        np.add.at(score, at[hit], tables.impact[split[hit]])
        best.add(going.query, score, ids[doc], null[doc])
        scored += len(doc)
        n = len(going.query)
        owner = np.concatenate([at, at + n])
        low, high = np.concatenate([a, split + hit]), np.concatenate([split, b])
        some = np.flatnonzero(high > low)
        some = some[np.argsort(owner[some], kind="stable")]
        halves = _Intervals.of(tables, owner[some], low[some], high[some], np.concatenate([going.query, going.query]))
        pool = pool.take(np.flatnonzero(rest)).joined(halves)
    return scored


class _Intervals:
    """Intervals of documents as flat arrays."""

    def __init__(self, query, bound, least, size, a, b):
        self.query, self.bound, self.least, self.size, self.a, self.b = query, bound, least, size, a, b

    @staticmethod
    def of(tables: _Tables, owner: np.ndarray, a: np.ndarray, b: np.ndarray, query: np.ndarray) -> _Intervals:
        """From ranges in order of their owner; owners without any make no interval."""
        if not len(owner):
            none = np.zeros(0, np.int64)
            return _Intervals(none, none, none, none, none, none)
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        bound = np.add.reduceat(tables.impact[tables.best(a, b)], starts)
        least = np.minimum.reduceat(tables.docs[a], starts)
        return _Intervals(query[owner[starts]], bound, least, np.diff(np.append(starts, len(owner))), a, b)

    def start(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size)), self.size)

    def take(self, rows: np.ndarray) -> _Intervals:
        if len(rows) == len(self.query):
            return self
        members, _ = _ragged(self.start()[rows], self.size[rows])
        return _Intervals(self.query[rows], self.bound[rows], self.least[rows], self.size[rows], self.a[members], self.b[members])

    def joined(self, other: _Intervals) -> _Intervals:
        pairs = zip((self.query, self.bound, self.least, self.size, self.a, self.b), (other.query, other.bound, other.least, other.size, other.a, other.b))
        return _Intervals(*(np.concatenate(x) for x in pairs))


def _searched(postings: DataFrame, first: np.ndarray, terms: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """The best rows of each query within each task: ``_query``, ``doc_id``, ``score``."""
    shared = postings.sparkSession.sparkContext.broadcast((first, terms, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, terms, weight = shared.value
        best = _Best(len(first) - 1, top)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_buffer() for c in ("ids", "missing", "sizes", "terms", "docs", "counts")}
                ids, null, size = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["missing"], bool), np.frombuffer(row["sizes"], np.int64)
                term, doc, count = np.frombuffer(row["terms"], np.int32), np.frombuffer(row["docs"], np.int32), np.frombuffer(row["counts"], np.int64)
                share = 100 - 90 + (90 * size * n_docs) // n_terms
                impact = weight[term] * ((1_000_000_000 * count) // (1000 * count + 8 * share[doc]))
                some = impact > 0
                if some.any():
                    _search(_Tables(term[some], doc[some], impact[some], len(ids), len(weight)), ids, null, first, terms, best)
        query, place = np.nonzero(best.score > 0)
        null = best.null[query, place]
        columns = [pa.array(query.astype(np.int32)), pa.array(best.id[query, place], mask=null), pa.array(best.score[query, place])]
        yield pa.RecordBatch.from_arrays(columns, names=["_query", "doc_id", "score"])

    return postings.select("ids", "missing", "sizes", "terms", "docs", "counts").mapInArrow(run, "_query int, doc_id long, score long")


def _numbered(rows: list[Row]) -> tuple[list, np.ndarray, np.ndarray, list[bytes]]:
    """Queries as numbers of terms: ids, where each query's terms start, the terms, and their bytes."""
    known: dict[bytes, int] = {}
    first, terms = [0], []
    for row in rows:
        terms += [known.setdefault(t.encode(), len(known)) for t in row["_terms"]]
        first.append(len(terms))
    return [row["item_id"] for row in rows], np.array(first), np.array(terms, np.int64), list(known)


def ranked(docs: DataFrame, queries: DataFrame, top: int = TOP, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``top`` rows of ``docs`` with the highest scores above 0 for each query.

    ``docs`` has ``doc_id`` (an integer) and ``text``, ``queries`` have ``item_id`` and ``text``. Terms are maximal matches of
    ``TERM_PATTERN``, with A-Z in lower case. Equal scores go by id, null ids first. Null and empty texts have no terms; a query
    without terms, or whose terms no text holds, has no rows. Repeated rows of ``docs`` are ranked each, repeated queries
    answered each. Empty tables give no rows; other columns aren't read.

    Query terms are broadcast, ``query_bytes`` of query texts at a time; each such block reads ``docs`` once.
    """
    spark = docs.sparkSession
    lower = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = queries.select("item_id", F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM_PATTERN), F.lit(0))).alias("_terms"))
    split = written(split.filter(F.size("_terms") > 0).withColumn("_bytes", F.octet_length(F.array_join("_terms", " ")) + 1), "queries")
    running = Window.partitionBy("_shard").orderBy("_bytes", "item_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = split.agg(F.sum("_bytes")).first()[0] or 0
    shards = max(1, -(-total // query_bytes))
    split = split.withColumn("_shard", F.pmod(F.xxhash64("item_id", "_terms"), F.lit(shards)))
    # Within a shard, a block ends where its bytes exceed the bound: a block is at most that and one query.
    split = split.withColumn("_part", F.floor((F.sum("_bytes").over(running) - F.col("_bytes")) / query_bytes))
    numbered = T.StructType([T.StructField("_q", T.IntegerType()), T.StructField("item_id", queries.schema["item_id"].dataType)])
    out = None
    blocks = split.select("_shard", "_part").distinct().collect() if total else []
    for block in sorted(blocks):
        rows = split.filter((F.col("_shard") == block["_shard"]) & (F.col("_part") == block["_part"])).select("item_id", "_terms").collect()
        names, first, terms, words = _numbered(rows)
        shared = spark.sparkContext.broadcast(Vocabulary(words))
        postings = written(_postings(docs, shared), "postings")
        shared.unpersist()
        size = postings.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
        if not size["l"]:
            continue
        pairs = postings.select(F.explode(F.arrays_zip("seen", "df")).alias("x")).groupBy(F.col("x.seen").alias("t")).agg(F.sum("x.df").alias("df"))
        weight = np.zeros(len(words), np.int64)
        for row in pairs.collect():  # at most one row per term of the block
            weight[row["t"]] = math.floor(1000 * math.log((2 * size["n"] + 2) / (2 * row["df"] + 1)))
        found = _searched(postings, first, terms, weight, size["n"], size["l"], top)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
        salted = Window.partitionBy("_query", "_salt").orderBy(*order)
        whole = Window.partitionBy("_query").orderBy(*order)
        found = found.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        found = found.withColumn("_at", F.row_number().over(salted)).filter(F.col("_at") <= top)
        found = found.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= top)
        keys = spark.createDataFrame(list(enumerate(names)), numbered)
        found = found.join(F.broadcast(keys), found["_query"] == keys["_q"]).select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return split.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return out

