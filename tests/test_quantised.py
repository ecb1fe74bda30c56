"""Exact neighbours by a first pass over vectors stored as bytes."""

import tracemalloc

import glob
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglantern.operators import knn, quantised

DIM = 16


@pytest.fixture(scope="module")
def vectors():
    """A third of the vectors are copies of one, some differ from it by less than a byte can tell, some are axes."""
    rng = np.random.default_rng(11)
    values = rng.normal(size=(600, DIM)).astype(np.float32)
    values[::3] = values[0]
    values[1:60:3] = values[0] + rng.normal(scale=1e-5, size=(20, DIM)).astype(np.float32)
    values[2 : 2 + 3 * DIM : 3] = np.eye(DIM, dtype=np.float32) * 1000
    return values


@pytest.fixture(scope="module")
def corpus(spark, vectors):
    rows = [(f"id{i:03d}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [("short", [1.0]), ("none", None), ("hole", [None] + [1.0] * (DIM - 1)), ("zero", [0.0] * DIM), ("nan", [float("nan")] * DIM)]
    return spark.createDataFrame(rows, "log_id string, embedding array<float>").repartition(5)


@pytest.fixture(scope="module")
def store(spark, corpus):
    path = tempfile.mkdtemp(prefix="quantised-") + "/store"
    quantised.store_coded(corpus, path, DIM)
    return path


def _queries(spark, vectors, step=7):
    rows = [(i, [float(x) for x in vectors[i] * 3]) for i in range(0, len(vectors), step)]
    return spark.createDataFrame(rows, "qid bigint, embedding array<float>")


def _rows(df):
    return sorted((r.qid, r["rank"], r.log_id, round(r.score, 9)) for r in df.collect())


def test_error_is_the_distance_to_what_the_code_stands_for(spark, store, vectors):
    codes = {r.log_id: r for r in quantised.open_store(spark, store)[0].collect()}
    assert set(codes) == {f"id{i:03d}" for i in range(len(vectors))} | {"zero"}
    unit = vectors.astype(np.float64) / np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
    for i, v in enumerate(unit):
        r = codes[f"id{i:03d}"]
        off = np.linalg.norm(v - np.frombuffer(bytes(r.code), np.int8) * r.scale)
        assert abs(off - r.error) < 1e-9 and off <= np.abs(v).max() / 127 / 2 * np.sqrt(DIM) + 1e-9
    assert codes["zero"].scale == codes["zero"].error == 0


@pytest.mark.parametrize("k", [1, 5, 250, 1000])
def test_same_as_all_pairs(spark, store, corpus, vectors, k):
    asked = _queries(spark, vectors, 7 if k < 100 else 60)
    got = quantised.search(*quantised.open_store(spark, store), asked, k, DIM)
    exact = knn.knn(corpus, asked, k, DIM)
    if k < 600:
        assert _rows(got) == _rows(exact)
    else:  # more than there are: every row with a vector
        assert {r[:1] + r[2:] for r in _rows(got)} == {r[:1] + r[2:] for r in _rows(exact)}


def test_queries_in_blocks_and_tasks_that_pass_on_early(spark, store, corpus, vectors, monkeypatch):
    asked = _queries(spark, vectors)
    monkeypatch.setattr(quantised, "broadcast_bound", lambda dim: 20)
    monkeypatch.setattr(quantised, "HELD_ROWS", 50)
    monkeypatch.setattr(quantised, "RANGE_KEYS", 3)
    assert _rows(quantised.search(*quantised.open_store(spark, store), asked, 5, DIM)) == _rows(knn.knn(corpus, asked, 5, DIM))


def test_copies_do_not_pile_up(spark, store, vectors):
    codes, _ = quantised.open_store(spark, store)
    unit = vectors[:1].astype(np.float64) / np.linalg.norm(vectors[0].astype(np.float64))
    kinds = (spark.range(1).schema["id"].dataType, codes.schema["log_id"].dataType)
    near = quantised.candidates(codes, (np.array([0]), unit), 3, DIM, kinds)
    # Of 200 copies three, and the rows that differ by less than the bound.
    assert near.count() <= 3 + 20


def test_nothing_asked_or_stored(spark, corpus, vectors):
    path = tempfile.mkdtemp(prefix="quantised-") + "/store"
    quantised.store_coded(corpus.limit(0), path, DIM)
    store = quantised.open_store(spark, path)
    assert quantised.search(*store, _queries(spark, vectors), 3, DIM).count() == 0
    assert quantised.search(*store, _queries(spark, vectors).limit(0), 3, DIM).count() == 0


def test_first_pass_reads_less(spark, sf_dir, plan):
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    dim = len(given.first()["embedding"])
    path = tempfile.mkdtemp(prefix="quantised-") + "/store"
    quantised.store_coded(given, path, dim, "vec_id")
    codes, exact = quantised.open_store(spark, path)

    def column_bytes(folder, names):
        import pyarrow.parquet as pq

        total = 0
        for name in glob.glob(os.path.join(path, folder, "*.parquet")):
            meta = pq.ParquetFile(name).metadata
            for g in range(meta.num_row_groups):
                columns = [meta.row_group(g).column(c) for c in range(meta.num_columns)]
                total += sum(c.total_compressed_size for c in columns if c.path_in_schema.split(".")[0] in names)
        return total

    assert 3 * column_bytes("codes", {"code", "scale", "error"}) <= column_bytes("exact", {"embedding"})
    asked = given.filter(F.col("vec_id") % 100 == 0).withColumnRenamed("vec_id", "qid")
    found = quantised.search(codes, exact, asked, 5, dim, corpus_key="vec_id")
    assert "PushedFilters: [Or(" in plan(found) and "CartesianProduct" not in plan(found)


def test_candidates_take_little_memory():
    """Rows that can't be among the best, and copies beyond the k-th, are never held for each query."""
    rng = np.random.default_rng(2)
    queries, codes = rng.normal(size=(400, 64)), rng.integers(-127, 128, (5_000, 64)).astype(np.int8)
    codes[:2_500] = codes[0]
    queries /= np.linalg.norm(queries, axis=1)[:, None]
    scale = 1 / np.linalg.norm(codes.astype(float), axis=1)
    same = np.zeros(5_000, quantised._SAME)
    same["a"] = np.maximum(np.arange(5_000), 2_499)
    tracemalloc.start()
    bounds = quantised._Bounds(queries, 5)
    bounds.add(np.arange(5_000), codes, scale, np.full(5_000, 1e-3), same)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert bounds.n < 400 * 100 and peak < 150 << 20
    exact = (queries @ codes.T.astype(float)) * scale
    bounds.cut()
    q, ids, *_ = bounds.held[0]
    for i in range(400):
        assert set(np.lexsort((np.arange(5_000), -np.round(exact[i], 12)))[:5].tolist()) <= set(ids[q == i].tolist())
