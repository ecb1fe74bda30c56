import numpy as np
import pytest
from pyspark.sql import functions as F

from loglantern.operators import embedding, ivf, knn
from loglantern.session import shared_dir

DIM = 8


@pytest.fixture(scope="module")
def vectors():
    """Vectors of which a third are copies of one."""
    rng = np.random.default_rng(5)
    values = rng.normal(size=(300, DIM)).astype(np.float32)
    values[::3] = values[0]
    return values


@pytest.fixture(scope="module")
def corpus(spark, vectors):
    rows = [(f"id{i:03d}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [("short", [1.0]), ("none", None), ("hole", [None] + [1.0] * (DIM - 1)), ("zero", [0.0] * DIM)]
    return spark.createDataFrame(rows, "log_id string, embedding array<float>").repartition(5)


@pytest.fixture(scope="module")
def queries(spark, vectors):
    rows = [(i, [float(x) for x in vectors[i] * 3]) for i in range(0, 300, 7)]
    return spark.createDataFrame(rows, "qid bigint, embedding array<float>")


def _brute(vectors, k):
    unit = vectors.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    expected = {}
    for q in range(0, 300, 7):
        scores = unit @ unit[q]
        expected[q] = sorted(range(300), key=lambda i: (-round(scores[i], 9), i))[:k]
    return expected


@pytest.mark.parametrize("bounds", [{}, {"max_broadcast": 0, "rows_per_block": 64, "queries_per_block": 10}])
@pytest.mark.parametrize("k", [1, 7, 120])
def test_exact_with_copies(corpus, queries, vectors, bounds, k):
    got = {}
    for r in knn.knn(corpus.filter("log_id != 'zero'"), queries, k, DIM, **bounds).collect():
        got.setdefault(r.qid, []).append((r.rank, r.log_id, round(r.score, 9)))
    expected = _brute(vectors, k)
    assert set(got) == set(expected)
    unit = vectors.astype(np.float64) / np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
    for q, rows in got.items():
        rows.sort()
        assert len(rows) == k
        scores = [round(float(unit[i] @ unit[q]), 6) for i in expected[q]]
        assert [round(s, 6) for _, _, s in rows] == pytest.approx(scores, abs=2e-6)


def test_k_beyond_the_corpus(corpus, queries):
    found = knn.knn(corpus, queries.limit(1), 1000, DIM).collect()
    assert len(found) == 301  # the wrong sizes and the one with a hole are left out


def test_no_queries(corpus, queries):
    assert knn.knn(corpus, queries.filter("false"), 3, DIM).count() == 0


def test_single_query(corpus, vectors):
    good = corpus.filter(F.size("embedding") == DIM).filter("log_id != 'hole'")
    found = knn.semantic_search(good, [float(x) * 5 for x in vectors[1]], 4).collect()
    assert found[0].log_id == "id001" and found[0].score == pytest.approx(1, abs=1e-6)
    assert [r.score for r in found] == sorted((r.score for r in found), reverse=True)
    assert knn.semantic_search(good, [1.0] * DIM, 10_000).count() == 301


def test_ties_go_to_the_smaller_id(corpus, vectors):
    good = corpus.filter("log_id like 'id%'")
    found = knn.semantic_search(good, [float(x) for x in vectors[0]], 5).collect()
    assert [r.log_id for r in found] == ["id000", "id003", "id006", "id009", "id012"]


def test_attach_both_ways(spark, corpus, queries):
    hits = knn.knn(corpus, queries, 2, DIM)
    texts = corpus.select("log_id", F.upper("log_id").alias("text"))
    a = knn.attach(hits, texts).select("qid", "log_id", "text").collect()
    b = knn.attach(hits, texts, max_broadcast=0).select("qid", "log_id", "text").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 2 * queries.count()


def test_attach_keeps_one_row_per_hit(spark, corpus, queries):
    hits = knn.knn(corpus, queries, 2, DIM)
    texts = corpus.select("log_id", F.explode(F.array(F.lit("b"), F.lit("a"), F.lit("b"))).alias("text"))
    for bound in (0, 1000):
        rows = knn.attach(hits, texts, max_broadcast=bound).collect()
        assert len(rows) == hits.count() and {r.text for r in rows} == {"a"}


def test_cells_find_neighbours(spark, corpus, queries, plan):
    good = corpus.filter("log_id like 'id%'")
    cells = ivf.fit_cells(good, DIM)
    index = ivf.with_cell(good, cells, DIM)
    exact = knn.knn(good, queries, 5, DIM)
    found = ivf.search_cells(index, queries, cells, 5, DIM)
    assert knn.recall_at_k(found, exact).first().recall >= 0.8
    # With all cells probed it is exact, in blocks of any size.
    n = len(cells.centres)
    pairs = lambda df: sorted((r.qid, r.log_id, round(r.score, 9), r["rank"]) for r in df.collect())
    assert pairs(ivf.search_cells(index, queries, cells, 5, DIM, probes=n)) == pairs(exact)
    assert pairs(ivf.search_cells(index, queries, cells, 5, DIM, probes=n, rows_per_block=7, queries_per_block=2)) == pairs(exact)
    # The same plan for one query and for many, and no literals taken from the data.
    assert "id1" not in plan(found) and ivf.search_cells(index, queries.limit(1), cells, 5, DIM, probes=n).count() == 5


def test_cells_of_little(spark, corpus, queries):
    none = corpus.filter("false")
    cells = ivf.fit_cells(none, DIM)
    assert ivf.search_cells(ivf.with_cell(none, cells, DIM), queries, cells, 5, DIM).count() == 0
    good = corpus.filter("log_id like 'id%'")
    some = ivf.fit_cells(good, DIM)
    assert ivf.search_cells(ivf.with_cell(good, some, DIM), queries.filter("false"), some, 5, DIM).count() == 0


def test_cells_thin_out_clusters():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    rows = np.repeat(centres, 50, axis=0) + 0.1 * rng.normal(size=(2000, 32))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    assert ivf._probes(rows, centres / np.linalg.norm(centres, axis=1)[:, None], 0.95, rng) == 1


# -- embedding --------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def messages(spark):
    texts = ["disk full on host", "Disk FULL on host", "  disk full on host\n", "user logged in", "", "network down", None]
    rows = [(f"l{i}", f"2024-01-01 00:0{i}:00", "h", "f", t) for i, t in enumerate(texts)]
    rows += [(f"m{i}", "2024-01-02 00:00:00", "h", "f", "copy of one message") for i in range(60)]
    return spark.createDataFrame(rows, "log_id string, timestamp string, host string, file string, message string")


@pytest.fixture(scope="module")
def encoder(messages):
    return embedding.lexical_encoder(embedding.fit_lexical(messages, dim=64))


def test_lexical_vectors(messages, encoder):
    rows = {r.log_id: r.embedding for r in embedding.embed(messages, encoder).collect()}
    assert all(len(v) == 64 for v in rows.values())
    assert rows["l0"] == rows["l1"] == rows["l2"]
    assert np.linalg.norm(rows["l3"]) == pytest.approx(1, abs=1e-5)
    assert np.linalg.norm(rows["l4"]) == 0
    assert np.dot(rows["l0"], rows["l3"]) < 0.5


def _toy_model():
    def run(texts):
        return np.array([[len(t), 1.0, t.count("o")] for t in texts])

    return run


def test_model_encoder_and_once_per_text(spark, messages):
    encoder = embedding.model_encoder(_toy_model, batch=2)
    shared_dir(spark)
    plain = {r.log_id: r.embedding for r in embedding.embed(messages, encoder).collect()}
    once = embedding.embed_once_per_text(messages, encoder, hot_share=0.2).collect()
    assert len(once) == len(plain)
    assert {r.log_id: r.embedding for r in once} == plain
    assert np.linalg.norm(plain["l3"]) == pytest.approx(1, abs=1e-6)
    with pytest.raises(ValueError):
        embedding.embed_once_per_text(messages, encoder, hot_share=0)


def test_pending_and_cap(spark, messages, encoder):
    done = spark.createDataFrame([("l0",), ("l0",), ("zzz",)], "log_id string")
    todo = {r.log_id for r in embedding.pending(messages, done).collect()}
    assert todo == {"l1", "l2", "l3", "l5"} | {f"m{i}" for i in range(60)}
    capped = embedding.backfill_rows(messages, done, encoder, max_rows=2).collect()
    assert [r.log_id for r in capped] == ["l1", "l2"]


def test_store_stats(spark):
    store = spark.createDataFrame([("Source: a | Level: info | Message: x",), ("none",)], "text string").withColumn(
        "updated_at", F.lit("2024-01-01").cast("timestamp")
    )
    row = embedding.store_stats(store, 384).first()
    assert (row.total_embeddings, row.average_embedding_length, row.memory_usage_mb) == (2, 20.0, 0.0)
    spread = {(r.kind, r.key): r["count"] for r in embedding.text_distribution(store).collect()}
    assert spread == {("source", "a"): 1, ("level", "info"): 1}


def test_scores_do_not_depend_on_blocks(corpus, queries, vectors):
    """Copies tie exactly, so that the smaller key comes first, whatever the blocks and batches."""
    good = corpus.filter("log_id like 'id%'")
    rows = lambda **bounds: sorted(map(tuple, knn.knn(good, queries, 5, DIM, **bounds).collect()))
    want = rows()
    assert want[:5] == [(0, f"id{3 * i:03d}", want[0][2], i + 1) for i in range(5)]
    for bounds in ({"rows_per_block": 7, "queries_per_block": 2}, {"rows_per_block": 50, "block_bytes": 8 * DIM * 40}):
        assert rows(max_broadcast=0, **bounds) == want
    assert sorted(map(tuple, knn.knn(good.repartition(23), queries, 5, DIM).collect())) == want


def test_probes_are_not_copies_of_vectors(spark, corpus, queries):
    """A query goes once to each block of cells, not once to each cell it probes."""
    cells = ivf.fit_cells(corpus.filter("log_id like 'id%'"), DIM)
    asked = knn._prepared(queries, "qid", "embedding", DIM, "q")
    n = len(cells.centres)
    sent = ivf._asked(asked, cells, n, DIM, np.repeat([0, 1], [n // 2, n - n // 2]), np.ones(n, int)).collect()
    assert len(sent) == 2 * queries.count() and sum(len(r.cells) for r in sent) == n * queries.count()


def test_best_of_near_copies():
    """Rows that single precision can't tell apart are ordered as in double precision."""
    rng = np.random.default_rng(9)
    centre = rng.normal(size=DIM)
    rows = centre + 1e-9 * rng.normal(size=(3_000, DIM))
    best = knn._Best(rng.normal(size=(40, DIM)), 5, (16, 512))
    best.add(np.arange(3_000), rows)
    scores = best._again(np.repeat(np.arange(40), 3_000), np.tile(np.arange(3_000), 40), knn._Side(rows)).reshape(40, 3_000)
    for q in range(40):
        order = np.lexsort((np.arange(3_000), -scores[q]))[:5]
        assert best.ids[q].tolist() == order.tolist() and best.scores[q].tolist() == scores[q, order].tolist()
