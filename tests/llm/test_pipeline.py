"""The stages of the corpus pipeline on odd rows, and the whole of it against plain readings of its results."""

import base64
import collections
import hashlib
import re

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from loglantern.llm import mixing, quality
from loglantern.llm.frames import table

STAGES = dict(corpus_pipeline.STAGES)
KEEPING = [name for name, _ in corpus_pipeline.STAGES[:-1]]
CLASHING = ("_shard", "_key", "_row", "_order", "_size", "_copies", "_block", "kept", "keep_id", "ids", "decoded", "n_words")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark, sf_dir):
    """Some documents, texts that are null, empty and long, rows that repeat, and columns named like working columns."""
    given = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull()).orderBy("doc_id").limit(15)
    first = given.orderBy("doc_id").limit(1)
    rows = given.unionByName(first).unionByName(first.withColumn("doc_id", F.lit(10**9).cast(given.schema["doc_id"].dataType)))
    for i, text in enumerate((F.lit(None).cast("string"), F.lit(""), F.lit(" \n "), F.repeat("text", 200))):
        number = F.lit(10**9 + 1 + i).cast(given.schema["doc_id"].dataType)
        rows = rows.unionByName(first.withColumns({"text": text, "doc_id": number}))
    rows = rows.withColumn("source", F.when(F.col("doc_id") % 5 != 0, F.col("source")))
    return rows.withColumns({name: F.concat(F.lit(name), F.col("doc_id").cast("string")) for name in CLASHING}).checkpoint()


def _rows(df):
    return collections.Counter(tuple(map(str, r)) for r in df.collect())


@pytest.mark.parametrize("name", KEEPING)
def test_stage_returns_rows_of_its_input(name, spark, odd, sf_dir):
    got, given = STAGES[name](spark, odd, sf_dir), _rows(odd)
    found = _rows(got)
    assert got.columns == odd.columns and found and set(found) <= set(given)
    most = 2 if name == "source_mix" else 1
    assert all(n <= most * given[row] for row, n in found.items())
    nothing = STAGES[name](spark, odd.limit(0), sf_dir)
    assert nothing.columns == odd.columns and nothing.count() == 0


def test_tokens_of_odd_rows(spark, odd, sf_dir):
    got = STAGES["byte_bpe"](spark, odd, sf_dir).collect()
    assert collections.Counter(_digests(odd)) == collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got)
    assert STAGES["byte_bpe"](spark, odd.limit(0), sf_dir).count() == 0


def _digests(docs):
    with open(P.path("byte_bpe_50k.tiktoken")) as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in docs.select("doc_id", "text").collect():
        text = r.text or ""
        ids = plain.encode_ordinary(text)
        yield r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_stages_are_the_named_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "source_mix", "byte_bpe"]


def test_whole_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()]
    expected = {d[0]: d for d in _digests(docs)}
    assert got and all(expected[d[0]] == d for d in got)
    times = collections.Counter(d[0] for d in got)
    assert max(times.values()) <= 2
    # What the rules reject is gone, and no two that stay are alike but for the case of A-Z.
    rejected = {r.doc_id for r in quality.judge(docs, table(spark, sf_dir, "labels")).filter("not kept").collect()}
    assert not rejected & set(times)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    norms = collections.Counter((texts[i] or "").translate(lower) for i in times)
    assert max(norms.values()) == 1
    # The mix takes what the plan of the same rows says.
    kept = docs
    for name in KEEPING[:-1]:
        kept = STAGES[name](spark, kept, sf_dir).checkpoint()
    plan = {r.doc_id: r for r in mixing.mix_plan(kept).collect()}
    assert sum(len(WORD.findall(texts[i] or "")) * n for i, n in times.items()) == sum(r.taken for r in plan.values())
    assert set(times) <= set(plan)
