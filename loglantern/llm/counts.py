"""Token counts: lengths only, from batches balanced by bytes and texts cut at safe boundaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from loglantern.llm.pieces import Remembered, balanced

LIMIT = 1024
# Text bytes that are cut and counted at a time.
BATCH_BYTES = 4 << 20
# New pieces handed to the library at a time, in bytes; its encodings take some hundred times as much memory.
ENCODE_BYTES = 1 << 18

_counters: dict[str, Remembered] = {}


def _counter(path: str) -> Remembered:
    """One for each worker and vocabulary."""
    if path not in _counters:
        lengths: Callable[[list[str]], list[int]]
        if path.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=path)

            def lengths(texts: list[str]) -> list[int]:
                return [len(ids) for ids in processor.encode(texts, num_threads=1)]

        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task on each core
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()

            def lengths(texts: list[str]) -> list[int]:
                return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        def compute(texts: list[str]) -> list[int]:
            out: list[int] = []
            for first, last in balanced([len(t) for t in texts], ENCODE_BYTES):
                out += lengths(texts[first:last])
            return out

        _counters[path] = Remembered(compute, 800_000)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, ``n_bytes`` (UTF-8), ``n_tokens`` as the library counts them, ``over_limit`` (more than ``limit``).

    ``tokenizer`` is the path of a byte-level BPE file (``.json``) that each worker can read. Special strings inside a
    text count as the library's default has it; none are added. Texts are cut at single spaces between other
    characters, where no token of such a vocabulary can cross, and the counts of the pieces are summed. A ``.model``
    file takes the space into account in other ways, so its texts are counted whole. Null and empty texts have 0
    bytes and 0 tokens; repeated rows give repeated results; only ``doc_id`` and ``text`` are read.
    """
    whole = tokenizer.endswith(".model")
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType(
        [source.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            sizes = pc.binary_length(column).to_pylist()
            for first, last in balanced(sizes, BATCH_BYTES):
                part = column.slice(first, last - first).to_pylist()
                counts = counter.compute(part) if whole else [sum(values) for values in counter.values(part)]
                arrays = [ids.slice(first, last - first), pa.array(sizes[first:last], pa.int64()), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_tokens"])

    return source.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
