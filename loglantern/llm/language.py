"""Language by cross-parsing: the language whose sample covers a text with the fewest phrases wins.

A suffix automaton of sample text per language knows every substring of the sample. A text is read through each
automaton: as long as the next character continues a match the phrase grows, else a new phrase begins. The number of
phrases, normalised by length, estimates the cross-entropy.

The sample is the only part that is bounded: at most ``SAMPLE_ROWS`` labelled rows a language, those with the least
hash, and at most ``SAMPLE_CHARS`` characters of each. Prediction reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from loglantern.llm.pieces import balanced

SAMPLE_ROWS = 150
SAMPLE_CHARS = 300
# Characters read side by side: a longer text is read in runs of this length, each beginning a new phrase.
RUN_CHARS = 1024
BATCH_BYTES = 4 << 20
UNKNOWN = "und"


class Automaton:
    """All substrings of a text, as a dense table from (state, character class) to state; 0 is the start, -1 no match."""

    def __init__(self, classes: Sequence[int], width: int):
        limit = 2 * max(len(classes), 1)
        length, link = [0] * limit, [-1] * limit
        edges: list[dict[int, int]] = [{}]
        last = 0
        for c in classes:
            state = len(edges)
            edges.append({})
            length[state] = length[last] + 1
            p = last
            while p >= 0 and c not in edges[p]:
                edges[p][c] = state
                p = link[p]
            if p < 0:
                link[state] = 0
            else:
                q = edges[p][c]
                if length[p] + 1 == length[q]:
                    link[state] = q
                else:
                    copy = len(edges)
                    edges.append(dict(edges[q]))
                    length[copy], link[copy] = length[p] + 1, link[q]
                    while p >= 0 and edges[p].get(c) == q:
                        edges[p][c] = copy
                        p = link[p]
                    link[q] = link[state] = copy
            last = state
        self.table = np.full((len(edges), width), -1, np.int32)
        for state, out in enumerate(edges):
            for c, to in out.items():
                self.table[state, c] = to


class Model:
    """Automata by language over one alphabet: the letters of the samples, and one class for all that parts words."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        letters = sorted({c for parts in samples.values() for part in parts for c in part.lower() if c.isalpha()})
        # Class 0: between words. 1: letters of no sample, which match nowhere.
        self.of_letter = {c: i + 2 for i, c in enumerate(letters)}
        self.width = len(letters) + 2
        self._table: np.ndarray | None = None
        self.automata = [
            Automaton(self.classes([" ".join(samples[language])])[0].tolist(), self.width).table for language in self.languages
        ]

    def _classes(self) -> np.ndarray:
        """Class of each code point; letters count in lower case."""
        if self._table is None:
            table = np.zeros(0x110000, np.uint16)
            for point in range(0x110000):
                c = chr(point)
                if c.isalpha():
                    table[point] = self.of_letter.get(c.lower()[:1], 1)
            self._table = table
        return self._table

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}

    def classes(self, texts: list[str]) -> list[np.ndarray]:
        """Classes of the characters of each text; what parts words is one class 0, however long."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        found = self._classes()[points]
        ends = np.cumsum([len(t) for t in texts])
        keep = np.ones(len(found), bool)
        keep[1:] = (found[1:] != 0) | (found[:-1] != 0)
        keep[np.append(0, ends[:-1])[np.append(0, ends[:-1]) < len(found)]] = True
        kept = np.concatenate([[0], np.cumsum(keep)])
        found = found[keep]
        return [found[kept[a] : kept[b]] for a, b in zip([0, *ends[:-1]], ends)]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases by text and language, the characters read, and whether there is a letter."""
        classes = self.classes(texts)
        sizes = np.array([len(c) for c in classes])
        lettered = np.array([bool((c > 0).any()) for c in classes])
        # Runs, longest first, so that those still open at any step stand at the front.
        runs = [(i, start, min(start + RUN_CHARS, n)) for i, n in enumerate(sizes) for start in range(0, n, RUN_CHARS)]
        runs.sort(key=lambda r: r[1] - r[2])
        owner = np.array([r[0] for r in runs], np.int64)
        lengths = np.array([r[2] - r[1] for r in runs], np.int64)
        steps = np.full((int(lengths.max(initial=0)), len(runs)), 0, np.uint16)
        for k, (i, start, end) in enumerate(runs):
            steps[: end - start, k] = classes[i][start:end]
        counts = np.zeros((len(texts), len(self.languages)), np.int64)
        open_ = np.searchsorted(-lengths, -np.arange(len(steps)), side="left")
        for k, table in enumerate(self.automata):
            flat = table.ravel()
            state, found = np.zeros(len(runs), np.int32), np.ones(len(runs), np.int64)
            for step, n in zip(steps, open_):
                c = step[:n]
                to = flat[state[:n] * self.width + c]
                broken = to < 0
                found[:n] += broken
                again = flat[c]  # from the start; a letter that the sample lacks is a phrase of its own
                state[:n] = np.where(broken, np.maximum(again, 0), to)
            np.add.at(counts[:, k], owner, found)
        return counts, sizes, lettered

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text and a score: 0.5 when two are equally good, near 1 when one is far better."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        counts, sizes, lettered = self.phrases(texts)
        rates = counts / np.maximum(sizes, 1)[:, None]
        best = rates.argmin(axis=1)
        least = rates[np.arange(len(texts)), best]
        if len(self.languages) > 1:
            second = np.partition(rates, 1, axis=1)[:, 1]
            score = second / np.maximum(second + least, 1e-12)
        else:
            score = np.ones(len(texts))
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], np.where(lettered, score, 0.0)


def samples(labelled: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """For each language of ``labelled`` (text, lang) passages of at most ``rows`` rows, ``chars`` characters from each.

    Rows are those with the least hash of their text, equal texts once; the passage begins at a place that the hash
    gives. The driver gets ``rows * chars`` characters a language at most.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    hashed = usable.select("lang", F.xxhash64("text", F.lit("sample")).alias("_hash"), "text")
    # Equal texts merge ahead of the ranks, so copies use up none; the limit by rank is applied in each task.
    order = Window.partitionBy("_lang").orderBy("_least")
    different = hashed.select(F.col("lang").alias("_lang"), F.col("_hash").alias("_least")).distinct()
    least = different.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= rows).drop("_rank")
    room = F.greatest(F.char_length("text") - F.lit(chars), F.lit(0)) + 1
    passage = F.substring("text", (F.pmod(F.col("_hash"), room) + 1).cast("int"), F.lit(chars))
    # Copies of the chosen texts merge as partial groups.
    of_least = hashed.join(F.broadcast(least), (F.col("lang") == F.col("_lang")) & (F.col("_hash") == F.col("_least")))
    chosen = of_least.select("lang", "_hash", passage.alias("_passage")).distinct()
    out: dict[str, list[str]] = {}
    for row in chosen.orderBy("lang", "_hash").collect():
        out.setdefault(row["lang"], []).append(row["_passage"])
    return out


def identify(docs: DataFrame, samples_by_language: dict[str, list[str]], keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` with ``lang_pred`` and ``score`` of each whole text.

    Only the text decides. Null, empty and letterless texts are ``und`` with score 0, as all are without a sample;
    of equally good languages the first by name wins.
    """
    source = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    schema = T.StructType([*(source.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = source.sparkSession.sparkContext.broadcast(Model(samples_by_language))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            column = batch.column("_text")
            for first, last in balanced(pc.binary_length(column).to_pylist(), BATCH_BYTES):
                predicted, score = model.predict(column.slice(first, last - first).to_pylist())
                arrays = [batch.column(c).slice(first, last - first) for c in keep]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(predicted, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def held_out():
    """A fourth of the ids, none of which is learned from. A null id counts as the text of zero length."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify_documents(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``held_out``, ``lang_pred``, ``score``; learns from rows not held out."""
    learned = samples(docs.filter(~held_out()).select("text", "lang"))
    return identify(docs, learned).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
