"""Quality rules: exact rule statistics, isolation forests over them, thresholds from labelled rows.

Statistics of every whole text come from numpy over Arrow slices. One forest sees each statistic alone and one sees
all; each has its own threshold, so that harmless spread in one statistic doesn't hide what is odd in another.
All labelled rows take part: one half is dealt among the trees, so that each of its rows is in at least one, and the other
half sets the thresholds by counts of its scores. Only counts and finished trees, whose sizes are bounded, reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from loglantern.llm import texts
from loglantern.llm.frames import trimmed, written

TREES = 100
# Rows of a tree at least, as long as there are so many: few rows are each in several trees. Its depth follows from that.
TREE_ROWS = 256
# Scores are rounded to so many decimals, so that the counts of the scores tell thresholds exactly.
DECIMALS = 4
# Share of the good labelled rows that each threshold may reject.
GOOD_LOST = 0.0005
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_alpha", "n_punct", "n_digits", "n_lines")
_KEY = "_row_key"
# Numbers without a common divisor with ``TREES``: steps from one tree of a row to its next.
_STEPS = [i for i in range(1, TREES) if math.gcd(i, TREES) == 1]
_MULTIPLIERS = texts.mix(np.arange(1, WINDOW + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _table(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in characters]] = True
    return out


_SYMBOL = _table("#*$%&|<>")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_ALPHA = _UPPER | _table("abcdefghijklmnopqrstuvwxyz")
_ALPHA[0xC3:0xF5] = True  # first bytes of characters beyond ASCII, nearly all of them letters
_PUNCT = _table("!?.,;:'\"()[]{}-_/\\@^~`+=")
_DIGIT = _table("0123456789")


def _repeated_words(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Per row: the words in windows of ``WINDOW`` words that its text holds twice or more."""
    n = len(starts)
    if n < 2 * WINDOW // 2 + 1:
        return np.zeros(len(offsets) - 1, np.int64)
    words = texts.span_hash(texts.prefix_hash(data), starts, ends)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    m = n - WINDOW + 1
    keys = row[:m].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    for j in range(WINDOW):
        keys = keys + texts.mix(words[j : j + m] * _MULTIPLIERS[j])
    inside = row[:m] == row[WINDOW - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(len(offsets) - 1, np.int64)
    keys = texts.mix(keys[at])
    order = np.argsort(keys)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at[twice], 1)
    np.add.at(steps, at[twice] + WINDOW, -1)
    return texts.per_row(texts.running(np.cumsum(steps[:-1]) > 0), before)


def _repeated_lines(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: lines with a word, and those of them that equal an earlier line."""
    rows = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    starts.sort(kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    row = np.sort(np.concatenate([np.arange(rows), np.searchsorted(offsets, breaks, side="right") - 1]), kind="stable")
    worded = solid[ends] > solid[starts]
    starts, ends, row = starts[worded], ends[worded], row[worded]
    lines = np.bincount(row, minlength=rows)
    if not len(starts):
        return lines, np.zeros(rows, np.int64)
    keys = texts.mix(texts.span_hash(texts.prefix_hash(data), starts, ends) + row.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    order = np.argsort(keys, kind="stable")
    again = order[1:][keys[order][1:] == keys[order][:-1]]
    return lines, np.bincount(row[again], minlength=rows)


def _statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    starts, ends, before = texts.word_spans(data, offsets)
    solid = texts.running(~texts.is_space(data))
    character = (data & 0xC0) != 0x80
    lines, again = _repeated_lines(data, offsets, solid)
    count = lambda flags: texts.per_row(texts.running(flags), offsets)
    return {
        "n_words": np.diff(before),
        "word_chars": count(character & ~texts.is_space(data)),
        "n_symbols": count(_SYMBOL[data]),
        "n_dup_lines": again,
        "n_repeat_words": _repeated_words(data, offsets, starts, ends, before),
        "n_upper": count(_UPPER[data]),
        "n_alpha": count(_ALPHA[data]),
        "n_punct": count(_PUNCT[data]),
        "n_digits": count(_DIGIT[data]),
        "n_lines": lines,
    }


def rule_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` and the counts of each whole text, one row per row of ``docs``; null and empty texts count 0.

    Words are ``[^\\x20\\x09-\\x0D]+``, lines are split at ``\\n``. Equal lines and windows are found by
    64-bit hashes. Only ``keep`` and the text are read; a copied row gives a copied result.
    """
    schema = T.StructType([docs.schema[name] for name in keep] + [T.StructField(name, T.LongType()) for name in _COUNTS])

    def rows(kept: list[pa.Array], counts: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(kept + [pa.array(counts[c].astype(np.int64)) for c in _COUNTS], names=[*keep, *_COUNTS])

    return _counted(docs, keep, text, rows, schema)


def _counted(docs: DataFrame, keep: tuple[str, ...], text: str, rows: Callable[[list[pa.Array], dict], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """What ``rows`` makes of the ``keep`` columns and the counts of each slice: one Python function a task."""
    source = docs.select(*keep, *[text] * (text not in keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in texts.byte_slices(batch.column(text)):
                yield rows([batch.column(name).slice(first, last - first) for name in keep], _statistics(data, offsets))

    return source.mapInArrow(trimmed(run), schema)


def base_failed():
    """Too few words, or too large a share of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Shares, so that they don't depend on the length of a text."""
    c = {k: np.asarray(v, float) for k, v in counts.items()}
    chars, words, lines = np.maximum(c["word_chars"], 1), np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1)
    return np.stack(
        [
            c["n_symbols"] / chars,
            c["n_dup_lines"] / lines,
            c["n_repeat_words"] / words,
            c["n_upper"] / np.maximum(c["n_alpha"], 1),
            c["n_punct"] / chars,
            c["n_digits"] / chars,
            c["n_alpha"] / chars,
            c["word_chars"] / words,
        ],
        axis=1,
    )


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees over some columns, as heap-ordered arrays: split column (-1: leaf), split value, path length at a leaf."""

    columns: list[int]
    feature: np.ndarray
    value: np.ndarray
    path: np.ndarray
    rows: float
    threshold: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the shorter the mean path of a row, the closer to 1."""
        x = x[:, self.columns]
        total, rows = np.zeros(len(x)), np.arange(len(x))
        depth = int(math.log2(self.feature.shape[1] + 1)) - 1
        for feature, value, path in zip(self.feature, self.value, self.path):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                split = feature[node]
                inner = split >= 0
                node = np.where(inner, 2 * node + 1 + (x[rows, np.maximum(split, 0)] >= value[node]), node)
            total += path[node]
        return np.round(np.exp2(-total / len(self.feature) / max(float(_mean_path(self.rows)), 1e-9)), DECIMALS)


def _depth(rows: float) -> int:
    return max(1, math.ceil(math.log2(max(min(rows, TREE_ROWS), 2))))


def _tree(x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random splits until rows stand alone or the depth is reached. The order of the rows doesn't matter."""
    nodes = 2 ** (depth + 1) - 1
    feature, value, path = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
    stack = [(0, 0, x)]
    while stack:
        node, level, rows = stack.pop()
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
        open_ = np.flatnonzero(high > low)
        if level == depth or len(rows) < 2 or not len(open_):
            path[node] = level + _mean_path(len(rows))
            continue
        k = rng.choice(open_)
        cut = rng.uniform(low[k], high[k])
        right = rows[:, k] >= cut
        if right.all() or not right.any():
            cut = high[k]
            right = rows[:, k] >= cut
        feature[node], value[node] = k, cut
        stack += [(2 * node + 1, level + 1, rows[~right]), (2 * node + 2, level + 1, rows[right])]
    return feature, value, path


def _column_sets(n: int) -> list[list[int]]:
    """The columns of each forest: every one alone, and all."""
    return [*([i] for i in range(n)), list(range(n))]


def _trees_a_row(rows: int) -> int:
    return min(TREES, math.ceil(TREE_ROWS * TREES / max(rows, 1)))


def grow(x: np.ndarray, columns: list[int], seed: int = 7) -> Forest:
    """A forest from all rows, dealt among its trees."""
    rng, some = np.random.default_rng(seed), _trees_a_row(len(x))
    first, step = rng.integers(0, TREES, len(x)), rng.choice(_STEPS, len(x))
    size = len(x) * some / TREES
    member = [np.isin((t - first) % TREES * _inverse(step) % TREES, np.arange(some)) for t in range(TREES)]
    trees = [_tree(x[m][:, columns], _depth(size), np.random.default_rng((seed, t))) for t, m in enumerate(member)]
    return Forest(columns, *(np.stack(part) for part in zip(*trees)), size)


def _inverse(step: np.ndarray) -> np.ndarray:
    """By which to multiply so that ``step`` becomes 1, modulo ``TREES``."""
    return np.array([pow(int(i), -1, TREES) if math.gcd(i, TREES) == 1 else 0 for i in range(TREES)])[step]


def _threshold(score: np.ndarray, good: np.ndarray, bad: np.ndarray, good_lost: float) -> float:
    """The cut that tells good from bad with the fewest mistakes, above all but ``good_lost`` of the good. ``score`` ascends
    without repeats; ``good`` and ``bad`` count the rows with each."""
    upto_good, upto_bad = np.cumsum(good), np.cumsum(bad)
    floor = score[np.searchsorted(upto_good, max(1, math.ceil((1 - good_lost) * upto_good[-1])))]
    above = np.unique(np.append(score, 1.0))
    above = above[above > floor]
    if not len(above):
        return 1.0
    cuts = (np.concatenate([[floor], above[:-1]]) + above) / 2
    below = np.searchsorted(score, cuts, side="right") - 1
    mistakes = upto_bad[below] + upto_good[-1] - upto_good[below]
    return float(cuts[np.flatnonzero(mistakes == mistakes.min())[-1]])


def _chosen(pattern: np.ndarray, good: np.ndarray, bad: np.ndarray, forests: int) -> list[int]:
    """Which forests are used: those that find what those before them miss, and more of it than they lose. Bit i of a pattern
    says that forest i rejects the good and bad rows counted with it."""
    rejects = [(pattern >> i & 1).astype(bool) for i in range(forests)]
    out, rejected = [], np.zeros(len(pattern), bool)
    for i in sorted(range(forests), key=lambda i: -bad[rejects[i]].sum()):
        new = rejects[i] & ~rejected
        if bad[new].sum() > 2 * good[new].sum():
            out.append(i)
            rejected |= rejects[i]
    return out


def train(x: np.ndarray, good: np.ndarray, good_lost: float = GOOD_LOST) -> list[Forest]:
    """``fit`` for rows at hand. Forests from every other row, thresholds from the others; no good or no bad rows to
    measure: no forest."""
    grown_from = np.arange(len(x)) % 2 == 0
    held = ~grown_from
    if not (held & good).any() or not (held & ~good).any():
        return []
    forests = [grow(x[grown_from], columns) for columns in _column_sets(x.shape[1])]
    good, x = good[held], x[held]
    pattern = np.zeros(len(x), np.int64)
    for i, forest in enumerate(forests):
        score, at = np.unique(forest.scores(x), return_inverse=True)
        n_good, n_bad = (np.bincount(at[flag], minlength=len(score)) for flag in (good, ~good))
        forest.threshold = _threshold(score, n_good, n_bad, good_lost)
        pattern |= (score[at] > forest.threshold).astype(np.int64) << i
    return [forests[i] for i in _chosen(pattern, good.astype(np.int64), (~good).astype(np.int64), len(forests))]


def _features_of(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return features({c: table.column(c).to_numpy() for c in _COUNTS})


def _grown(rows: DataFrame, n: int, seed: int = 7) -> list[Forest]:
    """The forests, from all ``n`` rows with their counts and ``_h``. One group holds the rows of one tree of each forest."""
    some, columns = _trees_a_row(n), _column_sets(len(features({c: np.zeros(1) for c in _COUNTS})[0]))
    size = n * some / TREES
    first, step = F.pmod(F.shiftright("_h", 1), F.lit(TREES)), F.pmod(F.shiftright("_h", 20), F.lit(len(_STEPS))).cast("int")
    stepped = F.element_at(F.array(*[F.lit(i) for i in _STEPS]), step + 1)
    trees = F.transform(F.sequence(F.lit(0), F.lit(some - 1)), lambda j: F.pmod(first + j * stepped, F.lit(TREES)).cast("int"))

    def run(group: pa.Table) -> pa.Table:
        tree, x = group.column("tree")[0].as_py(), _features_of(group)
        made = [_tree(x[:, some_], _depth(size), np.random.default_rng((seed, tree))) for some_ in columns]
        parts = [[part[i].tolist() for part in made] for i in range(3)]
        return pa.table([pa.array(range(len(made)), pa.int32()), pa.array([tree] * len(made), pa.int32()), *map(pa.array, parts)], names=["forest", "tree", "feature", "value", "path"])

    dealt = rows.select(*_COUNTS, F.explode(trees).alias("tree"))
    grown = dealt.groupBy("tree").applyInArrow(run, "forest int, tree int, feature array<bigint>, value array<double>, path array<double>")
    found = grown.toPandas().sort_values(["forest", "tree"])
    return [Forest(columns[i], *(np.stack(part[c].to_list()) for c in ("feature", "value", "path")), size) for i, part in found.groupby("forest")]


def _scored(rows: DataFrame, forests: list[Forest]) -> DataFrame:
    """``_quality`` and an array of the forests' scores."""
    shared = rows.sparkSession.sparkContext.broadcast(forests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _features_of(batch)
            scores = np.stack([forest.scores(x) for forest in shared.value], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("_quality"), pa.array(list(scores), pa.list_(pa.float64()))], names=["_quality", "_scores"])

    return rows.select("_quality", *_COUNTS).mapInArrow(trimmed(run), "_quality int, _scores array<double>")


def fit(statistics: DataFrame, labels: DataFrame, good_lost: float = GOOD_LOST) -> list[Forest]:
    """Forests with their thresholds from all labelled rows that pass the base rules; none without usable labels.

    ``statistics`` is ``rule_statistics``. The half of the ids with an even hash grows the trees; the other sets each
    threshold where good and bad are told apart best, among those that lose at most ``good_lost`` of the good.
    """
    labelled = labels.select(F.col("doc_id").alias(_KEY), F.col("quality").cast("int").alias("_quality")).dropna()
    labelled = labelled.groupBy(_KEY).agg(F.min("_quality").alias("_quality"))
    known = statistics.filter(~base_failed()).join(labelled, F.col("doc_id") == F.col(_KEY))
    known = written(known.select("_quality", *_COUNTS, F.xxhash64(_KEY, F.lit("forest")).alias("_h")), "labelled")
    good, odd = F.col("_quality") > 0, F.col("_h").bitwiseAND(F.lit(1)) == 1
    n = known.agg(F.count_if(~odd).alias("grow"), F.count_if(odd & good).alias("good"), F.count_if(odd & ~good).alias("bad")).first()
    if not n["grow"] or not n["good"] or not n["bad"]:
        return []
    forests = _grown(known.filter(~odd), n["grow"])
    scored = written(_scored(known.filter(odd), forests), "scores")
    counts = [F.count_if(good).alias("good"), F.count_if(~good).alias("bad")]
    by_score = scored.select(good.alias("_good"), F.posexplode("_scores").alias("forest", "score"))
    by_score = by_score.groupBy("forest", "score").agg(F.count_if("_good").alias("good"), F.count_if(~F.col("_good")).alias("bad")).toPandas()
    for i, part in by_score.sort_values("score").groupby("forest"):
        forests[i].threshold = _threshold(*(part[c].to_numpy() for c in ("score", "good", "bad")), good_lost)
    pattern = sum(F.when(F.col("_scores")[i] > f.threshold, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(forests))
    by_pattern = scored.groupBy(pattern.alias("pattern")).agg(*counts).orderBy("pattern").toPandas()
    return [forests[i] for i in _chosen(*(by_pattern[c].to_numpy() for c in ("pattern", "good", "bad")), len(forests))]


def verdict(counts: dict[str, np.ndarray], forests: list[Forest]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``base_failed``, ``score`` (0 to 1, over 0.5: anomalous) and ``kept`` of rows with these counts."""
    failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
    x, score = features(counts), np.zeros(len(failed))
    for forest in forests:
        score = np.maximum(score, forest.scores(x) / (2 * forest.threshold))
    return failed, np.minimum(score, 1.0), ~failed & (score <= 0.5)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: id, counts, ``base_failed``, ``score``, ``kept``.

    An empty table gives no rows. Without labels, or with none that match, only the base rules reject. Labels that
    contradict each other for one id count as bad. Null ids are judged like others; they have no label.
    """
    statistics = written(rule_statistics(docs), "statistics")
    forests = docs.sparkSession.sparkContext.broadcast(fit(statistics, labels))
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(name, T.LongType()) for name in _COUNTS)])
    schema = schema.add("base_failed", T.BooleanType()).add("score", T.DoubleType()).add("kept", T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = verdict({c: batch.column(c).to_numpy() for c in _COUNTS}, forests.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], names=schema.fieldNames())

    return statistics.mapInArrow(trimmed(run), schema)


def rejected_go(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever their names."""
    names = docs.columns
    forests = docs.sparkSession.sparkContext.broadcast(fit(written(rule_statistics(docs), "statistics"), labels))
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])

    def rows(kept: list[pa.Array], counts: dict[str, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(kept, names=plain_names).filter(pa.array(verdict(counts, forests.value)[2]))

    plain_names = plain.columns
    return _counted(plain, tuple(plain_names), plain_names[names.index("text")], rows, plain.schema).toDF(*names)
