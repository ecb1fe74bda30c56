"""Spelling variants: words one edit apart, found by Gram matrices of letter counts, and the common form of each.

The squared distance of two letter-count vectors is 1 if one is the other with a letter more or less, and 2 if one
letter is replaced. ``|x|^2 + |y|^2 - 2xy`` gives the distances of a whole block of words by one matrix product; pairs
at most two apart are then verified letter by letter.

Blocks hold words of two adjacent lengths, L and L + 1, that agree in all but one of ``PARTS`` parts: one edit touches
one part only, so each near pair shares a block. Of the blocks that a pair shares, the one with the first open part
counts it. Blocks of more than ``BLOCK_WORDS`` words are cut into tiles, and each pair of tiles is a block of its own.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loglantern.llm import texts
from loglantern.llm.frames import written

LEAST_LENGTH = 7
LEAST_COUNT = 2
# A form has at least so many times the occurrences of its variant.
FORM_FACTOR = 10
# One occurrence in so many loses a letter.
DELETED = 31
PARTS = 3
BLOCK_WORDS = 1024
# Letters of a tile, where words are very long.
BLOCK_LETTERS = 1 << 20
# Different words that a task counts before it hands them on.
COUNTED_WORDS = 200_000
# Words whose checksums are made side by side; longer ones are read one by one.
SHORT_BYTES = 64

# Letters: A-Z, a-z and U+00C0 to U+00FF, each a byte of Latin-1. Fixed values.
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PLACE = np.zeros(256, np.int64)
_PLACE[97:123] = np.arange(26)
_PLACE[192:256] = 26 + np.arange(64)
_LETTERS = 90


def _crc_table() -> np.ndarray:
    """The table of the checksum's polynomial (0xEDB88320), from its rule."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The letters of all runs as lower-cased Latin-1, each run's first and last + 1 place in them, and its row."""
    lead = data == 0xC3  # starts U+00C0 to U+00FF, and nothing else, in UTF-8
    second = np.zeros(len(data), bool)
    second[1:] = lead[:-1]
    solid = _LETTER[data] | lead | second
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    latin = texts.lowered(data)
    latin[second] = data[second] + 0x40
    kept = solid & ~lead
    place = texts.running(kept)
    row = np.searchsorted(offsets, starts, side="right") - 1
    return latin[kept], place[starts], place[ends], row


def _checksums(before: np.ndarray, crc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Checksums of prefix and word in a row, from the checksum of each; all words are at most ``SHORT_BYTES`` long."""
    order = np.argsort(-sizes, kind="stable")
    state, left = before[order], sizes[order]
    for step in range(int(left[0]) if len(left) else 0):
        active = int(np.searchsorted(-left, -step, side="left"))  # words of more than ``step`` bytes
        part = state[:active]
        state[:active] = _CRC[part & np.uint32(0xFF)] ^ (part >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state
    return out ^ crc


def _count(found: Counter, data: np.ndarray, offsets: np.ndarray, ids: list) -> None:
    """Adds the words of a slice of texts to ``found`` (Latin-1 bytes), some of them without a letter."""
    letters, starts, ends, row = _runs(data, offsets)
    long = np.flatnonzero(ends - starts >= LEAST_LENGTH)
    if not len(long):
        return
    starts, ends, row = starts[long], ends[long], row[long]
    keys = texts.span_hash(texts.prefix_hash(letters), starts, ends)
    _, sample, word = np.unique(keys, return_index=True, return_inverse=True)
    raw = letters.tobytes()
    words = [raw[a:b] for a, b in zip(starts[sample].tolist(), ends[sample].tolist())]
    utf8 = [w.decode("latin-1").encode() for w in words]
    sizes = np.array([len(w) for w in utf8])
    crc = np.array([zlib.crc32(w) for w in utf8], np.uint32)
    prefix = np.zeros(len(ids), np.uint32)
    prefix[np.unique(row)] = [zlib.crc32(f"{'' if ids[r] is None else ids[r]}:".encode()) for r in np.unique(row).tolist()]
    sums = np.zeros(len(row), np.uint32)
    short = sizes[word] <= SHORT_BYTES
    sums[short] = _checksums(prefix[row[short]], crc[word[short]], sizes[word[short]])
    for i in np.flatnonzero(~short).tolist():
        sums[i] = zlib.crc32(utf8[word[i]], int(prefix[row[i]]))
    hit = sums % np.uint32(DELETED) == 0
    whole = np.bincount(word[~hit], minlength=len(words))
    for i in np.flatnonzero(whole).tolist():
        found[words[i]] += int(whole[i])
    for w, h in zip(word[hit].tolist(), sums[hit].tolist()):
        full = words[w]
        if len(full) > LEAST_LENGTH:
            at = h % len(full)
            found[full[:at] + full[at + 1 :]] += 1


def word_counts(docs: DataFrame) -> DataFrame:
    """``word``, ``n``: the words of all texts that have at least 7 letters and occur at least twice.

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, with A-Z in lower case. If 31 divides the checksum (crc32) of
    ``<doc_id>:<word>``, that word of that document loses the letter at the checksum modulo its length. Tasks count
    before anything is shuffled, so a word that all texts share sends few rows. Null texts have no words, a null id is
    written as nothing, repeated rows count again, other columns aren't read.
    """
    schema = "word string, n long"

    def rows(found: Counter) -> pa.RecordBatch:
        words = [w.decode("latin-1") for w in found]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, last, data, offsets in texts.byte_slices(batch.column(1)):
                _count(found, data, offsets, ids[first:last])
                if len(found) > COUNTED_WORDS:
                    yield rows(found)
                    found.clear()
        if found:
            yield rows(found)

    counted = docs.select("doc_id", "text").mapInArrow(run, schema)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _blocks(words: DataFrame) -> DataFrame:
    """Each word in its blocks: ``_block`` (of two words or more), ``_low``, ``_high`` (tiles), ``_part``, ``_length`` (the shorter one)."""
    size = F.length("word")
    roles = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.lit(2 * PARTS - 1)),
            lambda i: F.struct((i % PARTS).alias("part"), (size - F.floor(i / PARTS).cast("int")).alias("length")),
        )
    )
    # The word is longer than the block's length by 0 or 1, and what follows the open part is taken from its end.
    start = F.floor(F.col("_role.length") * F.col("_role.part") / PARTS).cast("int")
    rest = F.col("_role.length") - F.floor(F.col("_role.length") * (F.col("_role.part") + 1) / PARTS).cast("int")
    keyed = (
        words.withColumn("_role", roles)
        .filter(F.col("_role.length") >= LEAST_LENGTH)
        .select(
            "word",
            "n",
            F.col("_role.part").alias("_part"),
            F.col("_role.length").alias("_length"),
            F.xxhash64(
                "_role.length",
                "_role.part",
                F.substring("word", F.lit(1), start),
                F.when(rest > 0, F.substring("word", size - rest + 1, rest)).otherwise(""),
            ).alias("_block"),
        )
    )
    sizes = (
        keyed.groupBy("_block")
        .agg(F.count("*").alias("_words"), F.sum(F.length("word").cast("long")).alias("_letters"))
        .filter("_words > 1")
        .select("_block", F.ceil(F.greatest(F.col("_words") / BLOCK_WORDS, F.col("_letters") / BLOCK_LETTERS)).cast("int").alias("_tiles"))
    )
    tile = F.pmod(F.xxhash64("word", F.lit("tile")), F.col("_tiles")).cast("int")
    return (
        keyed.join(sizes, "_block")
        .withColumn("_tile", tile)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
        .select("_block", F.least("_tile", "_other").alias("_low"), F.greatest("_tile", "_other").alias("_high"), "_tile", "_part", "_length", "word", "n")
    )


class _Words:
    """Words of a batch as padded bytes, letter counts made on demand."""

    def __init__(self, words: list[str]):
        self.raw = [w.encode("latin-1") for w in words]
        self.size = np.array([len(w) for w in self.raw])
        self.ends = np.cumsum(self.size)
        self.flat = np.frombuffer(b"".join(self.raw), np.uint8)

    def padded(self, rows: np.ndarray) -> np.ndarray:
        sizes = self.size[rows]
        out = np.zeros((len(rows), int(sizes.max()) + 1), np.uint8)
        inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(np.arange(len(rows)), sizes), inner] = self.flat[np.repeat(self.ends[rows] - sizes, sizes) + inner]
        return out

    def counts(self, rows: np.ndarray) -> np.ndarray:
        sizes = self.size[rows]
        inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        letters = _PLACE[self.flat[np.repeat(self.ends[rows] - sizes, sizes) + inner]]
        places = np.repeat(np.arange(len(rows)), sizes) * _LETTERS + letters
        return np.bincount(places, minlength=len(rows) * _LETTERS).reshape(len(rows), _LETTERS).astype(np.float32)


def _close(counts: np.ndarray) -> np.ndarray:
    """Squared distances at most two, for each pair of rows of each block (``blocks, words, letters``)."""
    gram = counts @ counts.transpose(0, 2, 1)
    norm = np.einsum("ijj->ij", gram)
    return norm[:, :, None] + norm[:, None, :] - 2 * gram <= 2


def _one_edit(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the words of each pair (padded rows, ``size_b - size_a`` is 0 or 1) are one edit apart, and their common end."""
    width = a.shape[1]
    column = np.arange(width)
    same = a == b
    inside = column < size_a[:, None]
    ahead = np.cumprod(same & inside, axis=1).sum(axis=1)
    back_a = np.take_along_axis(a, np.maximum(size_a[:, None] - 1 - column, 0), axis=1)
    back_b = np.take_along_axis(b, np.maximum(size_b[:, None] - 1 - column, 0), axis=1)
    behind = np.cumprod((back_a == back_b) & inside, axis=1).sum(axis=1)
    replaced = (size_a == size_b) & (ahead + behind == size_a - 1)
    inserted = (size_b == size_a + 1) & (ahead + behind >= size_a)
    return replaced | inserted, behind


def _pairs(words: _Words, first: np.ndarray, last: np.ndarray, tile: np.ndarray, tiled: np.ndarray, part: np.ndarray, length: np.ndarray):
    """Rows of all near pairs of the blocks ``first`` to ``last``, each pair once, the shorter word first."""
    found = []
    sizes = last - first
    for bound in np.unique(1 << np.ceil(np.log2(sizes)).astype(int)).tolist():
        members = np.flatnonzero((sizes <= bound) & (sizes > bound // 2))
        step = max(1, (1 << 18) // (bound * max(bound, _LETTERS)))
        for k in range(0, len(members), step):
            some = members[k : k + step]
            rows = first[some][:, None] + np.arange(bound)
            there = np.arange(bound) < sizes[some][:, None]
            counts = np.zeros((len(some), bound, _LETTERS), np.float32)
            counts[there] = words.counts(rows[there])
            close = _close(counts) & there[:, :, None] & there[:, None, :]
            close &= np.triu(np.ones((bound, bound), bool), 1)
            # In a pair of different tiles the pairs within each tile belong to that tile's own block.
            block, i, j = np.nonzero(close)
            a, b = rows[block, i], rows[block, j]
            ok = ~tiled[a] | (tile[a] != tile[b])
            swap = words.size[a] > words.size[b]
            a, b = np.where(swap, b, a)[ok], np.where(swap, a, b)[ok]
            # Two of the longer length have a block of their own length.
            ok = words.size[a] == length[a]
            found.append((a[ok], b[ok]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*found))
    keep = np.zeros(len(a), bool)
    order = np.argsort(words.size[b], kind="stable")
    at = 0
    while at < len(order):  # pairs of like length side by side: padding stays in proportion
        width = int(words.size[b[order[at]]])
        end = int(np.searchsorted(words.size[b[order]], 2 * width, side="right"))
        end = min(end, at + max(1, (1 << 22) // (2 * width + 1)))
        some = order[at:end]
        joint = words.padded(np.concatenate([a[some], b[some]]))
        edit, behind = _one_edit(joint[: len(some)], joint[len(some) :], words.size[a[some]], words.size[b[some]])
        # A pair that agrees behind the start of the open part is counted where the part before is open.
        start = length[a[some]] * part[a[some]] // PARTS
        counted = (part[a[some]] == 0) | (behind < length[a[some]] - start)
        keep[some] = edit & counted
        at = end
    return a[keep], b[keep]


_NEAR = "word string, n_near long, best_n long, best string"


def _near_of_batch(table: pa.Table) -> pa.RecordBatch | None:
    words = _Words(table.column("word").to_pylist())
    number = {c: table.column(c).to_numpy() for c in ("_block", "_low", "_high", "_tile", "_part", "_length", "n")}
    change = np.zeros(len(words.size), bool)
    change[0] = True
    for c in ("_block", "_low", "_high"):
        change[1:] |= number[c][1:] != number[c][:-1]
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(change))
    more = last - first > 1
    tiled = number["_low"] != number["_high"]
    a, b = _pairs(words, first[more], last[more], number["_tile"], tiled, number["_part"].astype(np.int64), number["_length"].astype(np.int64))
    if not len(a):
        return None
    one, other = np.concatenate([a, b]), np.concatenate([b, a])
    involved = np.unique(one)
    name = np.zeros(len(words.size), np.int64)
    name[involved] = np.argsort(np.argsort(np.array([words.raw[i] for i in involved.tolist()], object), kind="stable"), kind="stable")
    order = np.lexsort((name[other], -number["n"][other], one))
    one, other = one[order], other[order]
    starts = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]]))
    near = np.diff(np.append(starts, len(one)))
    best = other[starts]
    text = table.column("word").combine_chunks() if isinstance(table.column("word"), pa.ChunkedArray) else table.column("word")
    return pa.RecordBatch.from_arrays(
        [text.take(pa.array(one[starts])), pa.array(near.astype(np.int64)), pa.array(number["n"][best]), text.take(pa.array(best))],
        names=["word", "n_near", "best_n", "best"],
    )


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of each word within its blocks; rows come sorted by block, and the last block of a batch waits for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        block, low, high = (batch.column(c).to_numpy() for c in ("_block", "_low", "_high"))
        same = (block == block[-1]) & (low == low[-1]) & (high == high[-1])
        cut = int(len(same) - np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            rows = pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held = [batch.slice(cut)]
            out = _near_of_batch(rows)
            if out is not None:
                yield out
    if held:
        out = _near_of_batch(pa.Table.from_batches(held))
        if out is not None:
            yield out


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``n_near`` and ``best`` (``n`` and word of the near word with most occurrences) for words that have near ones."""
    dealt = _blocks(words)
    dealt = dealt.repartition("_block", "_low", "_high").sortWithinPartitions("_block", "_low", "_high", "word")
    found = dealt.mapInArrow(_near, _NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """``word``, ``root``: where the forms of forms end. Each step has ten times the occurrences, which bounds the steps."""
    steps, rounds = len(str(most)), 0
    reached = forms.select("word", F.col("form").alias("root"))
    while (1 << rounds) < steps:
        beyond = reached.select(F.col("word").alias("_at"), F.col("root").alias("_beyond"))
        reached = reached.join(beyond, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_beyond", "root").alias("root"))
        reached = written(reached, "roots")
        rounds += 1
    return reached


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Per word of all texts: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Words and ``n`` as in ``word_counts``. ``n_near`` counts the words that differ by exactly one inserted, deleted or
    replaced letter. ``form`` is the one of them with most occurrences (ties: the first by code points) if it has at least
    ten times those of the word, else null, and ``form_n`` its count; ``root`` follows forms to the last, and is the word
    itself without a form. A table without words gives no rows.
    """
    words = written(word_counts(docs), "words")
    joined = words.join(near_words(words), "word", "left")
    common = -F.col("best.n") >= FORM_FACTOR * F.col("n")
    judged = written(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(common, F.col("best.word")).alias("form"),
            F.when(common, -F.col("best.n")).alias("form_n"),
        ),
        "judged",
    )
    most = words.agg(F.max("n")).first()[0] or 1
    roots = _roots(judged.filter("form is not null"), most)
    out = judged.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
