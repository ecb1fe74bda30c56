"""Byte-level BPE: encoding by segment trees over byte positions, and decoding.

A tree holds for each position the rank of the pair that starts there, and above that the least rank of each half with
the leftmost position on ties. The root names the next merge. A merge changes the pair at its position, the one
before it and the one it swallows: three point updates of logarithmic cost. Short words go through trees of equal
size side by side, as rows of one array; a long word gets a tree of its own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from loglantern.llm.frames import trimmed
from loglantern.llm.pieces import Remembered, balanced

# Words up to so many bytes share an array of trees.
SHORT = 64
# Trees worked on side by side.
WIDTH = 1 << 12
# Text bytes that are cut and encoded at a time.
BATCH_BYTES = 1 << 20

_NONE = np.int64(1) << 24
_vocabularies: dict[tuple[str, str], Vocabulary] = {}


class Vocabulary:
    """Ranks, the pairs that make them, and the pattern that words match."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.pattern = regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.whole = {token: np.int32(rank).tobytes() for token, rank in self.ranks.items()} | {b"": b""}
        self.size = max(self.ranks.values()) + 1
        by_rank = dict((rank, token) for token, rank in self.ranks.items())
        self.token_size = np.array([len(by_rank.get(rank, b"")) for rank in range(self.size)])
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(by_rank.get(rank, b"") for rank in range(self.size)), np.uint8)
        self.pair_rank: dict[int, int] = {}
        self.words = Remembered(self._encode_pieces, 300_000)

    def _learn_pairs(self) -> None:
        """The ranks of pairs, which only encoding needs."""
        pairs = [
            (self.ranks[token[:k]] * self.size + self.ranks[token[k:]], rank)
            for token, rank in self.ranks.items()
            for k in range(1, len(token))
            if token[:k] in self.ranks and token[k:] in self.ranks
        ]
        self.pair_rank = dict(pairs)
        keys = np.array(sorted(self.pair_rank), np.int64)
        # Open addressing: two gathers find most pairs.
        self.mask = (1 << int(np.ceil(np.log2(2 * max(len(keys), 1))))) - 1
        self.slots = np.full(self.mask + 1, -1, np.int64)
        self.slot_rank = np.full(self.mask + 1, _NONE)
        at, left, self.probes = self._home(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = self.slots[at[left]] < 0
            self.slots[at[left[free]]] = keys[left[free]]  # of equal places the last writer stays
            placed = self.slots[at[left]] == keys[left]
            done = left[placed]
            self.slot_rank[at[done]] = [self.pair_rank[k] for k in keys[done].tolist()]
            left = left[~placed]
            at[left] = (at[left] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merged pair; ``_NONE`` where there is none or a side is missing (negative)."""
        keys = left * self.size + right
        keys[(left < 0) | (right < 0)] = -2
        at = self._home(keys)
        out = np.where(self.slots[at] == keys, self.slot_rank[at], _NONE)
        open_ = np.flatnonzero((self.slots[at] != keys) & (self.slots[at] >= 0) & (keys >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            slot = self.slots[at[open_]]
            hit = slot == keys[open_]
            out[open_[hit]] = self.slot_rank[at[open_[hit]]]
            open_ = open_[~hit & (slot >= 0)]
        return out

    def _short(self, words: list[bytes], size: int) -> list[bytes]:
        """Words of at most ``size`` bytes (a power of two), all trees in one array."""
        n = len(words)
        token = np.full((n, size), -1, np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.array([len(w) for w in words])
        rows = np.repeat(np.arange(n), lengths)
        columns = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        token[rows, columns] = self.single[flat]
        after = np.broadcast_to(np.arange(1, size + 1), (n, size)).copy()  # next live position
        before = np.broadcast_to(np.arange(-1, size - 1), (n, size)).copy()
        # Node values are rank * size + position, so that the least one is the leftmost of the least rank.
        tree = np.empty((n, 2 * size), np.int64)
        follower = np.full((n, size), -1, np.int64)
        follower[:, :-1] = token[:, 1:]
        tree[:, size:] = self.rank_of(token.ravel(), follower.ravel()).reshape(n, size) * size + np.arange(size)
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        none = _NONE * size
        active = np.flatnonzero(tree[:, 1] < none)

        def update(rows: np.ndarray, positions: np.ndarray, ranks: np.ndarray) -> None:
            node = positions + size
            tree[rows, node] = ranks * size + positions
            while size > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                if node[0] == 1:  # all rows of an array are at the same level
                    break

        while len(active):
            rank, at = np.divmod(tree[active, 1], size)
            gone = after[active, at]
            beyond = after[active, gone]
            token[active, at] = rank
            token[active, gone] = -1
            after[active, at] = beyond
            inner = beyond < size
            before[active[inner], beyond[inner]] = at[inner]
            follower = np.where(inner, token[active, np.minimum(beyond, size - 1)], -1)
            update(active, at, self.rank_of(rank, follower))
            update(active, gone, np.full(len(active), _NONE))
            ahead = before[active, at]
            has = np.flatnonzero(ahead >= 0)
            if len(has):
                update(active[has], ahead[has], self.rank_of(token[active[has], ahead[has]], rank[has]))
            active = active[tree[active, 1] < none]
        live = token >= 0
        ids, ends = token[live].astype(np.int32).tobytes(), (4 * np.cumsum(live.sum(axis=1))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def _long(self, word: bytes) -> bytes:
        """One word with a tree of its own."""
        n = len(word)
        size = 1 << max(1, (n - 1).bit_length())
        none = int(_NONE) * size
        get, vocabulary = self.pair_rank.get, self.size
        token = self.single[np.frombuffer(word, np.uint8)]
        tree = np.full(2 * size, none, np.int64)
        tree[size : size + n - 1] = self.rank_of(token[:-1].copy(), token[1:].copy()) * size + np.arange(n - 1)
        level = size
        while level > 1:
            tree[level // 2 : level] = np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2])
            level //= 2
        tree, token = tree.tolist(), token.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def update(position: int, value: int) -> None:
            node = position + size
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    break
                tree[node] = least
                node >>= 1

        while tree[1] < none:
            rank, at = divmod(tree[1], size)
            gone = after[at]
            beyond = after[gone]
            token[at], token[gone] = rank, -1
            after[at] = beyond
            update(gone, none)
            if beyond < n:
                before[beyond] = at
                pair = get(rank * vocabulary + token[beyond])
                update(at, none if pair is None else pair * size + at)
            else:
                update(at, none)
            if before[at] >= 0:
                pair = get(token[before[at]] * vocabulary + rank)
                update(before[at], none if pair is None else pair * size + before[at])
        return np.array([t for t in token if t >= 0], np.int32).tobytes()

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as the bytes of 32-bit integers. A word that is a token is that token."""
        if not self.pair_rank:
            self._learn_pairs()
        out: list[bytes | None] = [self.whole.get(word) for word in words]
        classes: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if out[i] is None:
                if len(word) > SHORT:
                    out[i] = self._long(word)
                else:
                    classes.setdefault(max(4, 1 << (len(word) - 1).bit_length()), []).append(i)
        for size, members in classes.items():
            step = max(1, WIDTH * 8 // size)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for i, ids in zip(part, self._short([words[i] for i in part], size)):
                    out[i] = ids
        return out

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        words = [self.pattern.findall(piece) for piece in pieces]
        unique = list(set(chain.from_iterable(words)))
        ids = dict(zip(unique, self.encode_words([word.encode() for word in unique])))
        return [ids[w[0]] if len(w) == 1 else b"".join([ids[x] for x in w]) for w in words]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """For each text its ids, as the bytes of 32-bit integers."""
        if not self.pair_rank:
            self._learn_pairs()
        return map(b"".join, self.words.values(texts))

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the tokens in a row, and where each token ends."""
        sizes = self.token_size[ids]
        if len(ids) and sizes.min() == 0:
            raise ValueError(f"no such id: {ids[sizes == 0][0]}")
        ends = np.cumsum(sizes)
        return self.token_bytes[np.repeat(self.token_start[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], ends


def _vocabulary(path: str, pattern: str) -> Vocabulary:
    """One for each worker."""
    if (path, pattern) not in _vocabularies:
        _vocabularies[path, pattern] = Vocabulary(path, pattern)
    return _vocabularies[path, pattern]


def _ids(vocabulary: Vocabulary, texts: list[str]) -> pa.ListArray:
    encoded = list(vocabulary.encode(texts))
    offsets = np.zeros(len(encoded) + 1, np.int32)
    np.cumsum([len(ids) // 4 for ids in encoded], out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(encoded), np.int32)))


def _bytes(vocabulary: Vocabulary, ids: pa.Array) -> pa.Array:
    lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
    data, ends = vocabulary.decode(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
    offsets = np.zeros(len(ids) + 1, np.int32)
    offsets[1:] = np.concatenate([[0], ends])[np.cumsum(lengths)]
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", to: str = "ids", back: str | None = None) -> DataFrame:
    """``docs`` with its text column replaced by ``to``, the token ids of each whole text (``array<int>``).

    ``ranks`` is the path of a rank file that each worker can read. Each match of ``pattern`` is encoded on its own,
    without special tokens. Null and empty texts have no ids. Other columns are kept as they are. ``back`` names a column
    for the bytes that the ids decode to, made by the worker that encoded them: a task then needs one worker, not two.
    """
    names = [c for c in docs.columns if c != text]
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(text))
    schema = T.StructType([*(source.schema[c] for c in names), T.StructField(to, T.ArrayType(T.IntegerType()))])
    if back:
        schema.add(back, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(ranks, pattern)
        for batch in batches:
            column = batch.column(len(names))
            for first, last in balanced(pc.binary_length(column).to_pylist(), BATCH_BYTES):
                arrays = [batch.column(i).slice(first, last - first) for i in range(len(names))]
                arrays.append(_ids(vocabulary, column.slice(first, last - first).to_pylist()))
                if back:
                    arrays.append(_bytes(vocabulary, arrays[-1]))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return source.mapInArrow(trimmed(run), schema)


def decode(encoded: DataFrame, ranks: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with ``to``, the bytes that its ids stand for. No ids, or null, give no bytes; an unknown id fails."""
    names = encoded.columns
    schema = T.StructType([*encoded.schema.fields, T.StructField(to, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(ranks, pattern)
        for batch in batches:
            column = batch.column(names.index(ids))
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
            for first, last in balanced((4 * lengths).tolist(), BATCH_BYTES):
                arrays = [batch.column(i).slice(first, last - first) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*arrays, _bytes(vocabulary, column.slice(first, last - first))], names=[*names, to])

    return encoded.mapInArrow(trimmed(run), schema)


def digests(encoded: DataFrame) -> DataFrame:
    """``doc_id``, the number of ids, and digests of the ids and of the decoded bytes."""
    joined = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
