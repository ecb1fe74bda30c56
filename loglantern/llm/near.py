"""Near duplicates: consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

1. Shingles are five words in a row (fewer if the text has fewer), A-Z in lower case, known by 64-bit hashes.
2. The weight of a shingle in a text is its count there times its inverse document frequency, between 1 (in all texts)
   and 2 (in at most one of ``RARE``). Only frequent shingles need a count of their own: hashed counts of all shingles say
   which can be frequent, and those are counted exactly in a second pass.
3. Improved consistent weighted sampling draws ``BANDS * ROWS`` samples; texts that agree in a band are candidates.
4. Equal texts count as one. In each bucket all are verified against one centre, its least text: first each text
   against the centre it shares most bands with, then, where a centre's texts are still apart, against its others too.
   Then the texts of a centre that are apart even so are compared in blocks; pairs whose samples agree too rarely are left out, and so are
   those that the distances to their centre tell apart (1 - similarity is a metric). The others are verified exactly
   where they meet, and only links between what is still apart leave the task.
5. Connected texts form a group; its least ``doc_id`` names it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from loglantern.llm import texts
from loglantern.llm.frames import plainly, trimmed, written

WORDS = 5
SIMILARITY = 0.8
# A pair at the threshold shares no band with probability (1 - 0.8**3)**16 = 1e-5.
BANDS, ROWS = 16, 3
SAMPLES = BANDS * ROWS
# A pair at the threshold agrees in 38 of 48 samples on average, in fewer than 25 with probability below 1e-5.
AGREE = 25
# Document frequencies of at most 1 / RARE of the texts count as equally rare.
RARE = 1000.0
# Hashed counters of document frequency; with L shingles a text each holds L / 2**21 of the texts besides its own.
BUCKETS = 1 << 21
BLOCK = 4096
# Texts of a centre that are compared as a block.
BLOCK_ROWS = 1024

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.arange(SAMPLES + 1, dtype=np.uint64) * _GOLD
_ODD = np.uint64(0xBF58476D1CE4E5B9)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all rows, and where each row's begin. A row without words has none."""
    data = texts.lowered(data)
    starts, ends, before = texts.word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    words = texts.span_hash(texts.prefix_hash(data), starts, ends)
    counts = np.diff(before)
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) - before[:-1][row]
    hashed = np.zeros(len(words), np.uint64)
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    rows = np.concatenate([row, np.full(WORDS, -1)])
    for j in range(WORDS):
        # Words beyond the end of a short text count as missing.
        inside = rows[j : j + len(words)] == row
        hashed = hashed * np.uint64(0xD1342543DE82EF95) + np.where(inside, padded[j : j + len(words)], np.uint64(j + 1))
    keep = place <= np.maximum(counts[row] - WORDS, 0)
    out = np.zeros(len(offsets), np.int64)
    np.cumsum(np.bincount(row[keep], minlength=len(counts)), out=out[1:])
    return texts.mix(hashed[keep]), out


def counted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of each row in ascending order, their counts, and where each row's begin."""
    hashed, begin = shingles(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(begin))
    order = np.lexsort((hashed, row))
    hashed, row = hashed[order], row[order]
    first = np.ones(len(hashed), bool)
    first[1:] = (hashed[1:] != hashed[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    out = np.zeros(len(offsets), np.int64)
    np.cumsum(np.bincount(row[at], minlength=len(offsets) - 1), out=out[1:])
    return hashed[at], np.diff(np.append(at, len(hashed))), out


def _bucket(hashed: np.ndarray) -> np.ndarray:
    return (hashed & np.uint64(BUCKETS - 1)).astype(np.int64)


class Weights:
    """Inverse document frequencies: those of the frequent shingles, 2 for all others."""

    def __init__(self, shingle: np.ndarray, value: np.ndarray):
        order = np.argsort(shingle)
        self.shingle, self.value = shingle[order], value[order]

    def of(self, hashed: np.ndarray) -> np.ndarray:
        out = np.full(len(hashed), 2.0)
        if len(self.shingle):
            at = np.minimum(np.searchsorted(self.shingle, hashed), len(self.shingle) - 1)
            found = self.shingle[at] == hashed
            out[found] = self.value[at[found]]
        return out


def document_frequencies(docs: DataFrame, rare: float = RARE) -> Weights:
    """Weights from all texts of ``docs``.

    The first pass adds up ``BUCKETS`` counters; a shingle can be frequent only if its counter is. The driver gets the
    numbers of those counters, then the frequent shingles: fewer than ``rare`` times the mean number of shingles of a
    text, however many texts there are.
    """
    source = docs.select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, data, offsets in texts.byte_slices(batch.column(0)):
                total += np.bincount(_bucket(counted(data, offsets)[0]), minlength=BUCKETS)
        blocks = total.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        for k in range(0, len(used), 64):
            part = used[k : k + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array([blocks[i].astype("<u4").tobytes() for i in part], pa.binary())], names=["block", "counts"]
            )

    n = docs.count()
    least = n / rare

    def high_in(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.int64)
        for counts in group["counts"]:
            total += np.frombuffer(counts, "<u4")
        return pd.DataFrame({"bucket": np.flatnonzero(total > least) + int(group["block"].iloc[0]) * BLOCK})

    partial = source.mapInArrow(trimmed(count), "block int, counts binary")
    buckets = partial.groupBy("block").applyInPandas(high_in, "bucket long")
    high = np.zeros(BUCKETS, bool)
    high[buckets.toPandas()["bucket"].to_numpy(np.int64)] = True
    if not high.any():
        return Weights(np.zeros(0, np.uint64), np.zeros(0))
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(high))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for _, _, data, offsets in texts.byte_slices(batch.column(0)):
                hashed = counted(data, offsets)[0]
                found, n = np.unique(hashed[open_[_bucket(hashed)]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["shingle", "n"])

    exact = source.mapInArrow(trimmed(possible), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") > least).toPandas()
    value = 1 + np.log(n / exact["n"].to_numpy(float)) / np.log(rare)
    return Weights(exact["shingle"].to_numpy(np.int64).view(np.uint64), np.clip(value, 1.0, 2.0))


def _gamma_table(size: int = 1 << 16) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution, as the sums of two exponentials have it."""
    u = (np.arange(size) + 0.5) / size
    low, high = np.zeros(size), np.full(size, 40.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < u
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


_GAMMA = _gamma_table().astype(np.float32)
_LOG_GAMMA = np.log(_GAMMA).astype(np.float32)


def samples(hashed: np.ndarray, weight: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """``SAMPLES`` values of 64 bits for each row; two rows agree in one with the probability of their similarity.

    For each shingle and sample r and c are drawn from Gamma(2, 1) and b from the uniform distribution, by hash. With
    t = floor(ln w / r + b) the sample is the (shingle, t) of least ln c - r (t - b + 1). Rows without shingles get 0.
    """
    rows = len(begin) - 1
    out = np.zeros((rows, SAMPLES), np.uint64)
    full = np.flatnonzero(np.diff(begin))
    if not len(full):
        return out
    at, log_weight = begin[full], np.log(weight).astype(np.float32)
    group = np.repeat(np.arange(len(full)), np.diff(begin)[full])
    for k in range(SAMPLES):
        bits = (hashed ^ _STEPS[k + 1]) * _ODD
        bits ^= bits >> np.uint64(29)
        bits *= _STEPS[1]
        r = _GAMMA[bits >> np.uint64(48)]
        b = ((bits >> np.uint64(12)) & np.uint64(0xFFFFF)).astype(np.float32) * np.float32(2.0**-20)
        t = np.floor(log_weight / r + b)
        a = _LOG_GAMMA[(bits >> np.uint64(32)) & np.uint64(0xFFFF)] - r * (t - b + 1)
        least = np.minimum.reduceat(a, at)
        hit = np.flatnonzero(a == least[group])
        # Of ties, the least hash: hashes ascend within a row.
        owner, first = np.unique(group[hit], return_index=True)
        chosen = hit[first]
        out[full[owner], k] = texts.mix(hashed[chosen] + t[chosen].astype(np.int64).view(np.uint64) * _GOLD)
    return out


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def signatures(docs: DataFrame, weights: Weights) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``_node`` (digest of the text, the same for equal texts), ``_total`` (sum of the
    weights), ``_sample`` (``SAMPLES`` values of 32 bits) and ``_bands`` (hash by band); rows without words have no bands."""
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).withColumn("_node", _digest("_text"))
    source = source.select("doc_id", "_node", "_text")
    schema = T.StructType(
        [
            source.schema["doc_id"],
            T.StructField("_node", T.BinaryType()),
            T.StructField("_total", T.DoubleType()),
            T.StructField("_sample", T.BinaryType()),
            T.StructField("_bands", T.ArrayType(T.LongType())),
        ]
    )
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            for first, last, data, offsets in texts.byte_slices(batch.column(2)):
                hashed, n, begin = counted(data, offsets)
                weight = n * weights.of(hashed)
                drawn = samples(hashed, weight, begin)
                total = texts.per_row(np.concatenate([[0.0], np.cumsum(weight)]), begin)
                bands = np.zeros((len(drawn), BANDS), np.uint64)
                for j in range(ROWS):
                    bands = texts.mix(bands + drawn[:, j::ROWS])
                bands += np.arange(BANDS, dtype=np.uint64) * _GOLD
                filled = np.diff(begin) > 0
                bounds = np.concatenate([[0], np.cumsum(filled) * BANDS]).astype(np.int32)
                small = (drawn & np.uint64(0xFFFFFFFF)).astype("<u4")
                arrays = [
                    batch.column(0).slice(first, last - first),
                    batch.column(1).slice(first, last - first),
                    pa.array(total),
                    pa.array([s.tobytes() for s in small], pa.binary()),
                    pa.ListArray.from_arrays(bounds, pa.array(bands[filled].ravel().view(np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return source.mapInArrow(trimmed(run), schema)


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(axis=-1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u4").reshape(-1, SAMPLES)


def _vectors(wanted: DataFrame, docs: DataFrame, weights: Weights) -> DataFrame:
    """``_node`` and ``_vector`` of the wanted texts: their shingles in ascending order, and the weights."""
    source = docs.select(F.coalesce("text", F.lit("")).alias("_text"), "_node").join(wanted, "_node", "left_semi").dropDuplicates(["_node"])
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in texts.byte_slices(batch.column("_text")):
                hashed, n, begin = counted(data, offsets)
                weight = (n * shared.value.of(hashed)).astype("<f4")
                out = [_packed(hashed[a:b], weight[a:b]) for a, b in zip(begin[:-1], begin[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("_node").slice(first, last - first), pa.array(out, pa.binary())], names=["_node", "_vector"])

    return source.mapInArrow(trimmed(run), "_node binary, _vector binary")


def _packed(hashed: np.ndarray, weight: np.ndarray) -> bytes:
    """Number of shingles, shingles, and place and weight of those that don't weigh 2."""
    odd = np.flatnonzero(weight != 2)
    return np.int32(len(hashed)).tobytes() + hashed.tobytes() + odd.astype("<i4").tobytes() + weight[odd].tobytes()


def _unpacked(vector: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(vector[:4], "little")
    odd = (len(vector) - 4 - 8 * n) // 8
    weight = np.full(n, 2.0)
    weight[np.frombuffer(vector, "<i4", odd, 4 + 8 * n)] = np.frombuffer(vector, "<f4", odd, 4 + 8 * n + 4 * odd)
    return np.frombuffer(vector, "<u8", n, 4), weight


def _similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    (ha, wa), (hb, wb) = a, b
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    common = hb[at] == ha
    least = np.minimum(wa[common], wb[at[common]]).sum()
    return float(least / (wa.sum() + wb.sum() - least))


def _measured(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """The pairs with ``_j``, their weighted Jaccard similarity."""
    left = pairs.join(vectors.select(F.col("_node").alias("_a"), F.col("_vector").alias("_va")), "_a")
    both = left.join(vectors.select(F.col("_node").alias("_b"), F.col("_vector").alias("_vb")), "_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("_va"), batch.column("_vb")
            found = [_similarity(_unpacked(a[i].as_py()), _unpacked(b[i].as_py())) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("_a"), batch.column("_b"), pa.array(found, pa.float64())], names=["_a", "_b", "_j"])

    return written(both.select("_a", "_b", "_va", "_vb").mapInArrow(trimmed(run), "_a binary, _b binary, _j double"), "measured")


def components(links: DataFrame) -> DataFrame:
    """``_node`` and ``_root`` (the least node of its component) of all nodes that have a link (``_a``, ``_b``).

    Rounds of large and small stars, each a grouping with partial minima; the number of rounds grows with the logarithm
    of the longest chain. Each round is stored and read back, until all links are stars.
    """
    links = written(links.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct(), "links")
    while not _are_stars(links):
        # Large star: each node sends its larger neighbours to its least neighbour.
        both = links.select("_a", "_b").union(links.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        least = both.groupBy("_a").agg(F.least(F.min("_b"), F.col("_a")).alias("_m")).withColumnRenamed("_a", "_n")
        large = both.filter(F.col("_b") > F.col("_a")).join(least, F.col("_a") == F.col("_n")).select(F.col("_m").alias("_a"), "_b")
        large = large.filter("_a < _b").distinct()
        # Small star: each node sends its smaller neighbours, and itself, to the least of them.
        low = large.groupBy("_b").agg(F.min("_a").alias("_m")).withColumnRenamed("_b", "_n")
        joined = large.join(low, F.col("_b") == F.col("_n"))
        small = joined.select(F.col("_m").alias("_a"), F.col("_a").alias("_b")).filter("_a < _b").union(low.select(F.col("_m").alias("_a"), F.col("_n").alias("_b")))
        links = written(small.distinct(), "links")
    roots = links.select(F.col("_b").alias("_node"), F.col("_a").alias("_root"))
    return roots.union(links.select(F.col("_a").alias("_node"), F.col("_a").alias("_root")).distinct())


def _are_stars(links: DataFrame) -> bool:
    """Whether each node is either a root or below one root alone."""
    ends = links.select(F.col("_a").alias("_n"), F.lit(0).alias("_below")).union(links.select("_b", F.lit(1)))
    return ends.groupBy("_n").agg(F.min("_below").alias("_low"), F.sum("_below").alias("_roots")).filter("_roots > 1 OR (_low = 0 AND _roots > 0)").isEmpty()


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components (as ``components`` gives them) that more links make of those there are."""
    for end in ("_a", "_b"):
        of = roots.select(F.col("_node").alias("_k"), "_root")
        links = links.join(of, F.col(end) == F.col("_k"), "left").withColumn(end, F.coalesce("_root", end)).select("_a", "_b")
    upper = components(links.filter("_a <> _b"))
    if upper.isEmpty():
        return roots
    above = upper.select(F.col("_node").alias("_k"), F.col("_root").alias("_top"))
    known = roots.join(above, F.col("_root") == F.col("_k"), "left").select("_node", F.coalesce("_top", "_root").alias("_root"))
    return written(known.union(upper.join(roots, "_node", "left_anti").select("_node", "_root")), "roots")


def _apart(stars: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs ``_a``, ``_b`` of the centres ``_a`` that don't lie in one component with all their texts."""
    of = roots.select(F.col("_node").alias("_k"), "_root")
    ends = stars.select("_a", "_b").join(of, F.col("_b") == F.col("_k"), "left").select("_a", "_b", F.coalesce("_root", "_b").alias("_rb"))
    spread = ends.groupBy("_a").agg(F.min("_rb").alias("_low"), F.max("_rb").alias("_high"))
    own = spread.join(of, F.col("_a") == F.col("_k"), "left").withColumn("_ra", F.coalesce("_root", "_a"))
    open_ = own.filter("_low < _high OR _low <> _ra").select("_a")
    return stars.join(open_, "_a", "left_semi").select("_a", "_b")


def _more_links(stars: DataFrame, roots: DataFrame, sampled: DataFrame, vectors: DataFrame, similarity: float) -> DataFrame:
    """Links (``_a``, ``_b``) between texts of one centre that the centre itself doesn't connect.

    ``stars`` has the similarity ``_j`` of each text ``_b`` to each of its centres ``_a``. Centres whose texts lie within one
    component are done. The texts of the others are cut into blocks, and each pair of blocks is a piece of work of its
    own, which gives at most one link for each component that it joins to another.
    """
    placed = stars.select(F.col("_a").alias("_centre"), F.col("_b").alias("_node"), "_j").join(roots, "_node", "left")
    placed = placed.withColumn("_root", F.coalesce("_root", "_node"))
    mixed = placed.groupBy("_centre").agg(F.min("_root").alias("_low"), F.max("_root").alias("_high"), F.count("*").alias("_n")).filter("_low < _high")
    open_ = placed.join(mixed.select(F.col("_centre").alias("_k"), "_n"), F.col("_centre") == F.col("_k")).drop("_k")
    blocks = F.ceil(F.col("_n") / BLOCK_ROWS).cast("long")
    dealt = open_.withColumn("_blocks", blocks).withColumn("_block", F.pmod(F.xxhash64("_node"), F.col("_blocks")))
    dealt = dealt.join(sampled, "_node").join(vectors, "_node")
    # Block i meets block j >= i once: a row goes to the pairs that its block is in.
    meets = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1),
        lambda j: F.least(j, F.col("_block")) * F.col("_blocks") + F.greatest(j, F.col("_block")),
    )
    columns = ["_centre", "_pair", "_blocks", "_block", "_node", "_root", "_j", "_sample", "_vector"]
    work = dealt.withColumn("_pair", F.explode(meets)).select(*columns).repartition("_centre", "_pair").sortWithinPartitions("_centre", "_pair")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        """All pairs of rows of one piece of work: rows that stand s apart, for s = 1, 2, ..."""
        sample, block, j = _matrix(frame["_sample"]), frame["_block"].to_numpy(), frame["_j"].to_numpy()
        nodes, vectors = frame["_node"].to_numpy(), frame["_vector"].to_numpy()
        own = frame["_pair"].iloc[0] % (frame["_blocks"].iloc[0] + 1) == 0  # a block with itself
        root = pd.factorize(frame["_root"])[0]
        unpacked: dict[int, tuple] = {}
        out = []
        for step in range(1, len(frame)):
            use = (root[:-step] != root[step:]) & (np.abs(j[:-step] - j[step:]) <= 1 - similarity + 1e-6)
            if not own:
                use &= block[:-step] != block[step:]
            a = np.flatnonzero(use)
            a = a[_agreement(sample[a], sample[a + step]) >= AGREE]
            for x, y in zip(a.tolist(), (a + step).tolist()):
                if root[x] == root[y]:
                    continue
                for k in (x, y):
                    if k not in unpacked:
                        unpacked[k] = _unpacked(vectors[k])
                if _similarity(unpacked[x], unpacked[y]) >= similarity:
                    out.append((nodes[x], nodes[y]))
                    root[root == root[y]] = root[x]
        return pd.DataFrame(out, columns=["_a", "_b"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for frame in frames:
            new = (frame["_pair"] != frame["_pair"].shift()) | (frame["_centre"] != frame["_centre"].shift())
            for _, piece in frame.groupby(new.cumsum(), sort=False):
                if rest and (rest[0]["_pair"].iloc[0] != piece["_pair"].iloc[0] or rest[0]["_centre"].iloc[0] != piece["_centre"].iloc[0]):
                    yield compare(pd.concat(rest, ignore_index=True))
                    rest = []
                rest.append(piece)
        if rest:
            yield compare(pd.concat(rest, ignore_index=True))

    return work.mapInPandas(trimmed(run), "_a binary, _b binary")


def near_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``group_id`` (least id of its group), ``group_size`` (rows), ``kept``.

    Groups are the connected parts of all pairs of similarity ``similarity`` or more, equal texts included; kept is one
    row of each, that of the least id. Null and empty texts are equal to each other and near no other; so is a text
    without words. Ids that repeat are rows of their own; a null id names a group only if it has no other.
    """
    source = docs.select("doc_id", "text")
    weights = document_frequencies(source)
    signed = written(signatures(source, weights), "signed")
    nodes = signed.groupBy("_node").agg(F.min("doc_id").alias("_id"), F.count("*").alias("_n"), F.min("_sample").alias("_sample"), F.min("_bands").alias("_bands"))
    banded = nodes.select("_node", F.explode("_bands").alias("_bucket"))
    shared = banded.groupBy("_bucket").agg(F.min("_node").alias("_centre"), F.count("*").alias("_size")).filter("_size > 1")
    members = banded.join(shared.select(F.col("_bucket").alias("_k"), "_centre"), F.col("_bucket") == F.col("_k")).filter("_node <> _centre")
    stars = members.groupBy(F.col("_centre").alias("_a"), F.col("_node").alias("_b")).agg(F.count("*").alias("_bands"))
    stars = written(stars, "stars")
    wanted = stars.select(F.col("_a").alias("_node")).union(stars.select(F.col("_b").alias("_node"))).distinct()
    vectors = written(_vectors(wanted, source.withColumn("_node", _digest("text")), weights), "vectors")
    closest = stars.groupBy("_b").agg(F.max(F.struct("_bands", "_a")).alias("_best")).select("_best._a", "_b")
    measured = _measured(closest, vectors)
    links = measured.filter(F.col("_j") >= similarity).select("_a", "_b")
    roots = components(links)
    others = _measured(_apart(stars, roots).join(measured, ["_a", "_b"], "left_anti"), vectors)
    roots = _joined(roots, others.filter(F.col("_j") >= similarity).select("_a", "_b"))
    stars = measured.union(others)
    more = written(_more_links(stars, roots, nodes.select("_node", "_sample"), vectors, similarity), "more")
    if not more.isEmpty():
        roots = _joined(roots, more)
    placed = signed.select("doc_id", "_node").join(roots, "_node", "left").withColumn("_root", F.coalesce("_root", "_node"))
    placed = written(placed.withColumn("_row", F.monotonically_increasing_id()), "placed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), F.col("doc_id"), F.col("_row"))).alias("_first")
    groups = placed.groupBy(F.col("_root").alias("_r")).agg(first, F.count("*").alias("group_size"))
    joined = placed.join(groups, F.col("_root") == F.col("_r"))
    kept = F.col("_row") == F.col("_first._row")
    return joined.select("doc_id", F.col("_first.doc_id").alias("group_id"), "group_size", kept.alias("kept"), "_node")


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group."""
    plain = plainly(docs, "doc_id", "text")

    def key(node):
        return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), node)

    stay = near_groups(docs, similarity).filter("kept").select(key(F.lower(F.hex("_node"))).alias("_k"))
    keyed = plain.withColumn("_key", key(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    # Rows that are alike in id and text have one key; one of them stays.
    kept = keyed.join(stay, F.col("_key") == F.col("_k"), "left_semi").dropDuplicates(["_key"])
    return kept.select(*plain.columns).toDF(*docs.columns)
