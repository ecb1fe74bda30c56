"""Repeated passages by previous and next smaller positions in the order of suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller ``doc_id``. Strings are
judged on the input. Of the longest previous factor of a place only whether it reaches ``LENGTH`` bytes matters, so
suffixes are ordered by that many bytes, in parts:

1. Each string of ``LENGTH`` bytes belongs to the least hash of the ``GRAM``-byte strings in it. Strings that are equal
   have the same one, and neighbouring strings mostly share theirs, so they travel as one stretch of text.
2. A first pass finds the hashes that occur in different texts. Only stretches of those can matter; a bitmap of fixed size
   keeps most others back. It only saves work: a hash that passes by chance costs a stretch, none is held back wrongly.
3. Stretches are dealt by their hash. A task puts their suffixes in order. Where neighbours share fewer than ``LENGTH``
   bytes a run ends. A place has a factor of ``LENGTH`` bytes from an earlier document if its run holds a smaller one
   before it or after it in suffix order; which of them is nearest makes no difference to a length that is cut there.
   A hash with more than ``HOT`` stretches is not dealt as one: where texts are read, strings that an earlier document of
   the same slice has are told at once, and the others go on as single strings, dealt by a hash of their own.
4. The spans that are covered are cut out of the texts, so the first copy stays.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from loglantern.llm import texts
from loglantern.llm.frames import written

LENGTH = 50
GRAM = 24
# Bits of the places in the bitmap: 16 MB, however much text there is.
BITMAP_BITS = 27
# Text bytes whose stretches one group takes.
PART_BYTES = 4 << 20
# Stretches of one hash that one group takes; a passage in more texts is dealt by its strings.
HOT = 10_000
_LAST = np.iinfo(np.int64).max


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash, start and end (in ``data``) of the stretches; each string of ``LENGTH`` bytes lies in exactly one."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none.astype(np.uint64), none, none
    sums = texts.prefix_hash(data)
    n = len(data) - GRAM + 1
    least = texts.mix((sums[GRAM:] - sums[:-GRAM]) * texts.powers(len(sums), True)[:n])
    width, reach = LENGTH - GRAM + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    # One least hash for each string; those that cross a row's end are left out.
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    inside = np.arange(len(least)) + LENGTH <= offsets[1:][row]
    at = np.flatnonzero(inside)
    if not len(at):
        return none, none.astype(np.uint64), none, none
    new = np.ones(len(at), bool)
    new[1:] = (least[at[1:]] != least[at[:-1]]) | (row[at[1:]] != row[at[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    # Least hashes are small numbers; spread anew, their first bits deal them evenly.
    return row[at[first]], texts.mix(least[at[first]]), at[first], at[last] + LENGTH


def _source(docs: DataFrame) -> DataFrame:
    """``_id`` (null: after all others), ``_node`` (64 bits of the digest of the text) and ``_text``."""
    text = F.coalesce("text", F.lit(""))
    node = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(_LAST))).alias("_id"), node.alias("_node"), text.alias("_text"))


def _firsts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Of equal texts in a batch the one with the least id."""
    frame = pd.DataFrame({"id": batch.column(0).to_numpy(), "node": batch.column(1).to_numpy()})
    keep = np.sort(frame.sort_values("id", kind="stable").drop_duplicates("node").index.to_numpy())
    return batch if len(keep) == len(frame) else batch.take(pa.array(keep))


def _groups(order: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of equal ``part`` along ``order``."""
    sorted_ = part[order]
    cuts = np.flatnonzero(np.diff(sorted_)) + 1
    for members in np.split(order, cuts) if len(order) else []:
        yield int(part[members[0]]), members


def shared_hashes(source: DataFrame, bits: int, hot: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """The bitmap of the hashes that occur in different texts, by their first ``BITMAP_BITS`` bits, and the hot hashes.

    Hot are those that more than ``hot`` texts have; of these the first 56 bits, in order. A batch sends two texts of a hash
    at most, and the count of the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch, hashes, tags = _firsts(whole), [], []
            nodes = batch.column(1).to_numpy()
            for first, _, data, offsets in texts.byte_slices(batch.column(2)):
                row, least, _, _ = stretches(data, offsets)
                hashes.append(least)
                tags.append(nodes[first + row])
            if not hashes:
                continue
            least, tag = np.concatenate(hashes), np.concatenate(tags).astype(np.uint64)
            order = np.lexsort((tag, least))
            twin = np.zeros(len(order), bool)  # the same hash again in the same text
            twin[1:] = (least[order][1:] == least[order][:-1]) & (tag[order][1:] == tag[order][:-1])
            order = order[~twin]
            ordered = least[order]
            third = np.zeros(len(order), bool)
            third[2:] = ordered[2:] == ordered[:-2]
            many, others = np.unique(ordered[third], return_counts=True)
            parts, counts = [], []
            for part, members in _groups(np.arange(len(many)), (many >> np.uint64(64 - bits)).astype(np.int64)):
                counts.append((many[members] >> np.uint64(8)).astype("<u8").tobytes() + others[members].astype("<i8").tobytes())
                parts.append(part)
            if parts:
                sent = [pa.array(parts, pa.int64()), pa.nulls(len(parts), pa.binary()), pa.array(counts, pa.binary())]
                yield pa.RecordBatch.from_arrays(sent, names=["part", "entries", "others"])
            order = order[~third]
            parts, payloads = [], []
            for part, members in _groups(order, (least >> np.uint64(64 - bits)).astype(np.int64)):
                short = (least[members] >> np.uint64(8)) & np.uint64(0xFFFFFFFFFFFF)
                payloads.append(short.astype("<u8").view("<u2").reshape(-1, 4)[:, :3].tobytes() + tag[members].astype("<u8").view("<u2").reshape(-1, 4)[:, :3].tobytes())
                parts.append(part)
            for k in range(0, len(parts), 512):
                sent = [pa.array(parts[k : k + 512], pa.int64()), pa.array(payloads[k : k + 512], pa.binary())]
                yield pa.RecordBatch.from_arrays([*sent, pa.nulls(len(sent[0]), pa.binary())], names=["part", "entries", "others"])

    def wide(raw: np.ndarray) -> np.ndarray:
        out = np.zeros((len(raw) // 6, 4), "<u2")
        out[:, :3] = raw.view("<u2").reshape(-1, 3)
        return out.view("<u8").ravel()

    places = 1 << (BITMAP_BITS - bits)

    def shared(group: pd.DataFrame) -> pd.DataFrame:
        part = int(group["part"].iloc[0])
        halves = [np.frombuffer(e, np.uint8).reshape(2, -1) for e in group["entries"] if e is not None]
        least, tag = wide(np.concatenate([h[0] for h in halves])), wide(np.concatenate([h[1] for h in halves]))
        order = np.lexsort((tag, least))
        least, tag = least[order], tag[order]
        differ = (least[1:] == least[:-1]) & (tag[1:] != tag[:-1])
        # Bits 8 to 55 of the hash are at hand, and the part has the first ones.
        full = (np.uint64(part) << np.uint64(64 - bits)) | (least[1:][differ] << np.uint64(8))
        flags = np.zeros(places, bool)
        flags[(full >> np.uint64(64 - BITMAP_BITS)).astype(np.int64) & (places - 1)] = True
        # Texts of each hash: those that were sent, and those that were only counted.
        sums = [np.frombuffer(e, "<u8").reshape(2, -1) for e in group["others"] if e is not None]
        sent = (np.uint64(part) << np.uint64(56 - bits)) | least
        counted = np.concatenate([sent, *(x[0] for x in sums)])
        counts = np.concatenate([np.ones(len(sent), np.int64), *(x[1].astype(np.int64) for x in sums)])
        hashes, place = np.unique(counted, return_inverse=True)
        hot_ = hashes[np.bincount(place, counts, len(hashes)) > hot]
        return pd.DataFrame({"part": [part], "flags": [np.packbits(flags).tobytes()], "hot": [hot_.astype("<u8").tobytes()]})

    sent = source.mapInArrow(run, "part long, entries binary, others binary")
    found = sent.groupBy("part").applyInPandas(shared, "part long, flags binary, hot binary").toPandas()
    bitmap = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    step = places // 8
    for part, flags in zip(found["part"], found["flags"]):
        bitmap[part * step : (part + 1) * step] = np.frombuffer(flags, np.uint8)
    return bitmap, np.sort(np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(h, "<u8") for h in found["hot"])]))


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
    return (bitmap[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return data[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def has_smaller(run: np.ndarray, document: np.ndarray) -> np.ndarray:
    """Whether a smaller document lies before or after each place of a suffix order within its run.

    ``run`` numbers the runs of suffixes that share ``LENGTH`` bytes, in ascending order; ``document`` numbers the documents
    from 0. Runs are moved apart, so that a running minimum of the whole order starts anew with each.
    """
    apart = (document.max() + 1 if len(document) else 1) * run
    previous = np.minimum.accumulate(document - apart) + apart
    following = np.minimum.accumulate((document + apart)[::-1])[::-1] - apart
    return np.minimum(previous, following) < document


def _earlier(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretch, and first and last place in it, of the runs of strings that an earlier document has too."""
    count = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(sizes)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[owner] + place
    document = np.unique(ids, return_inverse=True)[1]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    # The words of 8 bytes that start at each place, most significant byte first.
    word = np.zeros(len(data), np.uint64)
    for j in range(8):
        word |= padded[j : j + len(data)].astype(np.uint64) << np.uint64(56 - 8 * j)
    steps = [*range(0, LENGTH - 8, 8), LENGTH - 8]
    # Suffix order: by the first word, and then, where that is equal, by one word after the other.
    order = np.argsort(word[at], kind="stable")
    rank = np.zeros(len(order), np.int64)
    rank[1:] = np.cumsum(word[at[order[1:]]] != word[at[order[:-1]]])
    for step in steps[1:]:
        alike = np.zeros(len(order), bool)
        alike[1:] = rank[1:] == rank[:-1]
        alike[:-1] |= alike[1:].copy()
        order, rank = order[alike], rank[alike]  # a string that is alone has no equal
        if not len(order):
            break
        value = word[at[order] + step]
        by = np.lexsort((value, rank))
        order, rank, value = order[by], rank[by], value[by]
        new = np.ones(len(order), bool)
        new[1:] = (rank[1:] != rank[:-1]) | (value[1:] != value[:-1])
        rank = np.cumsum(new)
    none = np.zeros(0, np.int64)
    if not len(order):
        return none, none, none
    late = np.sort(order[has_smaller(rank, document[owner[order]])])
    if not len(late):
        return none, none, none
    new = np.ones(len(late), bool)
    new[1:] = (late[1:] != late[:-1] + 1) | (owner[late[1:]] != owner[late[:-1]])
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(late)) - 1
    return owner[late[start]], place[late[start]], place[late[end]]


def _single(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray, np.ndarray]:
    """What :func:`_earlier` finds among these stretches, and of all other strings stretch, place in it and hash."""
    late = _earlier(data, begin, sizes, ids)
    count = sizes - LENGTH + 1
    before = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(sizes)), count)
    place = np.arange(len(owner)) - before[owner]
    steps = np.zeros(len(owner) + 1, np.int64)
    np.add.at(steps, before[late[0]] + late[1], 1)
    np.add.at(steps, before[late[0]] + late[2] + 1, -1)
    left = np.cumsum(steps[:-1]) == 0
    owner, place = owner[left], place[left]
    start = begin[owner] + place
    return late, owner, place, texts.mix(texts.span_hash(texts.prefix_hash(data), start, start + LENGTH))


def dealt(source: DataFrame, bitmap: np.ndarray, bits: int, hot: np.ndarray) -> DataFrame:
    """``part`` with packed ``stretches`` that have to be compared, or with ``ranges`` that are known to be covered."""
    shared = source.sparkSession.sparkContext.broadcast((bitmap, hot))

    def ranges(node: np.ndarray, *fields: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Ranges that are known already, dealt by text."""
        part = (texts.mix(node.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
        parts, payloads = [], []
        for p, m in _groups(np.argsort(part, kind="stable"), part):
            parts.append(p)
            payloads.append(b"".join(f[m].astype("<i8").tobytes() for f in (node, *fields)))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.nulls(len(parts), pa.binary()), pa.array(payloads, pa.binary())], names=["part", "stretches", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = _firsts(whole)
            ids, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, _, data, offsets in texts.byte_slices(batch.column(2)):
                row, least, start, end = stretches(data, offsets)
                use = _has(shared.value[0], least)
                row, least, start, end = row[use], least[use], start[use], end[use]
                split = np.isin(least >> np.uint64(8), shared.value[1]) if len(shared.value[1]) else np.zeros(len(least), bool)
                if split.any():
                    r, at = row[split], start[split]
                    (of, a, b), owner, place, hashes = _single(data, at, end[split] - at, ids[first + r])
                    at -= offsets[r]
                    yield from ranges(nodes[first + r[of]], ids[first + r[of]], at[of] + a, at[of] + b + LENGTH)
                    begin = start[split][owner] + place
                    row, least = np.concatenate([row[~split], r[owner]]), np.concatenate([least[~split], hashes])
                    start, end = np.concatenate([start[~split], begin]), np.concatenate([end[~split], begin + LENGTH])
                parts, payloads = [], []
                for part, m in _groups(np.argsort(least), (least >> np.uint64(64 - bits)).astype(np.int64)):
                    fields = [least[m].view(np.int64), nodes[first + row[m]], ids[first + row[m]], start[m] - offsets[row[m]], end[m] - start[m]]
                    raw = np.int64(len(m)).tobytes() + b"".join(f.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for f in fields)
                    raw += _gather(data, start[m], end[m] - start[m]).tobytes()
                    payloads.append(np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True))
                    parts.append(part)
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(payloads, pa.binary()), pa.nulls(len(parts), pa.binary())], names=["part", "stretches", "ranges"])

    return source.mapInArrow(run, "part long, stretches binary, ranges binary")


def _unpack(payload: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    raw = pa.decompress(payload[8:], int.from_bytes(payload[:8], "little"), "zstd", asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    fields = [np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8 + 8 * n * i).reshape(8, n).T).view("<i8").ravel() for i in range(5)]
    return fields, np.frombuffer(raw, np.uint8, offset=8 + 40 * n)


def covered(source: DataFrame, bitmap: np.ndarray, bits: int, hot: np.ndarray) -> DataFrame:
    """``_node``, ``_id``, ``_from``, ``_to``: bytes of a text that strings of earlier documents cover. Ranges may overlap."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        known = [np.frombuffer(r, "<i8").reshape(4, -1) for r in group["ranges"] if r is not None]
        told = pd.DataFrame(dict(zip(("_node", "_id", "_from", "_to"), np.concatenate([np.zeros((4, 0), np.int64), *known], axis=1))))
        pieces = [_unpack(p) for p in group["stretches"] if p is not None]
        if not pieces:
            return told
        least, node, ids, start, size = (np.concatenate([p[0][i] for p in pieces]) for i in range(5))
        data = np.concatenate([p[1] for p in pieces])
        begin = np.cumsum(size) - size
        # Hashes of one text only came through by chance.
        frame = pd.DataFrame({"least": least, "node": node})
        low, high = frame.groupby("least")["node"].transform("min").to_numpy(), frame.groupby("least")["node"].transform("max").to_numpy()
        use = np.flatnonzero(low != high)
        of, a, b = _earlier(data, begin[use], size[use], ids[use])
        at = use[of]
        return pd.concat([told, pd.DataFrame({"_node": node[at], "_id": ids[at], "_from": start[at] + a, "_to": start[at] + b + LENGTH})])

    return dealt(source, bitmap, bits, hot).groupBy("part").applyInPandas(compare, "_node long, _id long, _from long, _to long")


def repeated_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``_node``, ``_id`` and ``_spans``, the maximal runs of bytes to remove, of texts that have any.

    Copies of a text are not spelled out: a copy with a larger id goes as a whole, see :func:`without_repeats`.
    """
    source = _source(docs)
    total = source.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    bits = min(max(math.ceil(math.log2(max(total, 1) / PART_BYTES)), 8), BITMAP_BITS - 3)
    bitmap, crowded = shared_hashes(source, bits, hot)
    ranges = covered(source, bitmap, bits, crowded)
    merged = ranges.groupBy("_node", "_id").agg(F.sort_array(F.collect_list(F.struct("_from", "_to"))).alias("_ranges"))
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in batch.column(2).to_pylist():
                spans: list[list[int]] = []
                for r in found:
                    if spans and r["_from"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r["_to"])
                    else:
                        spans.append([r["_from"], r["_to"]])
                out.append([x for s in spans for x in s])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["_node", "_id", "_spans"])

    return merged.mapInArrow(merge, "_node long, _id long, _spans array<long>")


def without_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per row of ``docs``: doc_id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``spans`` (from, to, from, to, ...).

    Null counts as the empty text; texts under ``LENGTH`` bytes lose nothing. A null id comes after all others. Rows that
    share an id are no earlier than each other.
    """
    spans = written(repeated_spans(docs.select("doc_id", "text"), hot), "spans")
    source = docs.select("doc_id", "text")
    keyed = _source(source).withColumn("doc_id", F.when(F.col("_id") == int(_LAST), F.lit(None)).otherwise(F.col("_id")))
    # All rows without their text; the text only meets the spans of texts that have some.
    rows = keyed.select("doc_id", "_id", "_node", F.octet_length("_text").cast("long").alias("n_bytes"), F.sha2(F.col("_text").cast("binary"), 256).alias("_sha"))
    rows = written(rows, "rows")
    least = rows.groupBy(F.col("_node").alias("_n")).agg(F.min("_id").alias("_least"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, removed = [], []
            for text, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                raw, at, kept = text.encode(), 0, hashlib.sha256()
                for a, b in zip(found[::2], found[1::2]):
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                digest.append(kept.hexdigest())
                removed.append(sum(found[1::2]) - sum(found[::2]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(3), pa.array(removed, pa.int64()), pa.array(digest)], names=["_n", "_i", "spans", "_removed", "_kept"])

    found = spans.select(F.col("_node").alias("_n"), F.col("_id").alias("_i"), "_spans")
    # A text with spans is cut once for each different id it has them for; other rows of it are copies.
    firsts = keyed.join(found, (F.col("_node") == F.col("_n")) & (F.col("_id") == F.col("_i"))).select("_node", "_id", "_text", "_spans")
    done = firsts.mapInArrow(cut, "_n long, _i long, spans array<long>, _removed long, _kept string").dropDuplicates(["_n", "_i"])
    joined = rows.join(least, F.col("_node") == F.col("_n")).drop("_n")
    joined = joined.join(done, (F.col("_node") == F.col("_n")) & (F.col("_id") == F.col("_i")), "left")
    copy = (F.col("_id") > F.col("_least")) & (F.col("n_bytes") >= LENGTH)
    some = F.col("_kept").isNotNull()
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).when(some, F.col("_removed")).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, 1).when(some, F.size("spans") / 2).otherwise(0).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).when(some, F.col("_kept")).otherwise(F.col("_sha")).alias("kept_sha256"),
        F.when(copy, F.array(F.lit(0).cast("long"), F.col("n_bytes"))).otherwise(F.coalesce("spans", F.array().cast("array<bigint>"))).alias("spans"),
    )
