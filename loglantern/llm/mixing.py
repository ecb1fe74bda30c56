"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Each source gets a target of words: its share by weight, at most ``CAP`` times its size, the excess shared anew.
2. Its rows, in an order that a keyed hash gives, are cut into blocks of about ``BLOCK_WORDS`` words. Its quota is a number
   of blocks: every block once if the target is above the size, then blocks in the order of another hash as long as they fit,
   and at last one block in part, whose rows bring the words near the target.
3. The exact quota of each source is split among the output shards: a tree halves the shards, and at each node the
   blocks of the left half are drawn from a multivariate hypergeometric distribution.
4. Each shard draws its blocks, no two shards the same, from a permutation of the source's blocks, and shuffles its rows.

``mix_plan`` counts what the shards of all leaves draw; ``mixed`` gives their rows.
Every draw depends only on the seed and the rows, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from loglantern.llm.frames import plainly, trimmed, written

WEIGHTS = (3, 1, 2)
# Words of the mix for each word of the input, as a fraction.
SHARE = (3, 2)
# A target is at most so many times the size of its source.
CAP = 2
SEED = 20_240
# Rows of a part of a source that one task puts in order.
PART_ROWS = 50_000
BLOCK_WORDS = 20_000
# Words of a shard, more where there would be more than so many shards.
SHARD_WORDS = 2_000_000
MOST_SHARDS = 100_000
# Passes that fill what the row or block at the cut leaves open with smaller ones.
FILLS = 3
# The number that stands for a block drawn in part.
TRIMMED = -1
# Sources of more bytes than this aren't broadcast but joined under so many numbers.
BROADCAST_BYTES = 16 * 2**20
SALTS = 32

_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")


def _ranked(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``_rank``: the place of each source by code point from 0, null last.

    Sources are sorted in ranges. A place is that within its range behind all the ranges before, of which only the
    number of rows is summed: one row for each range.
    """
    at = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    ordered = sizes.orderBy(F.col("_source").asc_nulls_last()).select("*", F.spark_partition_id().alias("_range"), at.alias("_at"))
    ordered = written(ordered, "ranked")
    earlier = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ordered.groupBy(F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    ahead = ranges.select("_r", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_ahead"))
    joined = ordered.join(F.broadcast(ahead), F.col("_range") == F.col("_r"))
    return joined.withColumn("_rank", F.col("_ahead") + F.col("_at")).drop("_range", "_at", "_r", "_ahead")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, cap: int = CAP) -> DataFrame:
    """``_source``, ``_source_size`` and ``_target`` from one row for each source (``_source``, ``_source_size``).

    Sources take the weights in turn, by code point, null last. Sources without words get 0. Ranks come from a sort in
    ranges, and each round of sharing anew is one total; no task sees all sources.
    """
    turn = F.pmod("_rank", F.lit(len(weights))).cast("int")
    own = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), turn + 1).cast("long")
    # Stored: the rounds below read it again and again.
    open_ = written(_ranked(sizes).select("_source", "_source_size", own.alias("_weight")), "sources")
    total = open_.agg(F.sum("_source_size")).first()[0] or 0
    wanted = share[0] * total / share[1]
    rate = 0.0
    # Sources at their cap stay there, as the rate only grows: each round fills some more or is the last.
    capped = F.col("_source_size") == 0
    while True:
        full, weight = open_.agg(
            F.sum(F.when(capped, cap * F.col("_source_size")).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("_weight")))
        ).first()
        if not weight:
            break
        rate = (wanted - full) / weight
        over = capped | (F.col("_weight") * F.lit(rate) > cap * F.col("_source_size"))
        if not open_.filter(over & ~capped).limit(1).count():
            break
        capped = over
    target = F.when(capped, (cap * F.col("_source_size")).cast("double")).otherwise(F.col("_weight") * F.lit(float(rate)))
    return open_.select("_source", "_source_size", target.alias("_target"))


def _interval(parts: Column) -> Column:
    """Number of the part that ``_order`` falls in, of ``parts`` intervals of the order."""
    share = (F.shiftright(F.col("_order"), 32) + F.lit(2**31)).cast("double") / F.lit(float(2**32))
    return F.floor(share * F.greatest(F.ceil(parts), F.lit(1))).cast("long")


def _before(rows: DataFrame, size: Column) -> DataFrame:
    """``rows`` with ``_before``: sum of ``size`` over the rows of the same source that come earlier in its order.

    A source is cut into parts by ranges of the hash, so that its rows are never all in one task: totals by part are
    summed over the parts, and rows within their part.
    """
    totals = rows.groupBy("_key", "_part").agg(F.sum(size).alias("_words"))
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col("_key").alias("_k"), F.col("_part").alias("_p"), F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_start")
    )
    within = Window.partitionBy("_key", "_part").orderBy("_order", "_row").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_within", F.coalesce(F.sum(size).over(within), F.lit(0)))
    joined = summed.join(starts, (F.col("_key") == F.col("_k")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("_before", F.col("_start") + F.col("_within")).drop("_within", "_start", "_k", "_p")


def fill(rows: DataFrame, fills: int = FILLS) -> DataFrame:
    """``rows`` with ``_more``, whether each is taken, and ``_room`` reduced by what its source takes.

    Rows have ``_key`` (source), ``_part``, ``_order`` (hash), ``_row``, ``_size`` and ``_room``, which is the same for all
    rows of a source. They are taken in order as long as they fit, and again from those left over what fits in the room
    that remains.
    """
    rows = rows.withColumn("_more", F.lit(False))
    for k in range(fills):
        fits = ~F.col("_more") & (F.col("_size") > 0) & (F.col("_size") <= F.col("_room"))
        counted = _before(rows, F.when(fits, F.col("_size")).otherwise(0))
        marked = counted.withColumn("_now", fits & (F.col("_before") + F.col("_size") <= F.col("_room")))
        used = marked.filter("_now").groupBy(F.col("_key").alias("_k")).agg(F.sum("_size").alias("_used"))
        marked = marked.join(used, F.col("_key") == F.col("_k"), "left")
        rows = marked.withColumn("_more", F.col("_more") | F.col("_now")).withColumn(
            "_room", F.col("_room") - F.coalesce(F.col("_used"), F.lit(0))
        )
        rows = written(rows.drop("_now", "_k", "_used", "_before"), f"fill{k}")
    return rows


def closest(rows: DataFrame) -> DataFrame:
    """Filled ``rows`` where each source takes one row more, the best for its room, if that brings the sum closer."""
    left = rows.filter(~F.col("_more") & (F.col("_size") > 0)).groupBy(F.col("_key").alias("_k"))
    best = left.agg(F.min(F.struct(F.abs(F.col("_size") - F.col("_room")).alias("_off"), "_order", "_row")).alias("_best"))
    joined = rows.join(best, F.col("_key") == F.col("_k"), "left")
    closer = (F.col("_row") == F.col("_best._row")) & (F.col("_best._off") < F.abs(F.col("_room")))
    return joined.withColumn("_more", F.col("_more") | F.coalesce(closer, F.lit(False))).drop("_k", "_best")


def split_quotas(quotas: Sequence[int], first: int, last: int, seed: int) -> Iterator[tuple[int, list[int]]]:
    """``(shard, blocks by source)`` for the shards from ``first`` up to ``last``, by halving.

    A half gets its share of the node's blocks, to within one, and which sources they come from is drawn from all
    blocks of the node at once, without replacement.
    """
    stack = [(first, last, np.asarray(quotas, np.int64))]
    while stack:
        a, b, q = stack.pop()
        if b - a == 1:
            yield a, q.tolist()
            continue
        middle = (a + b) // 2
        total = int(q.sum())
        left = total * (middle - a) // (b - a)
        rng = np.random.default_rng([seed, a, b])
        drawn = rng.multivariate_hypergeometric(q, left, method="marginals") if total else q
        stack += [(a, middle, drawn), (middle, b, q - drawn)]


def shard_ranges(blocks: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """``_key``, ``_shard``, ``_from``, ``_to``: which places of the permuted blocks of a source a shard draws.

    ``blocks`` has one row for each source (``_key``, ``_blocks``). The quotas of a node travel as one row; the top of the
    tree is split into nodes that are dealt to tasks, and each task splits its own down to the leaves.
    """
    node = blocks.agg(F.sort_array(F.collect_list(F.struct("_key", "_blocks"))).alias("_all"))
    middle = max(1, round(math.sqrt(shards)))
    schema = "_first long, _last long, _keys array<string>, _quotas array<long>"
    cuts = [shards * i // middle for i in range(middle + 1)]

    def top(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for keys, quotas in zip(frame["_keys"], frame["_quotas"]):
                for shard, q in split_quotas(list(quotas) if quotas is not None else [], 0, middle, seed):
                    yield pd.DataFrame({"_first": [cuts[shard]], "_last": [cuts[shard + 1]], "_keys": [list(keys)], "_quotas": [q]})

    def leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first, last, keys, quotas in frame.itertuples(index=False):
                for shard, q in split_quotas(list(quotas), first, last, seed + 1):
                    yield pd.DataFrame({"_key": list(keys), "_shard": shard, "_n": q})

    nodes = node.select(F.col("_all._key").alias("_keys"), F.col("_all._blocks").alias("_quotas"))
    nodes = nodes.mapInPandas(trimmed(top), schema).repartition(middle, "_first")
    found = nodes.mapInPandas(trimmed(leaves), "_key string, _shard long, _n long").filter("_n > 0")
    upto = Window.partitionBy("_key").orderBy("_shard").rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumn("_to", F.sum("_n").over(upto)).select("_key", "_shard", (F.col("_to") - F.col("_n")).alias("_from"), "_to")


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with a number, the size, the source and a place in the order for each row, stored.

    Rows that are alike in id and text may change places, which changes nothing.
    """
    order = F.xxhash64(F.col("doc_id"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")), F.lit(seed))
    key = F.concat(F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.lit("s")), F.coalesce("source", F.lit("")))
    extra = [word_count().alias("_size"), key.alias("_key"), order.alias("_order"), F.monotonically_increasing_id().alias("_row")]
    return written(docs.select("*", *extra), "sized")


def _beside(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with the columns of their source (stored, one row for each ``_k``).

    The sources are broadcast if their measured size is small; otherwise they are repeated under ``SALTS`` numbers, so
    that a source with many rows is joined in as many tasks.
    """
    size = sources.agg(F.sum(F.octet_length("_k") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(sources), F.col("_key") == F.col("_k")).drop("_k")
    salted = sources.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = (F.col("_key") == F.col("_k")) & (F.pmod("_row", F.lit(SALTS)) == F.col("_s"))
    return rows.join(salted, same).drop("_k", "_s")


def _in_blocks(sized: DataFrame, part_rows: int, block_words: int) -> DataFrame:
    """The stored rows without their text, with ``_source_size``, ``_target`` and ``_block``, stored.

    In the order of the hash, a block of a part ends where its words pass the next multiple of ``block_words``. Rows stay
    whole, so a row of many words may be most of a block.
    """
    slim = sized.select("doc_id", "source", "_size", "_key", "_order", "_row")
    by_source = slim.groupBy("source", "_key").agg(F.sum("_size").alias("_source_size"), F.count("*").alias("_n"))
    goal = targets(by_source.select(F.col("source").alias("_source"), "_source_size"))
    of = by_source.select(F.col("_key").alias("_k"), "_n", F.col("source").alias("_s")).join(goal, F.col("_s").eqNullSafe(F.col("_source")))
    of = written(of.select("_k", "_n", "_source_size", "_target"), "goals")
    parted = _beside(slim.drop("source"), of).withColumn("_part", _interval(F.col("_n") / part_rows))
    within = Window.partitionBy("_key", "_part").orderBy("_order", "_row").rowsBetween(Window.unboundedPreceding, -1)
    place = F.floor(F.coalesce(F.sum("_size").over(within), F.lit(0)) / block_words).cast("long")
    return written(parted.withColumn("_block", F.shiftleft("_part", 40) + place).drop("_part", "_n"), "rows")


def _draw(rows: DataFrame, part_rows: int, block_words: int, shard_words: int, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """What the shards draw: ``(dealt, picked, number of shards)``.

    ``dealt`` has ``_key``, ``_block``, ``_copy`` and ``_shard``, one row for each block drawn; block ``TRIMMED`` stands for
    the one block of its source that is drawn in part, whose rows are in ``picked`` (``_key``, ``_row``).
    """
    # As many as the source has blocks, about, in intervals of ``part_rows``.
    parts = F.col("_source_size") / (block_words * part_rows)
    passes = F.floor(F.col("_target") / F.col("_source_size")).cast("int")
    blocks = rows.filter("_size > 0").groupBy("_key", "_block").agg(
        F.sum("_size").alias("_size"), F.count("*").alias("_rows"), F.first("_source_size").alias("_source_size"), F.first("_target").alias("_target")
    )
    blocks = blocks.withColumn("_passes", passes).withColumn("_room", F.col("_target") - F.col("_passes") * F.col("_source_size"))
    blocks = blocks.withColumn("_order", F.xxhash64("_key", "_block", F.lit(seed))).withColumn("_row", F.col("_block"))
    filled = fill(written(blocks.withColumn("_part", _interval(parts)).drop("_target"), "blocks"))
    filled = filled.withColumn("_copies", F.col("_passes") + F.col("_more").cast("int"))

    # Of the blocks left over, the one of most rows is drawn in part: so large rows don't decide how near the target is.
    open_ = filled.filter(~F.col("_more") & (F.col("_room") > 0)).groupBy(F.col("_key").alias("_k"))
    cut = open_.agg(F.max_by(F.struct("_block", "_room", "_source_size"), F.struct("_rows", "_order", "_block")).alias("_cut"))
    cut = cut.select("_k", F.col("_cut._block").alias("_b"), F.col("_cut._room").alias("_room"))
    inside = rows.filter("_size > 0").join(cut, (F.col("_key") == F.col("_k")) & (F.col("_block") == F.col("_b")))
    inside = inside.select("_key", "_row", "_order", "_size", "_source_size", "_room", F.lit(0).cast("long").alias("_part"))
    picked = written(closest(fill(written(inside, "inside"))).filter("_more").select("_key", "_row", "_source_size"), "picked")

    whole = filled.filter("_copies > 0").select("_key", "_block", "_source_size", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
    some = picked.select("_key", F.lit(TRIMMED).cast("long").alias("_block"), "_source_size", F.lit(0).alias("_copy")).distinct()
    draws = whole.unionByName(some).withColumn("_order", F.xxhash64("_key", "_block", "_copy", F.lit(seed + 1)))
    draws = written(draws.withColumn("_row", F.col("_block")).withColumn("_part", _interval(CAP * parts)).drop("_source_size"), "draws")
    # The place of a draw among those of its source: the permutation of the blocks.
    placed = _before(draws, F.lit(1))
    words = filled.agg(F.sum(F.col("_size") * F.col("_copies"))).first()[0] or 0
    shards = max(1, math.ceil(words / max(shard_words, words / MOST_SHARDS)))
    ranges = shard_ranges(draws.groupBy("_key").agg(F.count("*").alias("_blocks")), shards, seed)
    places = ranges.select(F.col("_key").alias("_k"), "_shard", F.explode(F.sequence("_from", F.col("_to") - 1)).alias("_place"))
    dealt = placed.join(places, (F.col("_key") == F.col("_k")) & (F.col("_before") == F.col("_place")))
    return written(dealt.select("_key", "_block", "_copy", "_shard"), "dealt"), picked.drop("_source_size"), shards


def mix_plan(
    docs: DataFrame, seed: int = SEED, part_rows: int = PART_ROWS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """Per row of ``docs``: doc_id, ``size``, ``source_size``, ``target``, ``copies`` (in all shards) and ``taken`` (words).

    Null texts have size 0 and are never taken, nor are others without a word. A null source is a source of its own.
    """
    rows = _in_blocks(_sized(docs.select("doc_id", "text", "source"), seed), part_rows, block_words)
    dealt, picked, _ = _draw(rows, part_rows, block_words, shard_words, seed)
    whole = dealt.filter(F.col("_block") != TRIMMED).groupBy(F.col("_key").alias("_k"), F.col("_block").alias("_b")).agg(F.count("*").alias("_whole"))
    some = picked.join(dealt.filter(F.col("_block") == TRIMMED).select(F.col("_key").alias("_t")), F.col("_key") == F.col("_t"))
    counted = rows.join(whole, (F.col("_key") == F.col("_k")) & (F.col("_block") == F.col("_b")), "left")
    counted = counted.join(some.select(F.col("_row").alias("_r")), F.col("_row") == F.col("_r"), "left")
    copies = F.coalesce("_whole", F.lit(0)) + F.col("_r").isNotNull().cast("long")
    return counted.withColumn("_copies", F.when(F.col("_size") > 0, copies).otherwise(0)).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_copies").alias("copies"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


def mixed(docs: DataFrame, seed: int = SEED, part_rows: int = PART_ROWS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mix: rows of ``docs`` with all their columns, as often as they are taken, and ``_shard``.

    A shard's rows are together and in random order. An empty table gives an empty mix.
    """
    plain = plainly(docs, "doc_id", "text", "source")
    sized = _sized(plain, seed)
    rows = _in_blocks(sized, part_rows, block_words)
    dealt, picked, shards = _draw(rows, part_rows, block_words, shard_words, seed)
    of = dealt.select(F.col("_key").alias("_k"), F.col("_block").alias("_b"), "_copy", "_shard")
    whole = rows.filter("_size > 0").join(of, (F.col("_key") == F.col("_k")) & (F.col("_block") == F.col("_b")))
    some = picked.join(of.filter(F.col("_b") == TRIMMED), F.col("_key") == F.col("_k"))
    names = [F.col("_row").alias("_of"), "_copy", "_shard"]
    drawn = whole.select(*names).unionByName(some.select(*names))
    out = sized.select("_row", "_order", *plain.columns).join(drawn, F.col("_row") == F.col("_of"))
    out = out.select(*plain.columns, "_shard", F.xxhash64("_order", "_copy", "_shard").alias("_shuffle"))
    return out.repartition(shards, "_shard").sortWithinPartitions("_shard", "_shuffle").drop("_shuffle").toDF(*docs.columns, "_shard")
