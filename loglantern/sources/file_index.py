"""What each file of a table holds, kept beside the table, so that questions open only the files that can answer them.

Two tables lie in ``_files`` inside the table's folder (readers pass over names with an underscore):

- ``stats``, one row per file: rows, least and greatest time, and how many rows each fixed word list finds.
- ``tokens``, one row per file and run of letters (in lower case) that some message of the file holds.

A file counts as known once its ``stats`` row is there, which is written last. Files that aren't known yet are always
opened, and rows of files that are gone are passed over, so an index that lags behind costs time and never rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import taxonomy
from ..operators.ranking import newest_distinct, tie_breakers, top_per_group
from ..session import shared_dir
from .readers import path_exists

_FOLDER = "_files"
# Files opened at first for the newest rows; four times as many with each further try.
FIRST_FILES = 4
# Runs of letters within a message or a word that is looked for.
_TOKEN = r"\p{L}+"
# A scheme and an authority in front of a path.
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def _counted() -> dict[str, Column]:
    """The summary and severity counts of a file."""
    tests = {**taxonomy.flags("message", taxonomy.CATEGORY_WORDS, "is_"), **taxonomy.flags("message", taxonomy.SEVERITY_WORDS, "est_")}
    return {name: F.count_if(test) for name, test in tests.items()}


def _counts() -> list[str]:
    return [f"is_{name}" for name in taxonomy.CATEGORY_WORDS] + [f"est_{name}" for name in taxonomy.SEVERITY_WORDS]


def _stats_schema() -> T.StructType:
    out = T.StructType().add("file", "string").add("rows", "long").add("least", "timestamp").add("greatest", "timestamp")
    for name in _counts():
        out = out.add(name, "long")
    return out


_TOKENS = "token string, file string"


def _listed(spark: SparkSession, path: str) -> list[str]:
    """The data files of the table, the listing that any reader of the table makes."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, True)
    root, out = re.sub(_SCHEME, "", path).rstrip("/"), []
    while found.hasNext():
        name = found.next().getPath().toString()
        inside = re.sub(_SCHEME, "", name)[len(root) :]
        if inside.endswith(".parquet") and not any(part.startswith(("_", ".")) for part in inside.split("/")):
            out.append(name)
    return sorted(out)


def _plain(name: Column) -> Column:
    return F.regexp_replace(name, _SCHEME, "")


def _table(spark: SparkSession, path: str, name: str, schema) -> DataFrame:
    folder = f"{path}/{_FOLDER}/{name}"
    if not path_exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


def _files(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """``stats`` of the files that are there, with ``_path`` to open them by, and the files that aren't known."""
    listed = spark.createDataFrame([(name,) for name in _listed(spark, path)], "_path string")
    stats = _table(spark, path, "stats", _stats_schema()).dropDuplicates(["file"])
    joined = listed.join(stats, _plain(F.col("_path")) == F.col("file"), "left")
    unknown = [row["_path"] for row in joined.filter(F.col("file").isNull()).select("_path").collect()]
    return joined.filter(F.col("file").isNotNull()), unknown


def _open(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    return spark.read.option("basePath", path).parquet(*names)


def refresh(spark: SparkSession, path: str) -> int:
    """Takes new files of the table into its index and returns how many there were. Each is read once, by one job for
    its counts and one for its tokens; a run that was cut short is done again by the next."""
    _, unknown = _files(spark, path)
    if not unknown:
        return 0
    rows = _open(spark, path, unknown).select("timestamp", "message", _plain(F.col("_metadata.file_path")).alias("file"))
    letters = F.array_distinct(F.regexp_extract_all(F.lower("message"), F.lit(_TOKEN), F.lit(0)))
    tokens = rows.select("file", F.explode(letters).alias("token")).groupBy("token", "file").agg(F.lit(1)).select("token", "file")
    tokens.sortWithinPartitions("token").write.mode("append").option("compression", "zstd").parquet(f"{path}/{_FOLDER}/tokens")
    moment = F.col("timestamp").cast("timestamp")
    stats = rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("rows"), F.min(moment).alias("least"), F.max(moment).alias("greatest"), *[c.alias(n) for n, c in _counted().items()]
    )
    stats.write.mode("append").option("compression", "zstd").parquet(f"{path}/{_FOLDER}/stats")
    return len(unknown)


# -- counts -----------------------------------------------------------------------------------

def summary(spark: SparkSession, path: str) -> DataFrame:
    """Rows, first and last time and the counts of the fixed word lists (``is_``, ``est_``): sums over files, no message is read."""
    known, unknown = _files(spark, path)
    sums = known.select("rows", "least", "greatest", *_counts())
    if unknown:
        fresh = _open(spark, path, unknown).select(F.col("timestamp").cast("timestamp").alias("timestamp"), "message")
        counts = [c.alias(n) for n, c in _counted().items()]
        sums = sums.unionByName(fresh.agg(F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("least"), F.max("timestamp").alias("greatest"), *counts))
    total = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("rows", *_counts())]
    return sums.agg(*total, F.min("least").alias("least"), F.max("greatest").alias("greatest"))


# -- words ------------------------------------------------------------------------------------

def _word_test(word: str) -> tuple[list[str], list[str]]:
    """What a message that holds the word must hold: whole tokens, and parts of tokens."""
    word = word.lower()
    letters = "".join("a" if c.isalpha() else " " for c in word)
    runs = [m.span() for m in re.finditer("a+", letters)]
    whole = [word[a:b] for a, b in runs if a > 0 and b < len(word)]
    part = [word[a:b] for a, b in runs if a == 0 or b == len(word)]
    return whole, part


def files_with(spark: SparkSession, path: str, words: Sequence[str], within: DataFrame | None = None) -> DataFrame:
    """``_path`` of the known files that may hold one of the words (anywhere in a message, in any case), from the tokens alone.

    A word without letters may be in any file.
    """
    known = _files(spark, path)[0] if within is None else within
    tokens = _table(spark, path, "tokens", _TOKENS)
    tests = [_word_test(word) for word in words]
    if any(not whole and not part for whole, part in tests):
        return known.select("_path")
    flags = []
    for i, (whole, part) in enumerate(tests):
        needed = [F.col("token") == w for w in whole] + [F.col("token").contains(p) for p in part]
        flags.append(F.array(*[F.max(test) for test in needed]).alias(f"_w{i}"))
    every = [F.forall(f"_w{i}", lambda held: held) for i in range(len(tests))]
    found = tokens.groupBy("file").agg(*flags)
    any_word = every[0]
    for test in every[1:]:
        any_word = any_word | test
    hit = found.filter(any_word).select(F.col("file").alias("_hit"))
    return known.join(hit, F.col("file") == F.col("_hit"), "left_semi").select("_path")


def matching(spark: SparkSession, path: str, words: Sequence[str]) -> DataFrame:
    """All rows whose message holds one of the words; only files that may hold one are opened."""
    known, unknown = _files(spark, path)
    names = [row["_path"] for row in files_with(spark, path, words, known).collect()] + unknown
    if not names:
        return spark.read.parquet(path).limit(0)
    return _open(spark, path, names).filter(taxonomy.has_any("message", words))


# -- newest rows ------------------------------------------------------------------------------

def _next_files(files: DataFrame, opened: int, count: int) -> tuple[list[str], object | None]:
    """The ``count`` files behind the first ``opened`` ones, newest first, and the greatest time of all that follow."""
    order = files.orderBy(F.col("greatest").desc_nulls_last(), "file").select("_path", F.col("greatest").cast("string").alias("g"))
    rows = order.offset(opened).limit(count + 1).collect()
    return [row["_path"] for row in rows[:count]], rows[count]["g"] if len(rows) > count else None


def newest(spark: SparkSession, path: str, n: int, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The ``n`` newest rows that ``keep`` leaves, ties as ``ranking.newest`` has them.

    Files are opened by their greatest time, newest first, until the n-th row found is newer than all that is in the
    others: a row with a time far ahead costs its own file and no more.
    """
    known, unknown = _files(spark, path)
    shared_dir(spark)
    opened, count, held = 0, FIRST_FILES, None
    while True:
        names, beyond = _next_files(known, opened, count)
        fresh = names + (unknown if held is None else [])
        if fresh:
            rows = _open(spark, path, fresh)
            rows = keep(rows) if keep else rows
            rows = rows if held is None else rows.unionByName(held)
            order = [F.col("timestamp").desc(), *tie_breakers(rows, ["timestamp"])]
            held = rows.orderBy(*order).limit(n).checkpoint()
        if held is None:
            return spark.read.parquet(path).limit(0)
        opened, count = opened + len(names), 4 * count
        if beyond is None:
            return held
        size, last = held.agg(F.count(F.lit(1)), F.min(F.col("timestamp").cast("timestamp")) > F.lit(beyond).cast("timestamp")).first()
        if size == n and last:
            return held


def newest_hits(
    spark: SparkSession, path: str, lists: Mapping[str, Sequence[str]], n: int, columns: Sequence[str], keep: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """The ``n`` newest distinct rows (``columns``, the time first) of each word list: ``category``, the columns, ``rank``.

    As ``newest``, but each list ends by itself, and for a list that is still open only files that may hold one of its
    words count. So a list whose words are rare opens the files that hold them, not the table.
    """
    known, unknown = _files(spark, path)
    shared_dir(spark)
    order = [F.col(columns[0]).desc(), *[F.col(c).asc() for c in columns[1:]]]
    out = None
    for name, words in lists.items():
        files = known.join(files_with(spark, path, words, known).select(F.col("_path").alias("_may")), F.col("_path") == F.col("_may"), "left_semi")
        files = files.checkpoint()
        opened, count, held = 0, FIRST_FILES, None
        while True:
            names, beyond = _next_files(files, opened, count)
            fresh = names + (unknown if held is None else [])
            if fresh:
                rows = _open(spark, path, fresh)
                rows = (keep(rows) if keep else rows).filter(taxonomy.has_any("message", words)).select(F.lit(name).alias("category"), *columns)
                rows = rows if held is None else rows.unionByName(held)
                best = newest_distinct(rows, "category", columns, n).distinct()
                held = top_per_group(best, ["category"], order, n, salts=1).checkpoint()
            opened, count = opened + len(names), 4 * count
            if beyond is None:
                break
            size, last = held.agg(F.count(F.lit(1)), F.min(F.col(columns[0]).cast("timestamp")) > F.lit(beyond).cast("timestamp")).first()
            if size == n and last:
                break
        if held is not None:
            out = held if out is None else out.unionByName(held)
    if out is None:
        return spark.read.parquet(path).limit(0).select(F.lit("").alias("category"), *columns, F.lit(0).cast("long").alias("rank"))
    return top_per_group(out, ["category"], order, n, rank="rank", salts=1)
