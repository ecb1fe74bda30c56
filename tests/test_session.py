"""Sessions that start away from the repository."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from loglantern import session
from loglantern.operators import ranking
{start}
rows = spark.range(50).select(F.lit("a").alias("kind"), (F.col("id") % 7).alias("at"))
found = ranking.newest_distinct(rows, "kind", ("at",), 3).distinct().orderBy(F.desc("at")).limit(3)
assert [r["at"] for r in found.collect()] == [6, 5, 4]
session.ship_package(spark)  # a second time changes nothing
assert len(spark.sparkContext.listFiles) == 1
"""

PLAIN = "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\nsession.ship_package(spark)"
BUILT = "spark = session.build_session('away', 'local[2]', spark__ui__enabled='false')"


def _run(folder, start):
    """In a process of its own, started in another folder, where only the driver knows the repository."""
    known = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    made = [sys.executable, "-c", SCRIPT.format(root=ROOT, start=start)]
    return subprocess.run(made, cwd=folder, env=known, capture_output=True, text=True, timeout=120)


def test_executors_get_the_package(tmp_path):
    for start in (BUILT, PLAIN):
        done = _run(tmp_path, start)
        assert done.returncode == 0, done.stderr[-2000:]
