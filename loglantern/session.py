"""Session defaults and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings that hold on a laptop and on a large cluster alike. The number of shuffle partitions is
# left to the caller; adaptive execution merges what turns out too small.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.enableVectorizedReader": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


# Applications whose executors have the package.
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the executors this package, so that its Python functions run wherever the driver was started.

    The sources go as one archive that the driver serves, once for each application. A package that was itself loaded
    from an archive has come that way already.
    """
    context, root = spark.sparkContext, Path(__file__).resolve().parent
    if context.applicationId in _shipped or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def build_session(app: str = "loglantern", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the defaults above, whose executors have the package; ``extra`` keys use ``__`` in place of dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    ship_package(session)
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of this machine, and that is then set as the
    checkpoint directory of the session too.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:  # named after the context had started
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    fallback = tempfile.mkdtemp(prefix="run-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    context.setCheckpointDir(fallback)
    return fallback


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other call has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
