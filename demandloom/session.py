"""Session settings and reliable materialisation."""

from __future__ import annotations

import gc
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this package wants. AQE coalesces small shuffle partitions, splits skewed
# join partitions and turns a join into a broadcast only after it has measured the side's size.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed side even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Checkpoint files go when the frames that need them are gone.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Beyond this many rows a deep page is cut from a distributed sort, not from a heap per task.
    "spark.sql.execution.topKSortFallbackThreshold": "1000000",
}


def build_session(app: str = "demandloom", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; fall back to a scratch folder in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="demandloom-checkpoint-")
    context.setCheckpointDir(folder)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per session, so their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_demandloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="demandloom-code-")) / "demandloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._demandloom_shipped = True


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into reliable storage and cut its lineage.

    Used where a result is read more than once (so the facts are scanned once) and where a
    partition number must stay fixed between two passes.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries built inside go when their query ends, not when the driver happens to collect garbage.

    For steps that materialise what they read again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Let the cleaner see which frames are gone, so that their checkpoint files and plans go now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partition over all shuffle partitions, for a step whose work outgrows its input.

    AQE merges small partitions by the bytes that enter a stage. Where a join multiplies rows, or Python
    or dozens of windows run per row, the session's number of partitions, or the cores if they are more,
    keeps every core busy.
    """
    session = df.sparkSession
    count = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    return df.repartition(count, *columns)

