"""Session set-up and tables materialized in the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(
    cpus: int | str = "*", app: str = "feedloom", shared: str | None = None
) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    cores = "8" if cpus == "*" else str(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    return builder.getOrCreate()


@functools.cache
def _scratch_of_local_run() -> str:
    folder = tempfile.mkdtemp(prefix="feedloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a ``local`` master, whose executors live in this very process, may go
    without the setting; its folder goes when the process ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _scratch_of_local_run()


def run_folder(spark: SparkSession) -> str:
    """Where this application's tables lie in the shared folder; ``clear_run`` removes it."""
    return f"{shared_dir(spark)}/feedloom-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder (not created yet)."""
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clear_run(spark: SparkSession) -> None:
    """Remove all tables that this application has put in the shared folder for its own steps.

    For the end of an application: DataFrames built on those tables can't be read any more.
    """
    from feedloom.sources import files

    files.remove(spark, run_folder(spark))


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """A job's shuffle files are removed when it ends, not when Spark's cleaner finds them."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialize(
    df: DataFrame, path: str, partition_by: str | None = None, compression: str | None = None
) -> DataFrame:
    """Write ``df`` once and go on from the stored table.

    Unlike a cache this survives lost executors, and unlike an RDD checkpoint
    the plan runs once and later readers still prune columns (and folders of
    ``partition_by``). The shuffle files that led to it are of no more use and removed.
    """
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if compression:
        writer = writer.option("compression", compression)
    with _shuffles_removed(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
