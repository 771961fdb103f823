"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", app: str = "seasonwin") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as named in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own: on a cluster a
    machine-local path would be lost with its executor.
    """
    context = spark.sparkContext
    base = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if not base:
        # Executors of their own, as in local-cluster, may not see this process's folder.
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="seasonwin-"))
        base = context.getCheckpointDir()
    return base.rstrip("/")


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below one folder per application, which can go when the application ends."""
    application = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/seasonwin-{application}/{name}-{uuid.uuid4().hex}"


def pin(df: DataFrame, name: str) -> DataFrame:
    """Compute a small result once and read it back from the shared folder.

    For daily series, event tables and scans that several operators read: their
    source tables are then scanned once, a lost executor costs no recomputation,
    and the planner knows the true size. The shuffle files behind it go as soon
    as it is written, so that disks hold those of one step at a time.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
