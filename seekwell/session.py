"""Session settings and the durable cut of long lineages."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "seekwell", cpus: str | int | None = None) -> SparkSession:
    """A session for tests and benches. On a cluster, bring your own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # hash instead of sort where the measured build partitions are this small
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as `spark.checkpoint.dir` names it.

    Only a local-mode session may fall back to a temporary folder: there driver
    and executors are one process, so "shared" holds by itself.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="seekwell-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, for results that are large or dear: one run of the plan writes
    it, and readers take the columns that they need."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def durable(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and go on from the written copy.

    Losing executors afterwards costs a re-read, not a recomputation.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
