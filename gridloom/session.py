"""Session defaults and the shared folder used to cut lineage and hand tables over."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "gridloom", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    A temporary folder is made only for a local master whose session names none;
    on a cluster a machine-local folder would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="gridloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a hand-over table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the stored rows."""
    shared = shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared)
    return df.checkpoint()


def task_count(spark: SparkSession) -> int:
    """Pieces to deal rows into: the session's shuffle partitions, or a few per core when the
    cores are known to be fewer."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if spark.sparkContext.master.startswith("local"):
        return min(parts, 4 * spark.sparkContext.defaultParallelism)
    return max(parts, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash a short driving table over all tasks before it is exploded into many rows.

    The partition count is given so that adaptive execution does not fold the few
    driving rows back into one task.
    """
    return df.repartition(task_count(df.sparkSession), *cols)


def balance(df: DataFrame) -> DataFrame:
    """Deal rows evenly over all tasks, whatever their keys.

    For rows that need no company but are about to be expanded: neither a crowded tile nor
    a run of copies ends up in one task.
    """
    return df.repartition(task_count(df.sparkSession))
