"""Spark sessions for local runs, and settings that the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "wardline") -> SparkSession:
    """Session on this machine; on a cluster the session comes from the submitter."""
    partitions = str(cores) if cores != "*" else "8"
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(app)
             .config("spark.sql.shuffle.partitions", partitions)
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "12g")
             # No call sites per column expression: they dominate the making of large plans.
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return with_checkpoints(spark)


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """Use the shared checkpoint folder the cluster names; only a local run makes its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="wardline-")
    if folder is not None:
        spark.sparkContext.setCheckpointDir(folder)
    return spark


def stored(df: DataFrame) -> DataFrame:
    """Table written to the shared checkpoint folder, for a result that many steps read."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        with_checkpoints(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, which all executors share."""
    if spark.sparkContext.getCheckpointDir() is None:
        with_checkpoints(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
