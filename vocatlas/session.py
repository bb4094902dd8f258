"""Storage that all executors share, and cutting of lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, and Spark's checkpoint folder.

    It is what ``spark.checkpoint.dir`` names. Only where that is unset and
    Spark runs in one local JVM, as in tests, a temporary folder serves.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="vocatlas-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Cut the lineage: the rows now come from the shared folder.

    At most ``tasks`` tasks write a file each. Without it there is a file for each shuffle partition, however few rows
    there are, and for each file Hadoop's local file system starts a process."""
    shared_dir(df.sparkSession)
    return (df if tasks is None else df.coalesce(tasks)).checkpoint(eager=True)
