"""Where lineage is cut: checkpoints and tables in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and all tasks are on this machine."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not path and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-"))
    return (path or sc.getCheckpointDir().rsplit("/", 1)[0]).rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one."""
    return f"{shared(spark)}/gleaner-{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    shared(df.sparkSession)
    return df.checkpoint(eager=True)
