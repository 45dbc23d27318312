"""Steps that are written once, so that later ones neither repeat them nor lose them with an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return shared or tempfile.mkdtemp(prefix="spark-")


def cut(df: DataFrame) -> DataFrame:
    """``df`` read from the checkpoint folder: the session's ``spark.checkpoint.dir``, or a temporary one in a local session."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of that name where driver and executors both write: beside the checkpoints of :func:`cut`."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(_folder(spark))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
