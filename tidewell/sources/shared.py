"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where it is unset, one machine (tests) gets a temporary
    one; a cluster is refused, as its executors would each write to a disk of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        folder = tempfile.mkdtemp(prefix="tidewell-")
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there, with its real size.

    For tables that a loop joins to what was made of them: a checkpoint keeps the size that Spark had estimated, which such
    a loop squares at every step until the estimate itself takes longer than the work.
    """
    folder = f"{shared_folder(df.sparkSession)}/steps-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
