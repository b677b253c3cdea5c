"""Small session helpers shared by the jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; the path may be in any store that Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints that spark.checkpoint.dir names; with a local master a new temporary one will do.

    On a cluster without the setting this raises: a temporary folder would be a different one on every machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="panelkit-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of df through a file in the shared folder, which outlives any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage of df through a Parquet table beside the checkpoints; smaller than a checkpoint, and read by columns.

    The tables stay until the folder is cleared, as reliable checkpoints do by default.
    """
    df.write.parquet(path := f"{checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}")
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables between the steps of one job, in a folder of their own that goes when their last reader is done."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.count = spark, f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}", 0

    def written(self, df: DataFrame) -> DataFrame:
        """written() into the folder."""
        self.count += 1
        df.write.parquet(path := f"{self.folder}/{self.count}")
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Delete the folder, in whatever store it is; nothing may read its tables later."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
