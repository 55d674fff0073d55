"""Cutting the lineage of tables that several later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("Set spark.checkpoint.dir to a folder all executors share.")
        named = tempfile.mkdtemp(prefix="screenwright-")
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and go on from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


class Workspace:
    """Tables of one run, in a folder of its own below the one that all executors share.

    Stored tables are columnar, so a later step that needs few columns reads only those.
    The folder goes with ``close``, or at the end of a ``with`` block; until then all
    frames made from its tables can be used.
    """

    def __init__(self, spark: SparkSession, name: str = "run"):
        self.spark = spark
        context = spark.sparkContext
        base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or shared_folder(spark)
        self.folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4()}"
        self._tables = 0

    def store(self, df: DataFrame) -> DataFrame:
        """Write the rows and go on from the written table."""
        path = f"{self.folder}/{self._tables}"
        self._tables += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.close()
