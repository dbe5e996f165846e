"""Written tables that cut lineage, in the folder that the cluster names for checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset in local mode (tests), a folder of this run.

    On a cluster a local folder would be another one on each machine, so there the setting is needed.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Stage:
    """Tables of one run of an operator, each written once and read again from there."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/gridloom-{name}-{uuid.uuid4().hex}"
        self.count = 0

    def table(self, df: DataFrame, release: bool = False) -> DataFrame:
        """The frame, written and to be read from there.

        With ``release`` the shuffles that only led to it are deleted now: Spark deletes what
        the driver's heap no longer refers to, but only when that heap is collected.
        """
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        if release:
            self.spark._jvm.System.gc()
        read = self.spark.read.schema(df.schema).parquet(path)
        read._gridloom_path = path
        return read

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(df._gridloom_path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
