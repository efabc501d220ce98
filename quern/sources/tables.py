"""Reading tables, and keeping intermediate ones in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A table of fewer bytes may be dealt to all cores before its texts are analysed; no larger one is ever shuffled for that.
SMALL_BYTES = 256 << 20


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A Parquet table of a directory, by any path that Spark reads."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """For work on each row that costs more than moving it: the rows of a small table dealt to all cores.

    A file of one row group is one task, however many cores there are. Larger tables stay as they are split.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(n) if size <= SMALL_BYTES and df.rdd.getNumPartitions() < n else df


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a session in one process may go without; it gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept as files in the shared folder, so that a lost executor loses none of them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
