"""Helpers of the evaluators."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="relgrove-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where that is unset in local mode one of this machine."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (configured or _own_folder()).rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path for new tables in the shared folder, which Hadoop deletes with all below it when the driver ends."""
    parent = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(parent)
    files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(hadoop_path)  # only what is there can be marked
    files.deleteOnExit(hadoop_path)
    return f"{parent}/table"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder and read again, so that plans stay short and lost executors cost no more than a read.

    A table, not a checkpoint: a checkpoint keeps constraints of the plan that
    made it, which may name columns that it doesn't have and break unions of it.
    """
    path = new_folder(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def union_of(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def marked(df: DataFrame) -> tuple:
    """Rows and checksum: equal for equal sets of rows."""
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64(*df.columns), F.lit(1 << 40)))).first())
