"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (tests in local mode) a temporary folder of this machine is taken.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="relgrove-checkpoints-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that later plans don't recompute it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def own_folder(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared one, which Hadoop deletes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)  # only what is there can be marked
    files.deleteOnExit(folder)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A new folder in the shared one, deleted on leaving; what is read from it must be used up by then."""
    path = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as a Parquet table and read again."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def text_of(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def row_number_of_scan() -> Column:
    """A number for each row of a scan.

    The input must be a table (or a checkpoint): the split of its files, and so
    the numbers, are then the same each time the scan runs again. For tables of
    less than ``spark.sql.files.maxPartitionBytes`` a core, the split also
    depends on the number of cores; set ``spark.sql.files.minPartitionNum``
    where executors may come and go while such a table is read.
    """
    return F.monotonically_increasing_id()


def sized(df: DataFrame) -> DataFrame:
    """A thin table written to the shared folder, so that the planner knows its size and need not shuffle a large one for few rows."""
    return written(df, f"{own_folder(df.sparkSession, 'sized')}/rows")


def numbered(df: DataFrame, rid: str, numbers: DataFrame, keep: bool = True) -> DataFrame:
    """The rows of ``df`` whose number (long column ``rid``) is in the only column of ``numbers``, or without ``keep`` the others.

    The numbers become words of a bitmap, a row for each 64, so this table mostly
    is small enough for the planner to broadcast it, and ``df`` is not shuffled.
    """
    word, bits = free_name(df, "word"), free_name(df, "bits")
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n.bitwiseAND(F.lit(63)).cast("int"))
    n = F.col(numbers.columns[0])
    bitmap = sized(numbers.groupBy(F.shiftright(n, 6).alias(word)).agg(F.bit_or(bit(n)).alias(bits)))
    found = df.withColumn(word, F.shiftright(rid, 6)).join(bitmap, word, "inner" if keep else "left")
    there = F.coalesce(F.col(bits), F.lit(0)).bitwiseAND(bit(F.col(rid))) != 0
    return found.where(there if keep else ~there).drop(word, bits)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, or the first variant of it that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
