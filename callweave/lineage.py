"""Cuts of the lineage of iterative jobs: written to the folder all executors
share, so a lost executor costs no earlier round."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of Parquet that a task reads, and that make a partition of a shuffle more;
#: bytes of a shuffle that a task reads; how much larger rows are than their Parquet.
READ, SHARE, ADVISED, UNPACKED = 16 << 20, 4 << 20, 16 << 20, 16

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local folder
    does if there is one machine only; a cluster has to name a shared one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints"
    return found.rstrip("/")


def bounded_tasks(spark: SparkSession, path: str) -> None:
    """Settings of the session by which tasks grow in number, not in size, with
    what is at path: a shuffle has a partition for every SHARE bytes of it at least,
    of which Spark joins those that are small, and a task reads a bounded number of
    bytes. Spark takes a table's size for that of its Parquet, and would hand out
    millions of well-packed rows to the driver and all executors."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
    known = lambda name: spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    for name, most in (("spark.sql.files.maxPartitionBytes", READ), ("spark.sql.adaptive.advisoryPartitionSizeInBytes", ADVISED)):
        if known(name) > most:
            spark.conf.set(name, str(most))
    for name, least in (("spark.sql.shuffle.partitions", -(-size // SHARE)), ("spark.sql.sources.fileCompressionFactor", UNPACKED)):
        if float(spark.conf.get(name)) < least:
            spark.conf.set(name, str(least))


def cut(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    # Row groups are what a scan can be split into.
    df.write.option("parquet.block.size", READ).parquet(path)
    _written.append((spark, path))
    bounded_tasks(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A folder of the shared one, deleted when the program ends."""
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
