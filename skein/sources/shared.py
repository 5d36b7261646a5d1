"""The folder that driver and executors share, and tables written there."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset and the master is local."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's path in the shared folder."""
    return f"{shared_dir(spark)}/skein-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its lineage ends there."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: Column | str) -> DataFrame:
    """``df`` dealt over as many tasks as shuffle partitions: a small file of many rows would otherwise be one task's."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def in_ranges(df: DataFrame, *order: Column | str, name: str = "_range") -> DataFrame:
    """``df`` written in ranges of its order, as many as shuffle partitions, with each row's range from 0."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn(name, F.spark_partition_id()), "ranges")
