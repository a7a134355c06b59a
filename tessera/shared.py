"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, or the folder of setCheckpointDir(); on local masters only, a temporary one where neither is set."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera_"))
        known = context._jsc.sc().getCheckpointDir()
    return known.get()


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _hadoop_path(spark, path)
    return files.exists(where)


def entries(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder, none if there is no such folder."""
    where, files = _hadoop_path(spark, path)
    return [x.getPath().getName() for x in files.listStatus(where)] if files.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with what it holds."""
    where, files = _hadoop_path(spark, path)
    files.delete(where, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    where, files = _hadoop_path(spark, path)
    files.deleteOnExit(where)
    return path


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and outlives a lost executor. by: the last column, for a folder per value."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def together(tables: list[DataFrame]) -> DataFrame:
    """Tables of materialise() with one schema, as one scan."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[t._tessera_path for t in tables])


def discard(df: DataFrame) -> None:
    """Delete a table of materialise() that no later plan reads."""
    if path := getattr(df, "_tessera_path", None):
        remove(df.sparkSession, path)


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, if its files give fewer: a table of one row group would keep one core busy. Large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def few(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """df in as many tasks as its known number of rows asks for, not as many as the session has shuffle partitions."""
    return df.coalesce(max(1, -(-rows // each)))
