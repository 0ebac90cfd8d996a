"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, taken from ``spark.checkpoint.dir``.

    Where the session sets none, a temporary folder is made and set if all runs on this machine (a local
    test); on a cluster that is an error.
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        # Spark appends a folder of its own to the configured one
        return spark.conf.get("spark.checkpoint.dir", None) or have.get()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="recordloom-")
    sc.setCheckpointDir(where)
    return where


def bound_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound the Arrow batches that go to Python tasks by bytes, whatever the length of the texts. A setting of the session, read when a plan runs."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back: cuts the lineage and
    survives lost executors. ``release`` deletes the table when nothing reads it any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return with_table(spark.read.schema(df.schema).parquet(path), path)


def with_table(df: DataFrame, path: str | None) -> DataFrame:
    """Note the written table that a lazy result still reads."""
    df._written_table = path
    return df


def table_of(df: DataFrame) -> str | None:
    return getattr(df, "_written_table", None)


def release(*tables: DataFrame) -> None:
    """Delete written tables that only finished work has read."""
    for df in tables:
        if path := table_of(df):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
