"""Durable intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources import shared_folder

_written: list[str] = []


def written() -> int:
    """How many tables durable has written in this process and sweep has left."""
    return len(_written)


def sweep(spark: SparkSession, start: int = 0, end: int | None = None) -> int:
    """Delete the tables that durable wrote in this process, once the results that read them are written: all, or those
    between two values of written(). Their number."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    gone = _written[start:end]
    for path in gone:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    del _written[start:end]
    return len(gone)


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet below shared_folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
