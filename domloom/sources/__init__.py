"""Reading pages from files, and writing results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_html_files(spark: SparkSession, path: str | Sequence[str], *, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """(path, content): whole files as bytes, for operators.parse(html_col='content')."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path if isinstance(path, str) else list(path)).select("path", "content")


def read_html_text(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(path, html): whole UTF-8 files as text."""
    return spark.read.text(path if isinstance(path, str) else list(path), wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def write_rendered(df: DataFrame, column: str, path: str, *, mode: str = "errorifexists") -> None:
    """One text file a partition, a rendering a record; documents are parted by a blank line, so the column may hold breaks."""
    df.select(F.col(column).cast("string").alias("value")).where("value IS NOT NULL").write.mode(mode).option("lineSep", "\n\n").text(path)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which the cluster shares. Where it is unset, a local session gets a temporary folder, as in tests;
    on a cluster that would be a folder of one machine, so it is an error there."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="domloom-checkpoint-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """df written as Parquet in the folder that the cluster shares and read back. For a nodes table that several selectors
    read: it is parsed once, and filters reach the files. It stays until its folder is deleted (see discard)."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> int:
    """Delete the files of a table that stored wrote, once nothing reads it any more. How many there were."""
    spark = df.sparkSession
    root = shared_folder(spark).removeprefix("file:")
    files = [f for f in df.inputFiles() if root in f]
    for folder in {f.rsplit("/", 1)[0] for f in files}:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(files)


#: A session setting: the number of partitions that the named queries deal their tables over. Unset, files decide.
PARTITIONS = "spark.domloom.partitions"


def dealt(df: DataFrame) -> DataFrame:
    """df over as many partitions as the session's setting says; as it is read where there is none."""
    n = df.sparkSession.conf.get(PARTITIONS, None)
    return df.repartition(int(n)) if n else df
