"""Tables that cut lineage.

They are written as Parquet below the folder that the session names in
``spark.checkpoint.dir``, which the driver and all executors share, so a lost
executor only costs the tasks that ran on it.  A session that names none gets a
temporary folder if it runs on one machine, and an error on a cluster.
"""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables; a temporary one only for a local session without the setting."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        base = tempfile.mkdtemp(prefix="lexweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


@contextlib.contextmanager
def _few_files(spark: SparkSession, few: bool):
    """Small exchanges are coalesced to the advised size, not spread over all cores, while a table is written."""
    key = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    before = spark.conf.get(key)
    if few:
        spark.conf.set(key, "false")
    try:
        yield
    finally:
        if few:
            spark.conf.set(key, before)


def cut(df: DataFrame, label: str, few_files: bool = False, by: str | None = None) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back; the session's end deletes it.

    With ``by``, a folder holds the rows of each value of that column, so a
    reader of one value reads no other.

    ``few_files`` is for tables that are mostly small and cheap to compute, such
    as those of a loop: exchanges before them end in partitions of the advised
    size even where that leaves cores idle.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexweave/{label}-{uuid.uuid4().hex}"
    # nothing waits for a marker of success: the table is read by its own path only after the write has returned
    with _few_files(spark, few_files):
        df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy(*[by] if by else []).parquet(path)
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table made by :func:`cut` that nothing will read again."""
    path = getattr(df, "_cut_path", None)
    if path:
        discard_path(df.sparkSession, path)


def discard_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one."""
    p, fs = _path(spark, path)
    fs.delete(p, True)
