"""Incremental collection: files of records become a table that has every key once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

#: The column, and so the folders, of the batches of a collection.
BATCH = "batch_id"


def collected(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """What has been collected so far, with the batch of each record; empty before the first batch."""
    p = spark._jvm.org.apache.hadoop.fs.Path(target)
    whole = StructType(list(schema.fields)).add(BATCH, "long")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(target)


def collect(spark: SparkSession, source: str, target: str, checkpoint: str, schema: StructType, *, key: str = "doc_id", files_a_batch: int = 1000) -> StreamingQuery:
    """Starts a stream that takes all files of JSON lines in ``source`` that it hasn't taken yet, and ends.

    Records without a key and lines that are no JSON are left out.  Of one key
    the record that was collected first stays; of several in one batch the
    smallest.  A batch is written to a folder of its own and looks only at
    earlier batches, so one that is run again after a failure, before or after
    its records were written, leaves each record once.
    """
    if any(f.name.lower() == BATCH for f in schema.fields):
        raise ValueError(f"records have no column {BATCH}")
    fields = [f.name for f in schema.fields]

    def add(batch: DataFrame, number: int) -> None:
        own = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*[f for f in fields if f != key])).alias("r")).select(key, "r.*")
        earlier = collected(batch.sparkSession, target, schema).filter(F.col(BATCH) < number)
        fresh = own.join(earlier.select(key), key, "left_anti").select(*fields)
        fresh.write.mode("overwrite").parquet(f"{target}/{BATCH}={number}")

    rows = spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_a_batch).json(source)
    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
