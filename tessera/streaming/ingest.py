"""Incremental ingestion with Structured Streaming: each trigger takes what is new and ends.

Event-time windows are an addition of this package, the rest is ingestion by content id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.session import shared_dir


BUCKETS = 64


def stream_table(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A folder of Parquet files, or the one file of that path, as a stream with the file's schema."""
    schema = spark.read.parquet(path).schema
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if system.getFileStatus(where).isDirectory():
        return reader.parquet(path)
    parent, _, name = path.rstrip("/").rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(parent)


def workspace(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything there is now, then the end; a second run with the same checkpoint takes only what came since."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str, key: str, event_time: str | None = None, delay: str = "30 days") -> StreamingQuery:
    """Each key once into ``out``; the state of keys is dropped behind a watermark where there is an event time."""
    stream = stream_table(spark, path)
    stream = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key]) if event_time else stream.dropDuplicates([key])
    return run_once(stream, out, checkpoint)


def merge_batches(stream: DataFrame, target: str, checkpoint: str, key: str) -> StreamingQuery:
    """Append the rows of each micro-batch whose key the target doesn't hold yet (again after a failure: the same result).

    The target is partitioned by a hash of the key into ``BUCKETS`` folders; a batch reads the keys of
    those folders only that its own keys fall into.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key]).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
        where = spark._jvm.org.apache.hadoop.fs.Path(target)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            touched = [r[0] for r in fresh.select("_bucket").distinct().collect()]  # BUCKETS numbers at most
            fresh = fresh.join(spark.read.parquet(target).where(F.col("_bucket").isin(touched)).select(key), key, "left_anti")
        fresh.write.mode("append").partitionBy("_bucket").parquet(target)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def window_counts(events: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total): event-time windows behind a watermark; works on a stream and on a table."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )
