"""Streams of micro-batches: rows or landed payloads merged by the batch upsert, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ids as I
from ..operators.store import cut
from ..sources import feeds
from .buckets import BUCKETS, upsert


def first_rows(batch: DataFrame, key: str) -> DataFrame:
    """One row a key: that with the earliest dates, ties broken by its other columns."""
    dates = [c for c in ("date_published", "date_collected") if c in batch.columns]
    order = F.struct(*dates, *[c for c in batch.columns if c not in (*dates, key)])
    return batch.groupBy(key).agg(F.min(order).alias("r")).select(key, "r.*").select(*batch.columns)


def merge_stream(stream: DataFrame, table: str, checkpoint: str, key: str = "key", buckets: int = BUCKETS):
    """Starts a stream that merges rows into a table in buckets, a version for each micro-batch; a batch that runs again writes the
    same version, so a restart neither loses nor doubles rows. Late rows need no watermark: the earlier date wins in the merge."""

    def one(batch: DataFrame, n: int) -> None:
        upsert(batch.sparkSession, table, cut(first_rows(batch, key), "batch"), n, key, buckets)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def landed_stream(spark: SparkSession, source: str, folder: str, table: str, rejects: str, checkpoint: str, wholetext: bool = True, buckets: int = BUCKETS, **options):
    """Starts a stream over the payloads that land in a folder (a file, or a line, each): parsed by the source's entry in the
    registry, keyed, and merged into a table in buckets, so that feeds which overlap count each posting once. Payloads that can't be read go to rejects, a
    folder for each micro-batch, with their path and the reason."""
    landed = spark.readStream.format("text").option("wholetext", wholetext).load(folder).select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("path"))

    def one(batch: DataFrame, n: int) -> None:
        batch = cut(batch, "landed")
        feeds.malformed(batch, source).write.mode("overwrite").parquet(f"{rejects}/v={n}")
        rows = feeds.REGISTRY[source](batch, **options)
        c = F.col
        keyed = rows.withColumn("key", I.dedup_key(c("source"), c("url"), c("company"), c("title"), c("city_region"))).withColumn("status", F.lit(""))
        upsert(batch.sparkSession, table, cut(first_rows(keyed, "key"), "batch"), n, "key", buckets)

    return landed.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Daily counts of events by type as a stream with a watermark; runs through what is there and returns the table.

    Each micro-batch writes the windows that it changed as a version of its own under folder (again, if it runs again); the table
    has the latest version of each window.
    """
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    daily = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    daily = daily.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")

    def one(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/v={n}")

    daily.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    versions = spark.read.schema(T.StructType([*daily.schema.fields, T.StructField("v", T.IntegerType())])).option("basePath", f"{folder}/table").parquet(f"{folder}/table")
    return versions.groupBy("day", "event_type").agg(F.max_by(F.struct("n", "total"), "v").alias("r")).select("day", "event_type", "r.*")
