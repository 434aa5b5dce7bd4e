"""A keyed table in hash buckets: a batch reads and rewrites only the buckets that its keys fall in.

Version n is a folder v=n with the buckets that batch n touched, and a manifest n=n that names, for each bucket, the version which
holds it. The manifest is written last: a batch that breaks off leaves the version before as it was, and writes the
same folders when it runs again. Buckets are a parameter fixed when the table begins; take as many as keep a bucket within some 100 MB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import merge

BUCKETS = 64


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, table: str, version: int) -> dict[int, int]:
    """bucket -> version; one row for each bucket, so it is bounded by their number."""
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{table}/manifest/n={version}").collect()}


def latest(spark: SparkSession, table: str) -> int | None:
    """The last version whose manifest is written."""
    try:
        return spark.read.parquet(f"{table}/manifest").agg(F.max("n").alias("n")).first()["n"]
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def _folders(table: str, of: dict[int, int], buckets) -> list[str]:
    return [f"{table}/v={of[b]}/bucket={b}" for b in sorted(buckets) if b in of]


def read_table(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """All rows of a version, the last one if none is given."""
    version = latest(spark, table) if version is None else version
    if version is None:
        raise FileNotFoundError(f"{table} has no version")
    of = manifest(spark, table, version)
    return spark.read.parquet(*_folders(table, of, of))


def upsert(spark: SparkSession, table: str, incoming: DataFrame, version: int, key: str = "key", buckets: int = BUCKETS) -> list[int]:
    """Merges incoming (one row a key) into the table as this version; returns the buckets that it rewrote. Version 0 begins the table;
    a version that is there already is written anew from the one before it."""
    of = manifest(spark, table, version - 1) if version else {}
    touched = sorted(r["b"] for r in incoming.select(bucket_of(F.col(key), buckets).alias("b")).distinct().collect())  # buckets at most
    there = _folders(table, of, touched)
    if there:
        before = spark.read.parquet(*there)
        merged = merge(before.withColumn("seq", F.lit(0).cast("long")), incoming, key).select(*before.columns)
    else:
        merged = incoming.withColumn("status", F.lit("new"))
    placed = merged.withColumn("bucket", bucket_of(F.col(key), buckets))
    placed.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/v={version}")
    rows = sorted((of | dict.fromkeys(touched, version)).items())
    spark.createDataFrame(rows, "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{table}/manifest/n={version}")
    return touched
