"""The folder that driver and executors share, and cutting lineage there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder. Where neither is set, a local master gets a folder of its own
    (tests); a cluster gets an error, as its machines share no local folder."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="jobloom-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut", free: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor loses nothing. With free, the shuffle files of the write go as soon as it is done."""
    path, conf, option = fresh_dir(df.sparkSession, name), df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = conf.get(option, None)
    if free:
        conf.set(option, "true")
    try:
        df.write.parquet(path)
    finally:
        if free:
            conf.unset(option) if was is None else conf.set(option, was)
    return df.sparkSession.read.schema(df.schema).parquet(path)
