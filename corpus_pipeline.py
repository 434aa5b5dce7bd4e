"""From documents to token ids: five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm import bpe, langid, line_dedup, minhash, mixing
from jobloom.llm.common import fresh_names, has_words, materialize


#: Rows and bytes of the batches that go to Python workers: their memory, and that of the buffers on the JVM's side, comes on top of executors' heaps.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


#: Words that the encoder takes at once: half of its default, as its workers stand beside heaps that four stages before it have grown.
WORDS = 100_000


def small_batches(spark: SparkSession) -> None:
    """Sets BATCHES for the session: plans read them when they run, which may be after a stage's function has returned."""
    for key, value in BATCHES.items():
        spark.conf.set(key, value)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go (no letter, or far from every language; empty and null texts have no
    letter); a missing lang is filled in. Repeated rows stay as often as they come. Columns are those of docs."""
    small_batches(spark)
    pred, score, rejected = fresh_names(docs, "_pred", "_score", "_rejected")
    names = {"lang_pred": pred, "score": score, "rejected": rejected}
    found = langid.identify(docs, langid.fit(docs), names=names)
    return found.where(~F.col(rejected)).withColumn("lang", F.coalesce("lang", pred)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and documents of which nothing is left; n_chars follows the text. Documents
    that lose nothing stay as they are, empty ones too."""
    out = line_dedup.dedup_lines(docs)
    left = out.where((F.col("n_removed") == 0) | has_words(F.col("text")))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) one row stays: that of the smallest doc_id, null last; rows that
    share an id, and rows without one, are told apart by what they hold."""
    small_batches(spark)
    return minhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every copy that the mix takes of a row."""
    (copy,) = fresh_names(docs, "_copy")
    taken = mixing.mix(docs, carry=True).where("copies > 0")
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), "copies"))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, and the proof that they decode to its text; null and empty texts have none."""
    small_batches(spark)
    return bpe.encode_documents(docs, bpe.vocabulary("byte_bpe_50k.json"), new=WORDS)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("mix", mix_sources),
    ("encode", encode),
]

#: Neither signatures nor byte pair encoding can be said in SQL; tests/llm checks every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
