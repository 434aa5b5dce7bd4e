"""Every stage against what it promises, on the smallest tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from jobloom.llm import minhash


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    say = {"en": "the and of that with for is to river stone", "de": "der die und nicht mit für ist zu Fluss Stein"}
    rows = []
    for i in range(160):
        k = rng.choice(list(say))
        text = "\n".join(" ".join(rng.choice(say[k].split()) + str(rng.randrange(90)) * rng.randint(0, 1) for _ in range(20)) for _ in range(rng.randint(1, 5)))
        rows.append((i, text, k, f"s{i % 3}", len(text)))
    rows += [(200, rows[1][1], "en", "s1", 1), (201, rows[2][1] + " more", "en", "s1", 1), (202, "123 456", None, None, 7), (203, None, None, "s1", 0), (204, rows[3][1], None, None, 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, docs, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = now
        if name != names[-1]:
            assert now.columns == docs.columns
    ids = {n: [r["doc_id"] for r in f.select("doc_id").collect()] for n, f in seen.items()}
    assert set(ids["language_id"]) == {r["doc_id"] for r in docs.collect()} - {202, 203}
    assert 200 not in ids["line_dedup"] and 1 in ids["line_dedup"]
    kept = {r["doc_id"]: r["text"] for r in seen["near_dedup"].collect()}
    assert len(kept) == len(ids["near_dedup"])
    sets = {i: minhash.shingle_set(t, 5) for i, t in kept.items()}
    assert not any(100 * len(a & b) >= 80 * len(a | b) for i, a in sets.items() for j, b in sets.items() if i < j)
    assert set(ids["mix"]) <= set(ids["near_dedup"])
    assert sorted(ids["mix"]) == sorted(ids["encode"])


def test_rows_without_names(spark, docs, tmp_path):
    """Rows that share an id, or have none, are rows of their own: each group of near copies keeps one, each row its own copies."""
    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b, c, long = say(60), say(60), say(60), say(20_000)
    rows = [(5, a, "s0"), (5, b, "s0"), (5, b, "s0"), (None, a + " more", "s1"), (None, c, "s1"), (None, c, "s1"), (None, None, "s1"), (7, "", None), (7, "", None), (9, long, None)]
    frame = spark.createDataFrame([(i, t, "en", x, len(t or ""), "k") for i, t, x in rows], docs.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", _copy string").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_dedup"](spark, frame, str(tmp_path))
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted([(5, a), (5, b), (0, c), (0, ""), (7, ""), (7, ""), (9, long)])
    mixed = stages["mix"](spark, frame, str(tmp_path))
    assert mixed.columns == frame.columns
    count = lambda f, t: sum(r["text"] == t for r in f.collect())
    assert count(mixed, long) <= 2 and count(mixed, a) <= 2 and count(mixed, b) <= 4 and count(mixed, c) <= 4
    assert stages["encode"](spark, frame, str(tmp_path)).count() == len(rows)


def test_run(spark, docs, tmp_path):
    """run() gives what the stages give one after another, and again the same."""
    docs.withColumn("doc_id", F.when(F.col("doc_id") % 9 == 0, F.lit(None)).when(F.col("doc_id") % 7 == 0, 7).otherwise(F.col("doc_id"))).write.parquet(str(tmp_path / "documents.parquet"))
    once, again = (sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) for _ in range(2))
    assert once == again and len(once) > 50
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    assert sorted(map(str, now.collect())) == once


def test_empty(spark, docs, tmp_path):
    now = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.count() == 0
