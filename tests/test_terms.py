"""First matches, the nearest word of need or preference, and quotes, against places counted with Python's patterns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from jobloom.functions import rules as R
from jobloom.operators import terms as T


def around(text, pattern):
    """(match, status, quote) by positions in the whole text."""
    m = re.compile(pattern, re.IGNORECASE).search(text)
    lo, hi, mid = max(0, m.start() - 150), min(len(text), m.end() + 150), m.start() + m.end()
    near = [(abs(h.start() + h.end() - mid), rank, label) for rank, (label, p) in enumerate((("required", R.REQUIRED_NEAR), ("preferred", R.PREFERRED_NEAR))) for h in re.compile(p, re.IGNORECASE).finditer(text, lo, hi)]
    begin = max(text.rfind("\n", 0, m.start()) + 1, m.start() - 80)
    end = text.find("\n", m.end())
    return m.group(), min(near)[2] if near else "mentioned", " ".join(text[begin : min(len(text) if end < 0 else end, m.end() + 80)].split())


def test_places_of_words(spark):
    rng = random.Random(2)
    pieces = ["must", "Required", "a plus", "nice  to\nhave", "bonus", "обязательно", "плюсом", "xmust", "needs", "asset.", "word", "ééé", "\n", "x" * 40, "—", "prefer", "preferred", "😀", " "]
    texts = []
    for _ in range(400):
        words = [rng.choice(pieces) for _ in range(rng.randint(0, 40))]
        words.insert(rng.randint(0, len(words)), rng.choice(["PL-300", "pl300", "Microsoft  Certified", "power bi data analyst associate"]))
        texts.append(rng.choice([" ", " ", "  ", "-"]).join(words))
    texts += ["PL-300", "must" + "y" * 150 + " PL-300", "y" * 5 + " must" + " " * 146 + "PL-300", "PL-300" + " " * 147 + "must", "PL-300" + " " * 146 + "must", "must PL-300 a plus", "bonus PL-300 must", "We use PL-300 daily", "Must have SQL and Python. Nice to have PL-300."]
    name, pattern = R.CERTIFICATES[0]
    hit = T.first_match(F.col("t"), T.flagged(name, pattern))
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").where(F.col("t").rlike(T.flagged(name, pattern)))
    got = {r["i"]: (r["m"], r["w"], r["q"]) for r in frame.withColumn("h", hit).select("i", F.col("h.m").alias("m"), T.wanted(F.col("h")).alias("w"), T.quoted_line(F.col("h")).alias("q")).collect()}
    want = {i: around(t, pattern) for i, t in enumerate(texts) if re.search(pattern, t, re.IGNORECASE)}
    assert got == want
    assert {w for _, w, _ in want.values()} == {"required", "preferred", "mentioned"}


def test_term_patterns(spark):
    cases = [
        ("Excel", "You will excel in a fast-paced team and want to excel at reporting", False), ("Excel", "A candidate who wants to excel.", False), ("Excel", "Advanced Excel, SQL and Python", True), ("SQL", "experience with NoSQL stores", False),
        ("SQL", "strong T-SQL skills", True), ("Dune", "a sand dune landscape", False), ("Dune", "on-chain queries in Dune", True), ("Dune", "dune analytics dashboards", True), ("certification near a tool name", "сертифікат Power BI", True),
        ("certification near a tool name", "Certification in nursing. " + "x" * 80 + " we use SQL", False), ("certification near a tool name", "Certification in nursing.\nWe use SQL", False),
    ]
    frame = spark.createDataFrame([(i, t, "", "Junior", "Remote", "") for i, (_, t, _) in enumerate(cases)], "seq int, full_text string, title string, seniority string, work_format string, country string")
    got = {(r["seq"], r["term"]) for r in T.term_hits(frame).collect()}
    assert [(i, n) in got for i, (n, _, _) in enumerate(cases)] == [w for _, _, w in cases]


def test_phrase_hits(spark):
    """Phrases of one to three words, however they are parted, each counted once for a text; any dictionary gives what a search of each phrase gives."""
    rng = random.Random(4)
    words = ["sql", "data", "analyst", "c", "ü", "бд", "x1"]
    texts = [rng.choice([" ", ", ", "\n", " - "]).join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    phrases = [(f"t{i % 9}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))) for i in range(25)] + [("blank", " - "), ("none", "nowhere at all")]
    got = T.phrase_hits(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", spark.createDataFrame(phrases, "term string, phrase string")).collect()
    runs = [f" {' '.join(re.findall(r'\w+', t))} " for t in texts]
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == {(i, n) for i, r in enumerate(runs) for n, p in phrases if re.findall(r"\w", p) and f" {p} " in r}
    assert T.phrase_hits(spark.createDataFrame([(1, "sql")], "k int, t string"), "k", spark.createDataFrame([], "term string, phrase string")).count() == 0


@pytest.mark.parametrize("broadcast", [200_000, 3])
def test_phrase_runs(spark, monkeypatch, broadcast):
    """Runs of words are formed only where a phrase may begin, and a dictionary that is joined gives what one that is broadcast gives."""
    monkeypatch.setattr(T, "BROADCAST_PHRASES", broadcast)
    rng = random.Random(9)
    words = ["data", "analyst", "risk", "market", "ü", "бд", *[f"w{i}" for i in range(60)]]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 200))) for _ in range(80)] + ["", "data", "market data"]
    phrases = [("a", "data analyst"), ("b", "market"), ("a", "risk - data analyst"), ("c", "ü"), ("d", "ü бд"), ("e", "market data analyst w1")]
    frame, known = spark.createDataFrame(list(enumerate(texts)), "k int, t string"), spark.createDataFrame(phrases, "term string, phrase string")
    assert {tuple(r) for r in T.phrase_hits(frame, "k", known).collect()} == {(i, n) for i, t in enumerate(texts) for n, p in phrases if f" {p.replace('- ', '')} " in f" {t} "}
    begun = spark.createDataFrame([("data", 2), ("market", 1), ("risk", 3)], "word string, n int")
    runs = [" ".join(w[i : i + n]) for t in texts for w in [t.split()] for i in range(len(w)) for n in [{"data": 2, "market": 1, "risk": 3}.get(w[i], len(w) + 1)] if i + n <= len(w)]
    for longest in (None, 3):
        assert sorted(r["run"] for r in T.begun_runs(frame, "k", begun, longest).collect()) == sorted(runs)
