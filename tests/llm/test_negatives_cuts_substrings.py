"""Hard negatives, fill-in-middle and substring dedup against plain counts of the same things, and on odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm import fim, hard_negatives, substring_dedup

PATTERNS = {"lines": r"[^\n]*\n|[^\n]+", "words": r"[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*|[ \t\n\x0b\x0c\r]+", "chars": r"(?s)."}


# ---- hard negatives


def wanted_negatives(rows, divisor, k=5, m=3, low=50, high=95):
    """The contract, pair by pair. rows: (vec_id, vector, label)."""
    fine = [(i, [int(np.floor(256 * float(x))) for x in v], lab) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (aid, av, alab) in enumerate(fine):
        if aid is None or aid % divisor:
            continue
        scored = [(sum(x * y for x, y in zip(av, v, strict=True)), (i is None, i or 0), i, lab) for b, (i, v, lab) in enumerate(fine) if b != a and len(v) == len(av)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p in [s for s in scored if s[3] == alab][:k]:
            fits = [s for s in scored if s[3] != alab and low * p[0] <= 100 * s[0] <= high * p[0]][:m]
            out += [(aid, p[2], n + 1, s[2], p[0], s[0]) for n, s in enumerate(fits)]
    return sorted(out, key=str)


def got_negatives(spark, rows, divisor, **kw):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    got = hard_negatives.mine(frame.repartition(3), F.col("vec_id") % divisor == 0, **kw).collect()
    return sorted([(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got], key=str)


@pytest.mark.parametrize("spread", [1.0, 0.02, 40.0])
def test_negatives_brute(spark, spread):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 6)) * spread
    rows = [(i, (base[rng.integers(12)] + rng.normal(size=6) * 0.3 * spread).tolist(), int(rng.integers(3))) for i in range(400)]
    assert got_negatives(spark, rows, 10) == wanted_negatives(rows, 10)


def test_negatives_odd_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist(), int(rng.integers(2))) for i in range(120)]  # full of ties
    rows += [(200, None, 1), (210, [1.0, None, 0.0, 1.0], 1), (220, [float("nan"), 0.0, 0.0, 1.0], 0), (230, [1.0, 2.0, 3.0, 4.0], None), (240, [float("inf"), 0.0, 0.0, 0.0], 0)]
    rows += [(None, [2.0, 2.0, 2.0, 2.0], 1), (250, [0.0, 0.0, 0.0, 0.0], 1), (260, [1.0, 2.0], 1), (261, [1.0, 2.0], 1), (262, [0.5, 1.5], 0), (270, [], 1)]
    assert got_negatives(spark, rows, 10) == wanted_negatives(rows, 10)
    assert got_negatives(spark, [], 10) == []
    again = hard_negatives.mine(spark.createDataFrame([(10, [1.0], 1, "x")] * 2 + [(11, [0.9], 2, "y")], "vec_id long, embedding array<double>, label long, rank string"), F.col("vec_id") % 10 == 0)
    assert sorted((r["anchor_id"], r["positive_id"], r["negative_id"]) for r in again.collect()) == [(10, 10, 11)] * 2  # two rows of one id are two anchors


def test_negatives_huge_components(spark):
    with pytest.raises(Exception, match="doesn't fit 32 bits"):
        got_negatives(spark, [(0, [1e12], 1), (1, [1.0], 1)], 10)


def test_slices_are_exact():
    rng = np.random.default_rng(7)
    for high in (1, 9, 300, 40000):
        x, a = rng.integers(-high, high + 1, (700, 16)), rng.integers(-high, high + 1, (30, 16))
        s, scores = hard_negatives.Slices(x.astype(np.int32), a.astype(np.int32)), x @ a.T
        low, top = np.quantile(scores, 0.995, axis=0), np.full(30, np.inf)
        dead = rng.random((500, 30)) < 0.1
        r, q, v = s.within(100, 600, low, top, dead)
        want = {(i + 100, j): scores[i + 100, j] for i in range(500) for j in range(30) if not dead[i, j] and scores[i + 100, j] >= low[j]}
        assert {(int(i), int(j)): int(z) for i, j, z in zip(r, q, v, strict=True)} == want


# ---- fill-in-middle


@pytest.mark.parametrize("units", fim.UNITS)
def test_runs_against_units(units):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab\n\n é漢😀\t") for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    raw = [t.encode() for t in texts]
    runs = fim.Runs(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0] + [len(r) for r in raw]), units)
    cut_up = [re.findall(PATTERNS[units], t) for t in texts]
    assert runs.counts().tolist() == [len(u) for u in cut_up]
    cut = np.array([rng.randint(0, len(u)) for u in cut_up])
    assert runs.chars(np.arange(len(texts)), cut).tolist() == [len("".join(u[:c])) for u, c in zip(cut_up, cut.tolist(), strict=True)]


def transformed(doc_id, text, units="lines", seed=7, rate=100, spm=50):
    text = text or ""
    u = re.findall(PATTERNS[units], text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= rate:
        return len(u), "plain", None, None, text
    form = "spm" if h4 % 100 < spm else "psm"
    return len(u), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("units", fim.UNITS)
def test_fim_and_back(spark, units):
    rng = random.Random(2)
    texts = [None, "", "\n", "\n\n", "one", "one\n", "a<P>b\nc", "x<\nS>y", "<<\n<", "漢\n😀\né", "a\n" * 100_000, "w" * 200_000, "<M", ">", "P>"]
    texts += ["".join(rng.choice(["a", "\n", " ", "<", "S>", "M", "é"]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    rows = [(i, t, "kept", 1) for i, t in enumerate(texts)] + [(None, "no id\nhere\n", "kept", 1), (5, "one\n", "kept", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, form string, other int")
    done = fim.transform(frame, units=units, rate=80).withColumn("back", fim.restore(F.col("output"), F.col("form")))
    assert done.columns == ["doc_id", "text", "other", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    got = done.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == transformed(r["doc_id"], r["text"], units, rate=80)
        assert r["back"] == (r["text"] or "")
    assert fim.transform(frame.limit(0)).count() == 0


# ---- substring dedup


def without_repeats(texts, length):
    """Every window of every text in one dictionary; texts of the words kept, and how many went."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = {}
    for w in words:
        for i in range(len(w) - length + 1):
            seen[tuple(w[i : i + length])] = seen.get(tuple(w[i : i + length]), 0) + 1
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("length", "seed", "letters"), [(8, 2, 3), (8, 1, 2), (6, 6, 4), (12, 4, 6), (1, 1, 40)])
def test_substrings_brute(spark, length, seed, letters):
    rng = random.Random(length * 100 + seed)
    vocabulary = [f"w{i}" for i in range(letters)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(length, 3 * length))] for _ in range(6)]
    texts = []
    for _ in range(120):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) + str(rng.randrange(3)) for _ in range(rng.randint(0, 2 * length))]
            if w and rng.random() < 0.4:
                w[rng.randrange(len(w))] = "edit"
        texts.append("".join(x + rng.choice([" ", "  ", "\n", "\t"]) for x in w))
    rows = [(i // 2, t) for i, t in enumerate(texts)]  # ids are shared
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup.dedup_substrings(frame, length=length, seed=seed).collect())
    assert got == sorted((i, *w) for (i, _), w in zip(rows, without_repeats(texts, length), strict=True))


def test_substrings_odd_rows(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    own = lambda n: " ".join(f"x{rng.randrange(10**9)}" for _ in range(n))
    once = own(200)
    loop = "again " * 5000  # one document repeats itself
    texts = [None, "", " \n\t ", "one", once, once, passage, own(20) + " " + passage + " " + own(20), own(30) + "\n" + passage, " ".join(passage.split()[:34]), loop, own(50_000), "é漢 " * 40, own(34), own(35), "w" * 5_000_000]
    rows = [(i, t, 0, "kept") for i, t in enumerate(texts)] + [(None, passage, 0, "kept"), (None, None, 0, "kept"), (5, once, 0, "kept")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_words int, lang string")
    done = substring_dedup.dedup_substrings(frame)
    assert done.columns == ["doc_id", "text", "lang", "n_words", "n_removed"]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in done.collect()), key=str)
    want = [(i, *w) if t is not None else (i, 0, 0, None) for (i, t, *_), w in zip(rows, without_repeats([r[1] for r in rows], 35), strict=True)]
    assert got == sorted(want, key=str)
    assert substring_dedup.dedup_substrings(frame.limit(0)).count() == 0


def test_substrings_hot_passage(spark):
    """A passage in most documents, its surroundings all different: no pairs, and every copy goes."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(50)]
    texts = [" ".join([f"a{rng.randrange(10**6)}" for _ in range(rng.randint(0, 40))] + passage[rng.randint(0, 8) :] + [f"b{rng.randrange(10**6)}" for _ in range(rng.randint(0, 40))]) for _ in range(1500)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup.dedup_substrings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == without_repeats(texts, 35)


def test_long_texts_hash_alike():
    text = (" ".join(f"w{i % 977}" for i in range(60_000))).encode()
    whole, _ = substring_dedup.word_hashes(text)
    before, substring_dedup.SLICE = substring_dedup.SLICE, 10_000
    try:
        parts = [words for _, _, words, _ in substring_dedup.slices([text])]
    finally:
        substring_dedup.SLICE = before
    assert len(parts) == 1 and np.array_equal(parts[0], whole)


# ---- line dedup in texts of many equal lines


def test_equal_lines_are_linear(spark):
    """A table of equal lines, a log of few lines in any order, and a period: one copy of each line stays."""
    from jobloom.llm import line_dedup

    rng = random.Random(12)
    rule, log = "five words in each line", [" ".join(f"l{i}w{j}" for j in range(8)) for i in range(10)]
    texts = ["\n".join([rule] * 50_000), "\n".join(rng.choice(log) for _ in range(3000)), "\n\n".join(log[:7] * 300), "\n".join(log)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (got[0]["n_lines"], got[0]["n_removed"]) == (50_000, 49_999) and got[0]["text"] == rule
    assert got[2]["n_removed"] >= 7 * 300 - 14
    assert set(got[1]["text"].split("\n")) == set(log)  # the later texts may lose all that stands there


# ---- nearest neighbours on the layouts of large tables


def nearest_cosines(rows, d, k):
    """Cosines of the k nearest of so many independent directions: quantiles of the exact distribution."""
    c = np.linspace(-1, 1, 1_000_001)
    above = np.cumsum(np.exp((d - 3) / 2 * np.log1p(-np.minimum(c * c, 1 - 1e-15)))[::-1])[::-1]
    return np.array([c[np.searchsorted(-above / above[0], -(i - 0.5) / rows)] for i in range(1, k + 1)])


@pytest.mark.parametrize("rows", [1_000_000, 5_950_000, 10_000_000, 770_000_000, 1_000_000_000])
def test_nearest_on_large_layouts(rows):
    """Whether the codes of true neighbours are among those that a query probes, with the parameters that a table of so many rows gets."""
    from jobloom.llm import ann

    rng, queries, d, k = np.random.default_rng(0), 12, 64, 10
    x = ann.unit(rng.normal(size=(queries, d)))
    away = rng.normal(size=(queries, k, d))
    away -= (away * x[:, None]).sum(-1, keepdims=True) * x[:, None]
    c = nearest_cosines(rows, d, k)[None, :, None]
    near = (c * x[:, None] + np.sqrt(1 - c * c) * away / np.linalg.norm(away, axis=-1, keepdims=True)).reshape(-1, d)
    dealt = ann.depth(rows)
    found = np.zeros((queries, k), dtype=bool)
    for t in range(ann.TABLES):
        codes = ann.nearest_axes(near, t, 1, dealt + 1)[:, 0].reshape(queries, k)
        probed = ann.nearest_axes(x, t, ann.probing(rows, dealt), dealt + 1)
        found |= np.array([np.isin(codes[i], probed[i]) for i in range(queries)])
    assert found.mean() >= 0.9


# ---- token files: hot ids, other tokenizers


def test_rows_without_id_are_dealt(spark, tmp_path):
    import public_tokenizers

    from jobloom.llm import token_files

    rows = [(None, f"text number {i}") for i in range(400)] + [(3, f"row {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little would be one task
    try:
        shards = token_files.write_shards(docs.repartition(4), public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(s["docs"] > 50 for s in shards) > 1  # the rows without an id are not one shard
    got = token_files.read_shards(spark, shards).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 400 + [3] * 50


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    from jobloom.llm import token_files

    path, texts = public_tokenizers.path(name), ["Hello, World! it's 2024", "", "naïve  café\n\nx", "A" * 100, "<|endoftext|> end", "tabs\tand\r\nlines", "ÀÉ İ ǅ 漢字"]
    enc = token_files.Encoder(path)
    assert enc.split == (name == "word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.no_padding(), tok.no_truncation()
    assert [np.frombuffer(x, dtype=f"<u{enc.width}").tolist() for x in enc.ids(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
