r"""Substring dedup: runs of words that stand anywhere else go, by seed and extend.

A *window* is ``length`` words of one document, a *seed* is ``seed`` words. Each window
picks the seed inside it with the smallest hash (the first of equals): a winnowed anchor. What a window picks
depends on its own words only, so two equal windows pick the same seed at the same place. Windows in a row that
pick the same seed are its *reach*: the seed extended both ways as far as any window of it goes.

1. Seeds are joined on their hash. A seed that stands once has no partner; its windows are unique.
2. Extension to the full reach: where all reaches of a seed are equal, every word of them is repeated. These are
the inner parts of repeats, nearly all anchors.
3. Where reaches of a seed differ (a repeat ends near it), reaches that are equal are repeated as a whole; for the others extension goes
word by word: each distinct reach is laid open once in its windows, and windows are joined on their hashes.
Maximal repeats are the unions of what was found, and all their words go, in every copy.

Hashes: 64 bits for a seed, 64 more of another base for a reach, 128 for a window; no others are compared.

Scale: documents are read once for their anchors (some 7 % of the words; 40 bytes each), and moved twice: for
step 3 (only those with an open reach, if their names are few enough to be broadcast; the count is taken first) and for the result.
Seeds are counted by least and greatest reach and number, with map-side combine, so a passage in a third of all documents is one
row for each task; occurrences meet these counts in plain equi-joins, which adaptive execution splits. No pairs of
occurrences are ever made. A text is hashed in slices of SLICE bytes.

Defined results: null text stays null with no words; a text of fewer than ``length`` words keeps all; the words
kept are joined by one space, also where nothing is removed; a null id is an id; rows that repeat id and text are
copies of each other, and lose all windows; rows that share an id only are told apart by the text's
hash; other columns are carried, and one named like a new one is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_names, materialize, release, table

LENGTH, SEED = 35, 7
SLICE = 2 << 20
BROADCAST_IDS = 200_000
_BASES = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]  # odd, of no other meaning
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, back: bool = False) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2**64, or those of its inverse."""
    have = _powers.get((base, back))
    if have is None or len(have) <= n:
        step = pow(base, -1, 2**64) if back else base
        have = np.full(n + 1, step, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= SLICE:
            _powers[base, back] = have
    return have[: n + 1]


class Spans:
    """Hashes of any stretch of a sequence: polynomials modulo 2**64, from running sums."""

    def __init__(self, values: np.ndarray, base: int):
        self.base, self.sums = base, np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * powers(base, len(values))[:-1], out=self.sums[1:])

    def of(self, a: np.ndarray, e: np.ndarray) -> np.ndarray:
        return (self.sums[e] - self.sums[a]) * powers(self.base, len(self.sums) - 1, back=True)[a]


_BLANK = re.compile(rb"[ \t\n\x0b\x0c\r]")


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the byte at which it starts."""
    data = np.frombuffer(raw, dtype=np.uint8)
    full = np.zeros(len(data) + 2, dtype=np.int8)
    full[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    edge = np.diff(full)
    a, e = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    return mix(Spans(data.astype(np.uint64) + np.uint64(1), _BASES[2]).of(a, e) + (e - a).astype(np.uint64)), a


def slices(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, hashes of their words, number of the first word of each text and of the end): some SLICE bytes
    at once; a longer text comes alone, hashed piece by piece."""
    lo = total = 0
    for i in range(len(texts) + 1):
        if i < len(texts) and (i == lo or total + len(texts[i]) <= SLICE):
            total += len(texts[i])
            continue
        if i == lo:
            return
        if total > SLICE:
            found, at, raw = [], 0, texts[lo]
            while at < len(raw):
                cut = _BLANK.search(raw, at + SLICE)
                end = cut.start() if cut else len(raw)
                found.append(word_hashes(raw[at:end])[0])
                at = end
            words = np.concatenate(found)
            yield lo, i, words, np.array([0, len(words)])
        else:
            words, at = word_hashes(b" ".join(texts[lo:i]))
            begin = np.cumsum([0, *[len(t) + 1 for t in texts[lo:i]]])
            yield lo, i, words, np.searchsorted(at, begin)
        lo, total = i, len(texts[i]) if i < len(texts) else 0


def picked(grams: np.ndarray, width: int) -> np.ndarray:
    """The place of the least gram among each width of them in a row, the first of equals."""
    best, have = np.arange(len(grams)), 1
    while have < width:
        step = min(have, width - have)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(grams[left] <= grams[right], left, right)
        have += step
    return best


def reaches(words: np.ndarray, first: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, seed's hash, reach's hash) of each anchor of some texts."""
    if len(words) < length:
        return tuple(np.zeros((5, 0), dtype=np.int64))
    grams = np.arange(len(words) - seed + 1)
    hashes = mix(Spans(words, _BASES[0]).of(grams, grams + seed))
    best = picked(hashes, length - seed + 1)
    inside = np.zeros(len(words) + 1, dtype=np.int32)  # windows that end with their text or before
    np.add.at(inside, first[:-1], 1)
    np.add.at(inside, np.maximum(first[:-1], first[1:] - length + 1), -1)
    q = np.flatnonzero(np.cumsum(inside)[: len(best)])
    if not len(q):
        return tuple(np.zeros((5, 0), dtype=np.int64))
    of = best[q]
    new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (q[1:] != q[:-1] + 1)))
    n = np.diff(np.append(new, len(q)))
    a = q[new]
    reach = mix(Spans(words, _BASES[1]).of(a, a + n - 1 + length) + n.astype(np.uint64))
    text = np.searchsorted(first, a, side="right") - 1
    return text, a - first[text], n, hashes[of[new]].view(np.int64), reach.view(np.int64)


KEY = ["id", "th"]


def anchors(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """(id, th, body) -> id, th, q (first window), n (windows), seed, reach."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, th, texts = b["id"].to_numpy(), b["th"].to_numpy(), b["body"].tolist()
            for lo, hi, words, first in slices(texts):
                text, q, n, s, r = reaches(words, first, length, seed)
                yield pd.DataFrame({"id": ids[lo:hi][text], "th": th[lo:hi][text], "q": q, "n": n, "seed": s, "reach": r})
        release()

    return docs.mapInPandas(run, "id long, th long, q int, n int, seed long, reach long")


def windows(docs: DataFrame, length: int) -> DataFrame:
    """(id, th, body, tests: array of (q, n, w)) -> a, b (a window's hashes), id, th, q, w."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, th, texts = b["id"].to_numpy(), b["th"].to_numpy(), b["body"].tolist()
            for lo, hi, words, first in slices(texts):
                tests = [np.asarray(b[c].iloc[i], dtype=np.int64) for c in ("q", "n", "w") for i in range(lo, hi)]
                q, n, w = (np.concatenate(tests[k * (hi - lo) : (k + 1) * (hi - lo)]) for k in range(3))
                text = np.repeat(np.arange(hi - lo), [len(t) for t in tests[: hi - lo]])
                each = np.repeat(np.arange(len(q)), n)
                at = q[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                a = first[text[each]] + at
                one, two = (mix(Spans(words, base).of(a, a + length)).view(np.int64) for base in _BASES[:2])
                yield pd.DataFrame({"a": one, "b": two, "id": ids[lo:hi][text[each]], "th": th[lo:hi][text[each]], "q": at, "w": w[each]})
        release()

    return docs.mapInPandas(run, "a long, b long, id long, th long, q int, w int")


def repeated(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """(id, th, body) -> id, th, spans: array of longs, first word and end of what is repeated, 32 bits each."""
    found = materialize(anchors(docs, length, seed), "anchors")
    seeds = found.groupBy("seed").agg(F.min("reach").alias("lo"), F.max("reach").alias("hi"), F.count(F.lit(1)).alias("many"))
    # written, so that both sides of the join are plain shuffles, whose hot partitions adaptive execution splits
    seeds = materialize(seeds.where("many > 1").select("seed", (F.col("lo") != F.col("hi")).alias("open")), "seeds")
    kept = lambda c: F.when(F.col("open"), F.col(c)).alias(c)
    met = materialize(found.join(seeds, "seed").select(*KEY, "q", "n", kept("seed"), kept("reach")), "met")
    edge = met.where("seed IS NOT NULL")
    shapes = materialize(edge.groupBy("seed", "reach").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct(*KEY, "q", "n")).alias("o")), "shapes")
    tests = shapes.select("o.*", F.least("many", F.lit(2)).cast("int").alias("w")).groupBy(*KEY).agg(*[F.collect_list(c).alias(c) for c in ("q", "n", "w")])
    tests = materialize(tests, "tests")
    whole = met.where("seed IS NULL").select(*KEY, "q", "n").unionByName(edge.join(shapes.where("many > 1").select("seed", "reach"), ["seed", "reach"]).select(*KEY, "q", "n"))
    count = tests.count()
    if count:
        some = docs.join(F.broadcast(tests.select(*KEY)), KEY, "left_semi") if count <= BROADCAST_IDS else docs
        laid = materialize(windows(some.join(tests, KEY), length), "windows")
        again = materialize(laid.groupBy("a", "b").agg(F.sum("w").alias("many")).where("many > 1").select("a", "b"), "again")
        single = laid.where("w = 1").join(again, ["a", "b"]).select(*KEY, "q", F.lit(1).alias("n"))
        whole = whole.unionByName(single)
    span = F.shiftleft(F.col("q").cast("long"), 32) + F.col("q") + F.col("n") + F.lit(length - 1)
    return whole.select(*KEY, span.alias("span")).groupBy(*KEY).agg(F.collect_set("span").alias("spans"))


def without(bodies: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """The words outside of spans, joined by one space."""
    out = []
    for body, cut in zip(bodies, spans, strict=True):
        words = body.split()  # at the six blanks
        n = len(words)
        if cut is not None:
            gone = np.zeros(n + 1, dtype=np.int32)
            np.add.at(gone, cut >> 32, 1)
            np.add.at(gone, cut & 0xFFFFFFFF, -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:n] == 0).tolist()]
        out.append((n, n - len(words), b" ".join(words)))
    return pd.DataFrame(out, columns=["n_words", "n_removed", "text"])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int | None = None) -> DataFrame:
    """docs with text_col cut, plus n_words (before) and n_removed. seed: words of an anchor, a fifth of length if not given."""
    seed = max(1, length // 5) if seed is None else seed
    if not 1 <= seed <= length:
        raise ValueError("1 <= seed <= length")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_words", "n_removed") and c not in (id_col, text_col)])
    rid, rth, did, dth, spans, done = fresh_names(docs, "_rid", "_rth", "_did", "_dth", "_spans", "_done")
    keyed = docs.withColumn(rid, F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))).withColumn(rth, F.xxhash64(F.col(text_col)))
    texts = keyed.where(F.length(text_col) >= 2 * length - 1).select(F.col(rid).alias("id"), F.col(rth).alias("th"), F.col(text_col).cast("binary").alias("body"))
    found = repeated(texts, length, seed).select(F.col("id").alias(did), F.col("th").alias(dth), F.col("spans").alias(spans))
    out = keyed.join(found, (F.col(rid) == F.col(did)) & (F.col(rth) == F.col(dth)), "left")
    out = out.withColumn(done, F.pandas_udf(without, "n_words long, n_removed long, text binary")(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")), F.col(spans)))
    out = out.withColumns({"n_words": F.col(f"{done}.n_words"), "n_removed": F.col(f"{done}.n_removed"), text_col: F.when(F.col(text_col).isNotNull(), F.col(f"{done}.text").cast("string"))})
    return out.drop(rid, rth, did, dth, spans, done)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS nr, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
q AS (SELECT nr, unnest(range(1, len(w) - {LENGTH - 2})) AS i FROM d WHERE len(w) >= {LENGTH}),
h AS (SELECT nr, i, array_to_string(w[i:i + {LENGTH - 1}], ' ') AS s FROM q JOIN d USING (nr)),
r AS (SELECT s FROM h GROUP BY s HAVING count(*) > 1),
m AS (SELECT nr, i FROM h JOIN r USING (s)),
e AS (SELECT nr, unnest(range(1, len(w) + 1)) AS i FROM d),
c AS (SELECT e.nr, e.i, coalesce(max(m.i) OVER (PARTITION BY e.nr ORDER BY e.i), -{LENGTH}) > e.i - {LENGTH} AS gone FROM e LEFT JOIN m ON e.nr = m.nr AND e.i = m.i),
k AS (SELECT c.nr, count(*) FILTER (WHERE gone) AS n_removed, string_agg(d.w[c.i], ' ' ORDER BY c.i) FILTER (WHERE NOT gone) AS kept FROM c JOIN d USING (nr) GROUP BY c.nr)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (nr)
"""
