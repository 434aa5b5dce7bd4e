"""Language identification by nearest centroids.

A text becomes a vector of byte bigrams and trigrams (lower case; ASCII other
than letters is one blank) hashed into DIM cells, damped, weighted by idf and
normalised. Training rows of each language are clustered by spherical k-means
into several centroids; a text gets the language of the centroid with the
largest cosine, and is rejected if even that one is farther than the language's
own distance. That distance comes from the training rows: MARGIN times the cosine
that all but QUANTILE of the language's rows reach, and less in proportion for texts that fill fewer than FULL cells, as short
texts are far from everything, but FLOOR at least. Texts without a letter are always rejected.

Fitting uses a bounded sample of labelled rows, at most SAMPLE in all, shared evenly by at
most LANGS languages (the most frequent labels; ties go to the first in code-point order),
chosen by a hash of id and text; equal rows are one. Both bounds are
parameters. Only hashed counts of those rows go to the driver, at most DIM numbers a
row, and are made dense one language at a time. Prediction reads every text whole and needs no shuffle: the model (DIM
floats a centroid) travels with the tasks.

Defined results: null text, empty text or text without a letter: `und`, score 0,
rejected; without any labelled rows everything is `und`; ties go to the
language first in code-point order; repeated rows get equal results. A null id
counts as the empty string for the held-out rule. Other columns are carried if
asked for; a column named like a new one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_names, release, table

DIM, CLUSTERS, SAMPLE, LANGS, ROUNDS = 8192, 4, 4000, 256, 8
QUANTILE, MARGIN, FLOOR, FULL = 0.01, 0.5, 0.05, 300
UND = "und"
_KEEP = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def counts(text: str, dim: int = DIM) -> np.ndarray:
    """Hashed counts of byte bigrams and trigrams of a whole text."""
    a = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_KEEP) + b" ", dtype=np.uint8)
    a = a[np.concatenate(([True], (a[1:] != 32) | (a[:-1] != 32)))].astype(np.uint32)
    if len(a) < 3:
        return np.zeros(dim, dtype=np.float32)
    two = a[:-1] * np.uint32(256) + a[1:]
    three = two[:-1] * np.uint32(256) + a[2:]
    shift = np.uint32(32 - int(dim).bit_length() + 1)
    cells = np.concatenate(((two + np.uint32(1 << 25)) * np.uint32(2654435761), three * np.uint32(2246822519))) >> shift
    return np.bincount(cells, minlength=dim).astype(np.float32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray  # normalised, one row each
    least: np.ndarray  # of each centroid: the cosine below which a text is rejected

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, rejected of each text."""
        langs, scores, least = [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts))
        at = [i for i, t in enumerate(texts) if t and self.langs and has_letter(t)]
        for lo in range(0, len(at), 256):
            part = at[lo : lo + 256]
            rows = np.stack([counts(texts[i], len(self.idf)) for i in part])
            held = np.minimum(1.0, (rows > 0).sum(axis=1) / FULL)
            near = weighted(rows, self.idf) @ self.centroids.T
            best = near.argmax(axis=1)
            for i, k, s, h in zip(part, best, near[np.arange(len(part)), best], held, strict=True):
                langs[i], scores[i], least[i] = self.langs[k], min(1.0, max(0.0, float(s))), max(FLOOR, self.least[k] * h)
        return langs, scores, scores < least


def weighted(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit vectors of rows of counts, made in their place."""
    np.log1p(rows, out=rows)
    rows *= idf
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    return rows


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit rows; starts from rows far from each other, so a rerun gives the same."""
    start = [int((x @ x.mean(axis=0)).argmax())]
    while len(start) < min(k, len(x)):
        start.append(int((x @ x[start].T).max(axis=1).argmin()))
    c = x[start]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


Sparse = tuple[np.ndarray, np.ndarray]  # cells of a text's vector, ascending, and their counts


def fit_rows(rows: dict[str, list[Sparse]], dim: int = DIM, clusters: int = CLUSTERS) -> Model:
    """Learns from rows by language. Only one language's rows are dense at a time."""
    names = sorted(n for n in rows if rows[n])
    if not names:
        return Model([], np.ones(dim, dtype=np.float32), np.zeros((0, dim), dtype=np.float32), np.zeros(0))
    share = np.zeros(dim)  # every language counts alike
    for n in names:
        share += np.bincount(np.concatenate([at for at, _ in rows[n]]), minlength=dim) / len(rows[n])
    idf = np.log((1 + len(names)) / (share + 1e-3)).clip(0.01).astype(np.float32)
    langs, centroids, least = [], [], []
    for n in names:
        x = np.zeros((len(rows[n]), dim), dtype=np.float32)
        for row, (at, values) in zip(x, rows[n], strict=True):
            row[at] = values
        x = weighted(x, idf)
        c = spherical_kmeans(x, clusters)
        reach = MARGIN * float(np.quantile((x @ c.T).max(axis=1), QUANTILE))
        del x
        langs += [n] * len(c)
        centroids.append(c)
        least += [reach] * len(c)
    return Model(langs, idf, np.concatenate(centroids).astype(np.float32), np.array(least))


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, dim: int = DIM, clusters: int = CLUSTERS, languages: int = LANGS) -> Model:
    """Learns from rows with a language and text; at most sample rows of the most frequent languages go to the driver."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("id"))
    per = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col("lang").cast("binary")).limit(languages).collect()
    if not per:
        return fit_rows({}, dim)
    quota = max(1, sample // len(per))
    # rows below a threshold that about twice the quota pass, and of those the quota with the least hashes, equal rows once
    u = F.pmod(F.xxhash64("id", "text", F.lit("langid")), F.lit(1 << 40))
    limits = {r["lang"]: int(min(1.0, (2 * quota + 50) / r["n"]) * (1 << 40)) for r in per}
    limit = F.create_map(*[F.lit(x) for kv in sorted(limits.items()) for x in kv])[F.col("lang")]
    chosen = rows.withColumn("u", u).where(F.col("u") < limit)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [counts(t, dim) if has_letter(t) else np.zeros(dim, dtype=np.float32) for t in b["text"]]
            where = [np.flatnonzero(x) for x in found]
            yield pd.DataFrame({"u": b["u"], "lang": b["lang"], "at": [w.astype("<u4").tobytes() for w in where], "n": [x[w].astype("<f4").tobytes() for x, w in zip(found, where, strict=True)]})

    short = chosen.mapInPandas(hashed, "u long, lang string, at binary, n binary").where(F.length("at") > 0)
    short = short.dropDuplicates(["u", "lang"]).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("u"))).where(F.col("rank") <= quota)
    by: dict[str, list[Sparse]] = {}
    for r in sorted(short.select("u", "lang", "at", "n").toLocalIterator(), key=lambda r: r["u"]):
        by.setdefault(r["lang"], []).append((np.frombuffer(r["at"], dtype="<u4"), np.frombuffer(r["n"], dtype="<f4")))
    model = fit_rows(by, dim, clusters)
    by.clear()
    release()
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text", names: dict[str, str] | None = None) -> DataFrame:
    """docs with lang_pred, score and rejected, or what names calls them."""
    (inner,) = fresh_names(docs, "_found")

    @F.pandas_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores, rejected = model.predict([None if t is None else t for t in texts])
        return pd.DataFrame({"lang_pred": langs, "score": scores, "rejected": rejected})

    # called once for a row: as a pure function the optimizer would call it again in a filter on what it returns
    out = docs.withColumn(inner, predict.asNondeterministic()(F.col(text_col).cast(T.StringType())))
    return out.withColumns({(names or {}).get(c, c): F.col(f"{inner}.{c}") for c in ("lang_pred", "score", "rejected")}).drop(inner)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = fit(docs.where(~held_out))
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
