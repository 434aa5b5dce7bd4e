"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation is three rounds of random signs and a fast Hadamard transform
(vectors padded to a power of two). It sends a unit vector near one of the 2d
signed axes. In each of TABLES tables a row's bucket is the tuple of its nearest axes
under independent rotations; a query probes the PROBES buckets whose axes are nearest to it in sum, and all rows of
these buckets are measured exactly: Euclidean distance of the original vectors in
doubles.

The tuple has one axis more than vectors are dealt by: rows and queries meet in groups of the first axes
(one, and more for tables so large that groups would exceed BLOCK rows by far; the number of rows decides), and the
last axis picks the rows to measure inside the group. So a vector travels once for each table, and a
query once for each group that holds some of its buckets, however many these are. The
defaults are set for vectors without any structure (64 independent
components), the hardest case: ten tables of 350 probes find over nine tenths of
the ten nearest and measure about a fifth of all rows; vectors with clusters need fewer. The fewer rows, the
farther are the nearest of them, so PROBES grows by the share of BLOCK in the number of rows. Where vectors are dealt by a further axis
(from some 6 million rows, and again from some 750 million) WIDER times as many probes keep nine tenths and more, while the share of
rows measured falls to a hundredth, and to a thousandth; tests hold the layouts of 10 million and a billion rows to that.

Groups are cut in tasks of at most BLOCK index rows and BLOCK queries (sizes are counted first), and each block
of rows meets each block of queries. A task returns the k nearest for each of its
queries only. A query that finds fewer than k is asked again over all buckets of
a table, which hold every row: an exact answer, also for tiny tables. Vectors travel as single floats where that loses nothing.

Defined results: vectors null, empty, zero, or with a null or non-finite
component take no part, neither as queries nor as candidates; so do those of
another length for each other. Repeated vectors are candidates of their own; of
rows that share an id, the nearest counts. A null id is no query; as a candidate it is
shown as null. An empty table gives an empty result. Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .vectors import NULL_ID, by_length, pack_exact, unit, unpack_exact, valid

TABLES, PROBES, BLOCK, K, AXES, WIDER = 10, 350, 4096, 10, 128, 8
PAIRS, CHUNK = 1 << 20, 1 << 15  # pairs looked at, and measured, at a time


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths: steps of eight places at a time."""
    n, d = x.shape
    h = 1
    while h < d:
        b = min(8, d // h)
        small = np.ones((1, 1))
        while len(small) < b:
            small = np.block([[small, small], [small, -small]])
        x = np.matmul(small, x.reshape(n * (d // (b * h)), b, h)).reshape(n, d)
        h *= b
    return x / np.sqrt(d)


def rotate(u: np.ndarray, seed: int) -> np.ndarray:
    d = 1 << max(0, (u.shape[1] - 1).bit_length())
    y = np.zeros((len(u), d))
    y[:, : u.shape[1]] = u
    rng = np.random.default_rng(seed)
    for _ in range(3):
        y = hadamard(y * rng.choice((-1.0, 1.0), d))
    return y


def nearest_axes(u: np.ndarray, seed: int, probes: int, hashes: int) -> np.ndarray:
    """The probes nearest buckets of each row, nearest first."""
    codes = scores = None
    for h in range(hashes):
        y = rotate(u, seed * 1009 + h)
        s = np.concatenate((y, -y), axis=1)
        m = min(probes, s.shape[1])
        top = np.argsort(-s, axis=1, kind="stable")[:, :m]
        near = np.take_along_axis(s, top, axis=1)
        if codes is None:
            codes, scores = top, near
        else:  # of two falling lists only pairs (i, j) with (i + 1)(j + 1) <= probes can be among the probes largest sums
            i, j = np.nonzero(np.outer(np.arange(1, codes.shape[1] + 1), np.arange(1, m + 1)) <= probes)
            codes, scores = codes[:, i] * s.shape[1] + top[:, j], scores[:, i] + near[:, j]
            best = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
            codes, scores = np.take_along_axis(codes, best, axis=1), np.take_along_axis(scores, best, axis=1)
    return codes[:, :probes]


def depth(rows: int) -> int:
    """Axes by which a table of so many rows is dealt: groups of BLOCK rows or so, one axis at least."""
    return max(1, round(float(np.log(max(1.0, rows / BLOCK)) / np.log(AXES))))


def probing(rows: int, dealt: int = 1) -> int:
    """Probes in each table: PROBES for long tables, more the shorter one is, and WIDER times as many for each further axis that
    vectors are dealt by: its buckets are AXES times as many, of which the nearest WIDER times as many hold as many neighbours or more."""
    return int(PROBES * WIDER ** (dealt - 1) * (1 + BLOCK / max(1, rows)))


def bucketed(rows: DataFrame, tables: int, probes: int, dealt: int, inner: int) -> DataFrame:
    """(id, v) -> id, v (packed), at: for each group (d, t, k) that holds some of the row's buckets, the codes inside it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, at in by_length(b["v"]).items():
                x = np.array([b["v"].iloc[i] for i in at], dtype=np.float64)
                ids, packed, u = b["id"].to_numpy()[at], pack_exact(x), unit(x)
                inside = (2 << max(0, (d - 1).bit_length())) ** inner
                step = max(1, 512 * PROBES // max(PROBES, probes))
                for lo in range(0, len(at), step):
                    part = u[lo : lo + step]
                    codes = np.stack([np.sort(nearest_axes(part, t, probes, dealt + inner), axis=1) for t in range(tables)], axis=1)
                    group, subs = codes // inside, (codes % inside).astype("<i4")
                    first = np.ones(codes.shape, dtype=bool)
                    first[:, :, 1:] = group[:, :, 1:] != group[:, :, :-1]
                    row, t, place = np.nonzero(first)
                    raw, begin = subs.tobytes(), np.flatnonzero(first.ravel()) * 4
                    cut = [raw[a:e] for a, e in zip(begin.tolist(), [*begin[1:].tolist(), len(raw)], strict=True)]
                    of = np.searchsorted(row, np.arange(len(part) + 1))
                    ts, ks = t.astype(np.int32), group[row, t, place]
                    cols = {n: [c[a:e] for a, e in zip(of[:-1], of[1:], strict=True)] for n, c in (("t", ts), ("k", ks), ("subs", cut))}
                    yield pd.DataFrame({"id": ids[lo : lo + step], "v": packed[lo : lo + step], "d": d} | cols)

    found = rows.mapInPandas(run, "id long, v binary, d int, t array<int>, k array<long>, subs array<binary>")
    return found.select("id", "v", "d", F.arrays_zip("t", "k", "subs").alias("at"))


GROUP = ["d", "t", "k"]


def nearest(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """bucketed index and queries -> query_id, vec_id, score: the k nearest of each query over all its buckets."""
    index, queries = materialize(index, "index"), materialize(queries, "queries")
    sizes = lambda frame, name: frame.select("d", F.explode("at").alias("g")).select("d", "g.t", "g.k").groupBy(*GROUP).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    blocks = materialize(sizes(index, "rows").join(sizes(queries, "asked"), GROUP), "blocks")
    own = lambda n: F.pmod(F.xxhash64("id", "v"), n).cast("int")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spread = lambda frame: frame.select("id", "v", "d", F.explode("at").alias("g")).select("id", "v", "d", "g.*").join(blocks, GROUP)
    left = spread(index).select(*GROUP, own(F.col("rows")).alias("i"), other("asked").alias("q"), "id", "v", "subs")
    right = spread(queries).select(*GROUP, other("rows").alias("i"), own(F.col("asked")).alias("q"), "id", "v", "subs")

    def measure(key: tuple, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
        if len(rows) and len(asked):
            x, ids = unpack_exact(rows["v"].tolist(), int(key[0])), rows["id"].to_numpy()
            sub = np.frombuffer(b"".join(rows["subs"]), dtype="<i4")
            y, mine = unpack_exact(asked["v"].tolist(), int(key[0])), asked["id"].to_numpy()
            wanted = [np.frombuffer(c, dtype="<i4") for c in asked["subs"]]
            codes, step = 1 + max(int(sub.max()), max(int(w.max()) for w in wanted)), max(1, PAIRS // len(x))
            for lo in range(0, len(y), step):
                part = wanted[lo : lo + step]
                probed = np.zeros((len(part), codes), dtype=bool)
                probed[np.repeat(np.arange(len(part)), [len(w) for w in part]), np.concatenate(part)] = True
                q, r = np.nonzero(probed[:, sub])
                q += lo
                other = mine[q] != ids[r]
                q, r = q[other], r[other]
                far = np.concatenate([np.zeros(0), *[np.sqrt(((x[r[a : a + CHUNK]] - y[q[a : a + CHUNK]]) ** 2).sum(axis=1)) for a in range(0, len(q), CHUNK)]])
                order = np.lexsort((ids[r], far, q))
                q, r, far = q[order], r[order], far[order]
                start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, dtype=np.int64)
                nth = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
                out.append((mine[q[nth < k]], ids[r[nth < k]], far[nth < k]))
        return pd.DataFrame({n: np.concatenate(c) for n, c in zip(("query_id", "vec_id", "score"), zip(*out, strict=True), strict=True)})

    found = left.groupBy(*GROUP, "i", "q").cogroup(right.groupBy(*GROUP, "i", "q")).applyInPandas(measure, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, tables: int = TABLES, probes: int | None = None, dealt: int | None = None, inner: int = 1) -> DataFrame:
    """query_id, rank, vec_id, score for every row that is_query chooses, against all rows but those of its own id."""
    rows = valid(vectors, id_col, vec_col)
    asked = valid(vectors.where(is_query & F.col(id_col).isNotNull()), id_col, vec_col)
    n = vectors.count()
    dealt = depth(n) if dealt is None else dealt
    probes = probing(n, dealt) if probes is None else probes
    found = materialize(nearest(bucketed(rows, tables, 1, dealt, inner), bucketed(asked, tables, probes, dealt, inner), k), "nearest")
    few = materialize(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("id")), "answered")
    short = materialize(asked.join(few, "id", "left_anti"), "short")
    if not short.isEmpty():
        again = nearest(bucketed(rows, 1, 1, 1, 0), bucketed(short, 1, 1 << 20, 1, 0), k)
        found = found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)
    return found.select("query_id", "rank", F.when(F.col("vec_id") != NULL_ID, F.col("vec_id")).alias("vec_id"), "score")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)
