"""Hard-negative mining by bit-sliced integer products.

Components are scaled and rounded down to integers; the score of a row is its
integer inner product with the anchor. A row is kept as bit-planes: plane k holds
bit k of each component, the top plane the sign (two's complement). The planes are
multiplied with the anchors most significant first. What the planes below k can still
add lies between (2^k - 1) times the sums of the anchor's negative and of its positive
components; so each score has an interval that halves with every plane. A pair is dropped as soon as its
interval can't qualify: it lies under the anchor's worst kept score, or outside all ranges of scores
that the anchor's positives allow. Planes are multiplied for all pairs of a tile while many are left,
for rows that still have a pair after that, and pair by pair at last.

Two passes: (1) the POSITIVES best rows of the anchor's own label; (2) for each of them the NEGATIVES best rows of
another label whose score is LOW to HIGH per cent of the positive's. Rows come by ascending id, so
that once a list is full a later row must beat its last score, not equal it.

Scale: anchors are a stated query set; blocks of anchors meet blocks of rows, one task for each pair of blocks, and only lists of
a few rows for each anchor leave a task. Rows travel packed, CHUNK of them in a record, so no label,
however frequent, makes a large group. Work is rows times anchors, less what planes rule out; memory is
that of a tile.

Defined results: rows with a null label, a null vector, or a null or non-finite component
take no part; vectors of different length don't meet. A null id is no anchor; as a candidate it comes last
among equals and is shown as null. An anchor is not its own positive; other rows that repeat it are, and repeated rows
count as often as they come. No positive or no negative: no row. A positive below zero allows no score. An empty table gives an
empty result. Other columns are not used. Components of 2**31 or more when scaled, or scores that could pass 2**53, raise an error,
as integers that overflow do in SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .vectors import NULL_ID, by_length

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
CHUNK, ROWS, LEAST_ROWS, ANCHORS, TILE = 1024, 32768, 1024, 2048, 2048
SPARSE = 64  # pairs are followed one by one when fewer than one in so many is left
PAIRS = 1 << 16  # pairs multiplied one by one at a time


def takes_part(v: Column) -> Column:
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def chunks(vectors: DataFrame, label: Column, is_anchor: Column, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """Records of up to CHUNK rows of one length d: chunk (their number), n, anchors (how many are), ids, labels, flags and v, packed."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor & F.col(id_col).isNotNull(), F.lit(False)).alias("anchor"), v.alias("v"))
    rows = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & takes_part(F.col("v")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for d, at in by_length(b["v"]).items():
                x = np.floor(scale * np.array([b["v"].iloc[i] for i in at], dtype=np.float64).reshape(len(at), d))
                if d and np.abs(x).max() >= 2**31:
                    raise OverflowError("a scaled component doesn't fit 32 bits")
                ids, labels, flags = (b[c].to_numpy()[at] for c in ("id", "label", "anchor"))
                for lo in range(0, len(at), CHUNK):
                    part = slice(lo, lo + CHUNK)
                    small = x[part].astype("<i2")
                    packed = small if (small == x[part]).all() else x[part].astype("<i4")
                    yield pd.DataFrame({
                        "d": d, "chunk": number, "n": len(small), "anchors": int(flags[part].sum()), "ids": [ids[part].astype("<i8").tobytes()], "labels": [labels[part].astype("<i8").tobytes()],
                        "flags": [flags[part].astype(np.uint8).tobytes()], "v": [packed.tobytes()],
                    })
                    number += 1

    return materialize(rows.mapInPandas(run, "d int, chunk long, n int, anchors int, ids binary, labels binary, flags binary, v binary"), "chunks")


def unpacked(b: pd.DataFrame, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels, row numbers and integer vectors of some chunks, by ascending id."""
    ids, labels = (np.frombuffer(b"".join(b[c]), dtype="<i8") for c in ("ids", "labels"))
    uids = np.concatenate([(c * CHUNK) + np.arange(n) for c, n in zip(b["chunk"].tolist(), b["n"].tolist(), strict=True)])
    x = np.concatenate([np.frombuffer(c, dtype=f"<i{len(c) // (n * d)}").reshape(n, d).astype(np.int32) if d else np.zeros((n, 0), dtype=np.int32) for c, n in zip(b["v"], b["n"].tolist(), strict=True)])
    order = np.lexsort((uids, ids))
    return ids[order], labels[order], uids[order], x[order]


def anchor_rows(packed: DataFrame) -> DataFrame:
    """A row for each anchor: d, aid (its row number), anchor_id, label, v."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, n, chunk, ids, labels, flags, v in b[["d", "n", "chunk", "ids", "labels", "flags", "v"]].itertuples(index=False):
                at = np.flatnonzero(np.frombuffer(flags, dtype=np.uint8))
                x = np.frombuffer(v, dtype=f"<i{len(v) // (n * d)}").reshape(n, d)[at].astype("<i4") if d else np.zeros((len(at), 0), dtype="<i4")
                yield pd.DataFrame({"d": d, "aid": chunk * CHUNK + at, "anchor_id": np.frombuffer(ids, dtype="<i8")[at], "label": np.frombuffer(labels, dtype="<i8")[at], "v": [r.tobytes() for r in x]})

    return packed.where("anchors > 0").mapInPandas(run, "d int, aid long, anchor_id long, label long, v binary")


class Slices:
    """Integer rows as bit-planes, most significant first; exact products with anchors, as far as a range of scores asks."""

    def __init__(self, x: np.ndarray, anchors: np.ndarray):
        self.x, self.a = x, anchors
        low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
        self.bits = 1 + max(high.bit_length(), (~low).bit_length() if low < 0 else 0)
        sums = np.abs(anchors.astype(np.float64)).sum(axis=1).max(initial=0.0)
        bound = sums * 2.0**self.bits
        if bound >= 2**53:
            raise OverflowError("scores could pass 2**53")
        self.kind = np.float32 if bound < 2**24 else np.float64
        self.to = np.ascontiguousarray(anchors.T, dtype=self.kind)
        self.least, self.most = np.minimum(anchors, 0).sum(axis=1).astype(self.kind), np.maximum(anchors, 0).sum(axis=1).astype(self.kind)

    def plane(self, x: np.ndarray, k: int) -> np.ndarray:
        return ((x >> k) & 1).astype(self.kind)

    def within(self, lo: int, hi: int, low: np.ndarray, high: np.ndarray, dead: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, anchor, score) of the pairs of rows lo to hi that aren't dead and whose score is low[anchor] to high[anchor]."""
        rows, x = np.arange(lo, hi), self.x[lo:hi]
        low, high = low.astype(self.kind), high.astype(self.kind)
        s = np.zeros((len(rows), len(self.a)), dtype=self.kind)
        if dead is not None:
            s[dead] = -np.inf
        k = self.bits
        while k:
            k -= 1
            s += self.plane(x, k) @ self.to * self.kind(-(2**k) if k == self.bits - 1 else 2**k)
            rest = self.kind(2**k - 1)
            alive = (s >= low - rest * self.most) & (s <= high - rest * self.least) & (s > -np.inf)
            left = np.count_nonzero(alive)
            if k == 0 or left * SPARSE <= alive.size:
                break
            some = alive.any(axis=1)
            if 2 * np.count_nonzero(some) <= len(rows):
                rows, x, s = rows[some], x[some], s[some]
        r, q = np.nonzero(alive)
        s = s[r, q]
        while k:
            k -= 1
            bits, rest = (x >> k) & 1, self.kind(2**k - 1)
            for at in range(0, len(r), PAIRS):
                part = slice(at, at + PAIRS)
                s[part] += 2**k * (bits[r[part]] * self.a[q[part]]).sum(axis=1).astype(self.kind)
            fits = (s >= low[q] - rest * self.most[q]) & (s <= high[q] - rest * self.least[q])
            r, q, s = r[fits], q[fits], s[fits]
        return rows[r], q, s.astype(np.int64)


class Lists:
    """The best few (score, row) of each list; rows are offered in the order that breaks ties."""

    def __init__(self, lists: int, size: int):
        self.size, self.of = size, np.zeros(0, dtype=np.int64)
        self.row, self.score = self.of, self.of
        self.beat = np.full(lists, -np.inf)  # a score that gets in is this or more

    def offer(self, of: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        if not len(of):
            return
        of, row, score = (np.concatenate(c) for c in ((self.of, of), (self.row, row), (self.score, score)))
        order = np.lexsort((-score, of))
        of, row, score = of[order], row[order], score[order]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        nth = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
        kept = nth < self.size
        last = nth == self.size - 1
        self.beat[of[last]] = score[last] + 1
        self.of, self.row, self.score = of[kept], row[kept], score[kept]


def tiles(n: int) -> Iterator[tuple[int, int]]:
    """A short tile first: what it finds rules out most pairs of the others."""
    lo, step = 0, 256
    while lo < n:
        yield lo, min(n, lo + step)
        lo, step = lo + step, TILE


def positives_of(x: np.ndarray, labels: np.ndarray, uids: np.ndarray, anchors: np.ndarray, alabels: np.ndarray, aids: np.ndarray, k: int) -> tuple:
    """(anchor, row, score): the k best rows of each anchor's own label."""
    found = []
    for label in np.intersect1d(labels, alabels):
        r, q = np.flatnonzero(labels == label), np.flatnonzero(alabels == label)
        sliced, best, top = Slices(x[r], anchors[q]), Lists(len(q), k), np.full(len(q), np.inf)
        for lo, hi in tiles(len(r)):
            i, j, s = sliced.within(lo, hi, best.beat, top, None)
            other = uids[r[i]] != aids[q[j]]
            best.offer(j[other], i[other], s[other])
        found.append((q[best.of], r[best.row], best.score))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else tuple(np.zeros((3, 0), dtype=np.int64))


def negatives_of(x: np.ndarray, labels: np.ndarray, anchors: np.ndarray, alabels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple:
    """(anchor, positive, row, score): the k best rows of other labels within low[anchor, positive] to high[anchor, positive]."""
    m, p = low.shape
    sliced, best = Slices(x, anchors), Lists(m * p, k)
    top = high.max(axis=1, initial=-np.inf)
    for lo, hi in tiles(len(x)):
        wanted = np.where(high >= low, np.maximum(low, best.beat.reshape(m, p)), np.inf)  # of an empty range nothing is wanted
        i, j, s = sliced.within(lo, hi, wanted.min(axis=1, initial=np.inf), top, labels[lo:hi, None] == alabels)
        fits = (s[:, None] >= wanted[j]) & (s[:, None] <= high[j])
        at, nth = np.nonzero(fits)
        best.offer(j[at] * p + nth, i[at], s[at])
    return best.of // p if p else best.of, best.of % p if p else best.of, best.row, best.score


GROUP = ["d", "r", "a"]


def meet(packed: DataFrame, anchors: DataFrame, sizes: DataFrame, measure, schema: str) -> DataFrame:
    """measure over each pair of a block of rows and a block of anchors."""
    own = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = packed.select("d", "chunk", "n", "ids", "labels", "v").join(sizes, "d").withColumn("r", own("chunk", F.col("rows"))).withColumn("a", other("asked")).drop("rows", "asked")
    right = anchors.join(sizes, "d").withColumn("a", own("aid", F.col("asked"))).withColumn("r", other("rows")).drop("rows", "asked")
    return left.groupBy(*GROUP).cogroup(right.groupBy(*GROUP)).applyInPandas(measure, schema)


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score. low and high: per cent of the positive's score."""
    spark = vectors.sparkSession
    packed = chunks(vectors, F.col("label") if label is None else label, is_anchor, id_col, vec_col, scale)
    anchors = materialize(anchor_rows(packed), "anchors")
    tasks = 2 * spark.sparkContext.defaultParallelism
    per = F.least(F.lit(ROWS), F.greatest(F.lit(LEAST_ROWS), F.ceil(F.col("n") / tasks)))  # only the layout follows the cluster
    sizes = packed.groupBy("d").agg(F.sum("n").alias("n"), F.sum("anchors").alias("m")).where("m > 0")
    sizes = materialize(sizes.select("d", F.ceil(F.col("n") / per).cast("int").alias("rows"), F.ceil(F.col("m") / ANCHORS).cast("int").alias("asked")), "sizes")
    shape = lambda b, d: np.frombuffer(b"".join(b["v"]), dtype="<i4").reshape(len(b), d)

    def first(key: tuple, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"aid": [], "id": [], "uid": [], "score": []}, dtype="int64")
        ids, labels, uids, x = unpacked(rows, int(key[0]))
        aids = asked["aid"].to_numpy()
        q, r, s = positives_of(x, labels, uids, shape(asked, int(key[0])), asked["label"].to_numpy(), aids, positives)
        return pd.DataFrame({"aid": aids[q], "id": ids[r], "uid": uids[r], "score": s})

    near = meet(packed, anchors, sizes, first, "aid long, id long, uid long, score long")
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy("aid").orderBy(F.desc("score"), "id", "uid"))).where(F.col("nth") <= positives)
    near = near.groupBy("aid").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "score"))).alias("p"))  # a few for each anchor
    asked = materialize(anchors.join(near, "aid").select("d", "aid", "anchor_id", "label", "v", "p.id", "p.score"), "asked")

    def second(key: tuple, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"aid": [], "nth": [], "negative_id": [], "uid": [], "negative_score": []}, dtype="int64")
        ids, labels, uids, x = unpacked(rows, int(key[0]))
        lo, hi = np.full((len(asked), positives), np.inf), np.full((len(asked), positives), -np.inf)
        for i, scores in enumerate(asked["score"]):
            s = np.asarray(scores, dtype=np.int64)
            lo[i, : len(s)], hi[i, : len(s)] = -(-s * low // 100), s * high // 100
        q, nth, r, s = negatives_of(x, labels, shape(asked, int(key[0])), asked["label"].to_numpy(), lo, hi, negatives)
        return pd.DataFrame({"aid": asked["aid"].to_numpy()[q], "nth": nth, "negative_id": ids[r], "uid": uids[r], "negative_score": s})

    hard = meet(packed, asked, sizes, second, "aid long, nth long, negative_id long, uid long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("aid", "nth").orderBy(F.desc("negative_score"), "negative_id", "uid"))
    hard = hard.withColumn("rank", rank).where(F.col("rank") <= negatives).drop("uid")
    shown = lambda c: F.when(c != NULL_ID, c)
    nth = F.col("nth").cast("int")
    out = hard.join(asked.select("aid", "anchor_id", "id", "score"), "aid")
    return out.select("anchor_id", shown(F.get("id", nth)).alias("positive_id"), (nth + 1).alias("positive_rank"), "rank", shown(F.col("negative_id")).alias("negative_id"), F.get("score", nth).alias("positive_score"), "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = mine(vectors, F.col("vec_id") % 50 == 0, label)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = f"""
WITH e AS (
  SELECT row_number() OVER () AS nr, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.nr AS anchor, a.vec_id AS anchor_id, r.nr, r.vec_id, r.label = a.label AS alike,
        (CASE WHEN len(r.v) = 0 THEN 0 ELSE list_inner_product(a.v, r.v) END)::BIGINT AS score
      FROM e a JOIN e r ON a.nr <> r.nr AND len(a.v) = len(r.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, nr) AS nth FROM s WHERE alike QUALIFY nth <= {POSITIVES}),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor, p.nth ORDER BY s.score DESC, s.vec_id, s.nr)::INT AS rank
      FROM p JOIN s ON p.anchor = s.anchor AND NOT s.alike AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
