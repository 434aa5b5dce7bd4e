"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine c have the squared distance 2 - 2c. A fixed random rotation
spreads it over BLOCKS subspaces; if each gets a budget in proportion to its
dimensions, a linked pair keeps to the budget of at least one. So each
subspace is range-joined by itself, in two steps of the same kind. Its first coordinates are cut into cells
twice as wide as the budget's root; a vector goes to its own cell, and also to those
neighbours after it in order that its budget's ball reaches; thus any two vectors
within the budget meet in one cell, once. The coarse step deals vectors to regions, over as many
coordinates as regions of about REGION rows ask for (the number of vectors decides; none for a
small table, where a subspace is one region), so that a vector travels once or a few times for each subspace. The
fine step cuts a region's rows again inside its task, where a copy is a number and not
a vector. Pairs within the budget are candidates;
their cosine is computed from the original vectors in doubles. A pair that
keeps to several budgets counts in the first such block only, so the union of
candidates needs no shuffle.

Pairs are never written out: a task returns, for each of its vectors, how many it has
linked, and one link to the smallest of its group in the task, which is
enough for components. Equal vectors are one class with a number of its own and a multiplicity. Regions of more
than SPLIT rows are cut in parts, and all pairs of parts are tasks. Vectors travel as single floats where that loses nothing.

Defined results: vectors null, empty, zero, or with null or non-finite components
have no links and are components of their own, as are vectors of another length for each
other; rows that share an id are told apart by their vectors, and rows that share a vector link with each other; a null id has a null component unless
a vector with an id is in it, and is kept if none is. An empty table gives an empty result. Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, table
from .components import components
from .vectors import by_length, pack_exact, takes_part, unit, unpack_exact

COSINE, BLOCKS = 0.95, 8
REGION, SPLIT, FINE, PAIRS = 1 << 16, 1 << 16, 512, 1 << 20
_SLACK = 1e-9


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def plan(d: int, cosine: float, blocks: int) -> tuple[list[int], np.ndarray]:
    """Edges of the subspaces, and their budgets of squared distance."""
    edges = [round(i * d / min(blocks, d)) for i in range(min(blocks, d) + 1)]
    return edges, (2 - 2 * cosine) * np.diff(edges) / d


def cells_of(z: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code of cell, home) for each cell that a row of z goes to: its own, and those after it that its ball reaches."""
    width = max(2 * reach, 1e-6)
    base = int(np.ceil(1 / width)) + 3  # unit vectors: places are from -base + 2 to base - 2, with one more on each side
    z = z[:, : int(62 / np.log2(2 * base))]  # as many coordinates as a code holds
    own = np.floor(z / width).astype(np.int64)
    row, code = np.arange(len(z)), np.zeros(len(z), dtype=np.int64)
    left, home = np.full(len(z), reach * reach * (1 + 1e-9)), np.ones(len(z), dtype=bool)
    for k in range(z.shape[1]):
        low = z[row, k] - own[row, k] * width
        parts = []
        for step in (-1, 0, 1):
            gap = (0.0 if step == 0 else low if step < 0 else width - low) ** 2 * np.ones(len(row))
            at = np.flatnonzero((gap <= left) & (~home if step < 0 else True))  # the first step away from home goes up
            parts.append((row[at], code[at] * (2 * base) + own[row[at], k] + step + base, left[at] - gap[at], home[at] & (step == 0)))
        row, code, left, home = (np.concatenate(x) for x in zip(*parts, strict=True))
    return row, code, home


def dealt(rows: DataFrame, cosine: float, blocks: int, grid: int) -> DataFrame:
    """(node, many, v array) -> region, home, node, many, v (packed)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, at in by_length(b["v"]).items():
                x = np.array([b["v"].iloc[i] for i in at], dtype=np.float64)
                nodes, many, packed = b["node"].to_numpy()[at], b["many"].to_numpy()[at], pack_exact(x)
                y, (edges, budgets) = unit(x) @ rotation(d), plan(d, cosine, blocks)
                for k, budget in enumerate(budgets):
                    reach = float(np.sqrt(budget)) * (1 + 1e-6) + 1e-9
                    row, code, home = cells_of(y[:, edges[k] : edges[k + 1]][:, :grid], reach)
                    yield pd.DataFrame({"d": d, "block": k, "region": code, "home": home, "node": nodes[row], "many": many[row], "v": packed[row]})

    return rows.mapInPandas(run, "d int, block int, region long, home boolean, node long, many long, v binary")


def within(z: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (p, q) of the pairs of rows whose squared distance is at most limit (or a rounding error more), each once."""
    zz, limit = (z * z).sum(axis=1), limit * (1 + 1e-9) + 1e-12
    fine = min(z.shape[1], max(0, int(np.log2(max(1, len(z)) / FINE))))
    row, code, home = cells_of(z[:, :fine], float(np.sqrt(limit)) * (1 + 1e-6) + 1e-9)
    order = np.lexsort((row, ~home, code))
    row, code, home = row[order], code[order], home[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    last = np.append(first[1:], len(row))
    homes = np.add.reduceat(home.astype(np.int64), first)
    for lo, hi, n in zip(first, last, homes, strict=True):
        if not n or hi - lo < 2:
            continue
        every = row[lo:hi]
        step = max(1, PAIRS // len(every))
        for a in range(0, n, step):
            mine = every[a : min(n, a + step)]
            d2 = zz[mine][:, None] + zz[every[a + 1 :]] - 2 * (z[mine] @ z[every[a + 1 :]].T)
            p, q = np.nonzero(d2 <= limit)
            ok = q >= p  # every[a + 1 + q] stands after every[a + p]
            if ok.any():
                yield mine[p[ok]], every[a + 1 + q[ok]]


def linked_in(part: pd.DataFrame, i: int, j: int, block: int, cosine: float, blocks: int) -> pd.DataFrame:
    """Links among the rows of a region's parts i and j: (a, b, n): n links of a when b is a itself, else a is connected to b."""
    d = int(part["d"].iloc[0])
    x = unpack_exact(part["v"].tolist(), d)
    part = part.drop(columns="v")
    u = unit(x)
    del x
    edges, budgets = plan(d, cosine, blocks)
    turn = rotation(d)
    z = np.ascontiguousarray(u @ turn[:, edges[block] : edges[block + 1]])
    node, many, home, sub = part["node"].to_numpy(), part["many"].to_numpy(), part["home"].to_numpy(), part["sub"].to_numpy()
    count, label = np.zeros(len(u), dtype=np.int64), np.arange(len(u))
    limit = budgets * (1 + _SLACK) + 1e-15
    for p, q in within(z, limit[block]):
        ok = (home[p] | home[q]) & ((sub[p] != sub[q]) if i != j else True)
        p, q = p[ok], q[ok]
        for lo in range(0, len(p), 8192):
            s, t = p[lo : lo + 8192], q[lo : lo + 8192]
            good = (u[s] * u[t]).sum(axis=1) >= cosine
            s, t = s[good], t[good]
            if not len(s):
                continue
            apart = np.einsum("pi,ij->pj", u[s] - u[t], turn)  # not by matrix product: equal whatever pairs are beside it
            inside = np.add.reduceat(apart**2, edges[:-1], axis=1) <= limit
            ok = inside[:, block] & (inside.argmax(axis=1) == block)
            s, t = s[ok], t[ok]
            np.add.at(count, s, many[t])
            np.add.at(count, t, many[s])
            while len(s):  # hook the larger label of a link to the smaller, and shorten the paths
                ls, lt = label[s], label[t]
                apart = ls != lt
                s, t, ls, lt = s[apart], t[apart], ls[apart], lt[apart]
                low = np.minimum(ls, lt)
                np.minimum.at(label, ls, low)
                np.minimum.at(label, lt, low)
                while (label[label] != label).any():
                    label = label[label]
    hit, moved = np.flatnonzero(count), np.flatnonzero(label != np.arange(len(u)))
    return pd.DataFrame({"a": np.concatenate((node[hit], node[moved])), "b": np.concatenate((node[hit], node[label[moved]])), "n": np.concatenate((count[hit], np.zeros(len(moved), dtype=np.int64)))})


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, blocks: int = BLOCKS) -> DataFrame:
    """id, n_links, component_id, kept for every row."""
    i = F.col(id_col).cast("long")
    rows = vectors.select(F.struct(i.isNull().alias("no_id"), F.coalesce(i, F.lit(0)).alias("id")).alias("own"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(takes_part(F.col("v")), F.col("v")))
    first = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("own").alias("first"), F.count(F.lit(1)).alias("many"))
    classes = materialize(first.select(F.monotonically_increasing_id().alias("node"), "v", "first", "many"), "classes")
    grid = max(0, int(np.ceil(np.log2(max(1, classes.count()) / REGION))))
    spread = dealt(classes.select("node", "many", "v"), cosine, blocks, grid)
    region = ["d", "block", "region"]
    parts = spread.groupBy(*region).agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("parts"))
    spread = spread.join(parts, region).withColumn("sub", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    spread = spread.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("i", F.least("sub", "o")).withColumn("j", F.greatest("sub", "o"))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        release()  # of the region before
        return linked_in(part, key[3], key[4], key[1], cosine, blocks)

    columns = [*region, "i", "j", "home", "sub", "node", "many", "v"]
    found = materialize(spread.select(*columns).groupBy(*region, "i", "j").applyInPandas(run, "a long, b long, n long"), "links")
    counts = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n"))
    graph = components(found.where("n = 0").select("a", "b"))
    classes = classes.join(counts, F.col("node") == F.col("a"), "left").drop("a").join(graph.withColumnRenamed("node", "g"), F.col("node") == F.col("g"), "left").drop("g")
    classes = classes.select("v", "first", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    least = classes.groupBy("component").agg(F.min("first").alias("least"))
    classes = classes.join(least, "component").select(F.col("v").alias("w"), "n_links", "least")
    whole = rows.join(classes, F.col("v") == F.col("w"), "left").select("own", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "own").alias("least"))
    given = lambda c: F.when(~F.col(f"{c}.no_id"), F.col(f"{c}.id"))
    return whole.select(given("own").alias(id_col), "n_links", given("least").alias("component_id"), (F.col("own") == F.col("least")).alias("kept"))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
