"""Near-duplicate documents: MinHash signatures and a multi-index Hamming join.

A document is its set of distinct word shingles. POSITIONS minima of random
orders of the set, BITS bits of each, are its signature; two documents of
similarity J differ in a position with probability 1 - J. The signature is cut
into chunks of CHUNK positions. If two signatures differ in at most
TAU = chunks * (ERRORS + 1) - 1 positions, some chunk differs in at most ERRORS of
its own (pigeonhole). Allowed errors are enumerated: a chunk gives one key
for each way to leave ERRORS of its positions out, so that such a pair
shares a key for certain. A pair of similarity 0.8 differs in more than TAU = 17 of
36 positions with a probability of about 4 in 100,000.

Documents with equal sets are one class, numbered by itself, and enter once, however many they are.
Links are only needed as far as components go, so the pairs of a bucket are never
written out: (1) every class of a bucket is compared with the bucket's
smallest; what is confirmed is joined to components; (2) buckets that still
hold more than one component are compared pair by pair inside tasks: a first pass
by signature alone names the classes that have a near partner in another component, a
second pass has their sets of shingle hashes beside them and returns the links that join what
was apart, one less than there are classes at most. A pair that shares several keys is
compared under the first of them only; one that is already in one component isn't compared. A link counts only
if the full sets, made of the words themselves, pass the threshold.

Scale: documents are read whole once for signatures (no shuffle), and candidates'
texts once more; keys are 16 bytes each, ways * chunks of them for a class; minima
of buckets have map-side combine; joins on hot keys are plain equi-joins that
adaptive execution splits; buckets of more than BLOCK classes are cut in parts, and all pairs
of parts are groups of their own. The candidates' names are broadcast below BROADCAST_IDS,
and joined beyond.

Defined results: null text, or text without words: no shingles, linked with
nothing, a component of its own; fewer words than a shingle: the whole
sequence is the one shingle; of rows that share an id, each gets
the component of its own set; a null id has a null component unless a document
with an id is in its component, and is kept if none is; repeated rows give equal rows; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_names, has_words, materialize, release, table
from .components import components

POSITIONS, CHUNK, ERRORS, BITS = 36, 4, 1, 16
TAU = POSITIONS // CHUNK * (ERRORS + 1) - 1
LONGS = POSITIONS * BITS // 64
WAYS = list(combinations(range(CHUNK), CHUNK - ERRORS))
BROADCAST_IDS = 200_000
BLOCK, PAIRS = 1024, 1 << 19
_rng = np.random.default_rng(20240607)
_MULT = _rng.integers(1, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 2**63, POSITIONS, dtype=np.uint64)
SIGS = [f"g{i}" for i in range(LONGS)]
NAME = ["no_id", "id", "tag"]  # of a row: ids may be null, and several texts may share one


def words(text: str | None) -> list[bytes]:
    """Lower case A-Z only; split at the six ASCII blanks (bytes methods do just that)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, width: int) -> set:
    w = words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return set(zip(*[w[i:] for i in range(width)], strict=False))


class Signer:
    """(number of shingles, 128-bit name of the set, signature) of texts."""

    def __init__(self, width: int):
        import xxhash

        self.width, self.hash, self.wide, self.known = width, xxhash.xxh3_64_intdigest, xxhash.xxh3_128_intdigest, {}

    def hashes(self, text: str | None) -> np.ndarray:
        """The set as ascending 64-bit hashes of its shingles."""
        w = words(text)
        known, hash64 = self.known, self.hash
        if len(known) > 1 << 18:
            known.clear()
        for x in set(w).difference(known):
            known[x] = hash64(x)
        h = np.fromiter(map(known.__getitem__, w), dtype=np.uint64, count=len(w))
        n = max(1, len(h) - self.width + 1) if len(h) else 0
        out = np.full(n, min(len(h), self.width), dtype=np.uint64)
        for i in range(min(self.width, len(h))):
            out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out)

    def sign(self, text: str | None) -> tuple[int, int, int, np.ndarray]:
        u = self.hashes(text)
        if not len(u):
            return 0, 0, 0, np.zeros(POSITIONS, dtype=np.uint64)
        name = self.wide(u.tobytes())
        low = np.full(POSITIONS, 2**64 - 1, dtype=np.uint64)
        for at in range(0, len(u), 8192):
            low = np.minimum(low, (u[at : at + 8192, None] * _MULT + _PLUS).min(axis=0))
        return len(u), name >> 64, name & (2**64 - 1), (low * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)


def named(docs: DataFrame, id_col: str, text_col: str, tag: Column) -> DataFrame:
    """no_id, id, tag, text."""
    i = F.col(id_col).cast("long")
    return docs.select(i.isNull().alias("no_id"), F.coalesce(i, F.lit(0)).alias("id"), tag.alias("tag"), F.col(text_col).alias("text"))


def signatures(rows: DataFrame, width: int) -> DataFrame:
    """no_id, id, tag, n (shingles), c1, c2 (name of the set), g0.. (signature)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer(width)
        for b in batches:
            got = [signer.sign(t) for t in b["text"]]
            sig = np.array([g[3] for g in got], dtype=np.uint64).reshape(len(got), LONGS, 64 // BITS)
            packed = (sig << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64).view(np.int64)
            names = np.array([g[1:3] for g in got], dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame({c: b[c] for c in NAME} | {"n": [g[0] for g in got], "c1": names[:, 0], "c2": names[:, 1]} | {s: packed[:, i] for i, s in enumerate(SIGS)})
        signer.known.clear()
        release()

    return rows.mapInPandas(run, "no_id boolean, id long, tag long, n long, c1 long, c2 long, " + ", ".join(f"{s} long" for s in SIGS))


def chunk_keys():
    """Array of the keys of a row's signature: number of chunk and of the way, then the positions that stay."""
    per, mask = 64 // BITS, (1 << BITS) - 1
    position = [F.shiftrightunsigned(F.col(SIGS[i // per]), BITS * (i % per)).bitwiseAND(F.lit(mask)) for i in range(POSITIONS)]
    keys = []
    for c in range(POSITIONS // CHUNK):
        for way in WAYS:
            key = F.lit(len(keys)).cast("long")
            for i in way:
                key = F.shiftleft(key, BITS).bitwiseOR(position[c * CHUNK + i])
            keys.append(key)
    return F.array(*keys)


def differing(a: str, b: str):
    """Number of positions in which the signatures of two rows differ."""
    ones = sum(1 << (BITS * i) for i in range(64 // BITS))
    total = F.lit(0)
    for s in SIGS:
        x = F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}"))
        step = BITS // 2
        while step:
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
            step //= 2
        total = total + F.bit_count(x.bitwiseAND(F.lit(ones)))
    return total


def texts_of(nodes: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """node, text for each of the nodes (node column, may repeat): that of the class's first row, once."""
    names = materialize(nodes.select("node").distinct().join(classes.select("node", *NAME), "node"), "candidates")
    small = names.count() <= BROADCAST_IDS
    return materialize(rows.join(F.broadcast(names) if small else names, NAME).select("node", "text").dropDuplicates(["node"]), "texts")


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets have 100 * intersection >= percent * union."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: dict[str, set] = {}
        size = 0

        def of(t: str | None) -> set:
            nonlocal size
            if t not in sets:
                if size > 200_000:
                    sets.clear()
                    size = 0
                sets[t] = shingle_set(t, width)
                size += len(sets[t])
            return sets[t]

        for b in batches:
            good = []
            for x, y in zip(b["ta"], b["tb"], strict=True):
                p, q = of(x), of(y)
                same = len(p & q)
                good.append(bool(same) and 100 * same >= percent * (len(p) + len(q) - same))
            yield b.loc[good, ["a", "b"]]
        sets.clear()
        release()

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long")


# --- comparing inside tasks ------------------------------------------------------------------------------------------


def in_groups(rows: DataFrame, keys: list[str], order: list[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """run over frames of whole groups of keys, many small groups or a large one at a time, sorted by keys and order."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            last = np.ones(len(b), dtype=bool)
            for k in keys:
                last &= b[k].to_numpy() == b[k].iloc[-1]
            start = int(last.argmax())
            if start or held and any(held[-1][k].iloc[-1] != b[k].iloc[0] for k in keys):
                yield run(pd.concat([*held, b.iloc[:start]], ignore_index=True))
                held = []
            held.append(b.iloc[start:])
        if held:
            yield run(pd.concat(held, ignore_index=True))
        del held
        release()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(walk, schema)


def near_pairs(rows: pd.DataFrame, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (p, q) of the rows that are near by size and signature, in different components, under the first key they share.

    rows: whole groups (key, i, j), sorted by sub as well: parts i and j of a bucket, all pairs within where they are one.
    """
    key, i, j, sub, n, label = (rows[c].to_numpy() for c in ("key", "i", "j", "sub", "n", "label"))
    sig = np.ascontiguousarray(rows[SIGS].to_numpy(dtype=np.int64)).view("<u2").reshape(len(rows), POSITIONS)
    at = np.arange(len(rows))
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    end = np.append(first[1:], len(rows))[group]
    split = first + np.bincount(group, weights=sub == i).astype(np.int64)
    start = np.where(i == j, at + 1, split[group])
    count = np.where((i == j) | (sub == i), end - start, 0)
    number = (key >> (BITS * (CHUNK - ERRORS))).astype(np.int64)
    upto = np.cumsum(count)
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, side="right")))
        c = count[lo:hi]
        p = np.repeat(at[lo:hi], c)
        q = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(start[lo:hi], c)
        ok = (label[p] != label[q]) & (100 * np.minimum(n[p], n[q]) >= percent * np.maximum(n[p], n[q]))
        p, q = p[ok], q[ok]
        for chunk in range(POSITIONS // CHUNK):  # dropped here if an earlier chunk has a key in common
            if not len(p):
                break
            mine, here = number[p] // len(WAYS), slice(chunk * CHUNK, (chunk + 1) * CHUNK)
            same = sig[p, here] == sig[q, here]
            ok = (mine < chunk) | ((mine > chunk) & (same.sum(axis=1) < CHUNK - ERRORS))
            now = mine == chunk
            if now.any():
                shared = np.stack([same[:, list(w)].all(axis=1) for w in WAYS], axis=1)
                ok |= now & (shared.argmax(axis=1) == number[p] % len(WAYS)) & shared.any(axis=1)
            p, q = p[ok], q[ok]
        if len(p):
            ok = (sig[p] != sig[q]).sum(axis=1) <= TAU
            if ok.any():
                yield p[ok], q[ok]
        lo = hi


def joining_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(a, b): of the rows' pairs whose sets of hashes pass, those that join what was apart."""
    sets = [np.frombuffer(x, dtype="<u8") for x in rows["hashes"]]
    known, ids = np.unique(np.concatenate(sets), return_inverse=True)
    edges = np.cumsum([0, *map(len, sets)])
    flag = np.zeros(len(known), dtype=bool)
    del known, sets
    n, node = np.diff(edges), rows["node"].to_numpy()
    label = np.unique(rows["label"].to_numpy(), return_inverse=True)[1]
    out: list[tuple[int, int]] = []
    for p, q in near_pairs(rows, percent):
        cuts = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(p)), strict=True):
            x, ys = p[lo], q[lo:hi]
            ys = ys[label[ys] != label[x]]
            if not len(ys):
                continue
            own = ids[edges[x] : edges[x + 1]]
            flag[own] = True
            part = np.concatenate([ids[edges[y] : edges[y + 1]] for y in ys])
            same = np.add.reduceat(flag[part], np.cumsum(n[ys]) - n[ys], dtype=np.int64)
            flag[own] = False
            for y in ys[100 * same >= percent * (n[x] + n[ys] - same)]:
                if label[x] != label[y]:
                    out.append((node[x], node[y]))
                    label[label == label[y]] = label[x]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def links_across(buckets: DataFrame, classes: DataFrame, rows: DataFrame, found: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between components that share a bucket, as many as join them."""
    labelled = buckets.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("many")).where("x <> y")
    mixed = mixed.select("key", F.ceil(F.col("many") / BLOCK).cast("int").alias("parts"))
    sub = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = labelled.join(mixed, "key").withColumn("sub", sub).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("sub", "o").alias("i"), F.greatest("sub", "o").alias("j"), "sub", "node", "label")
    dealt = materialize(dealt.join(classes.select("node", "n", *SIGS), "node"), "mixed")

    def near(frame: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(frame), dtype=bool)
        for p, q in near_pairs(frame, percent):
            hit[p] = hit[q] = True
        return frame.loc[hit, ["key", "i", "j", "sub", "node"]]

    group = ["key", "i", "j"]
    needed = materialize(in_groups(dealt, group, ["sub", "node"], near, "key long, i int, j int, sub int, node long"), "needed")
    texts = texts_of(needed, classes, rows)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer(width)
        for b in batches:
            yield pd.DataFrame({"node": b["node"], "hashes": [signer.hashes(t).astype("<u8").tobytes() for t in b["text"]]})
        signer.known.clear()
        release()

    sets = texts.mapInPandas(hashed, "node long, hashes binary")
    beside = dealt.join(needed, [*group, "sub", "node"]).join(sets, "node")
    pairs = in_groups(beside, group, ["sub", "node"], lambda frame: joining_links(frame, percent), "a long, b long")
    return materialize(confirm(materialize(pairs, "across"), texts, width, percent), "more")


def linked_classes(rows: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signed rows; the classes (node, no_id, id, tag: their first row, c1, c2); and (node, component) of the linked ones."""
    signed = materialize(signatures(rows, width), "signatures")
    first = signed.where("n > 0").groupBy("c1", "c2").agg(F.min(F.struct(*NAME, "n", *SIGS)).alias("r"))
    classes = materialize(first.select(F.monotonically_increasing_id().alias("node"), "c1", "c2", "r.*"), "classes")
    keys = classes.select("node", F.explode(chunk_keys()).alias("key"))
    full = keys.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("many")).where("many > 1")
    buckets = materialize(keys.join(full, "key").select("key", "node", "least"), "buckets")

    sides = {p: classes.select(F.col("node").alias(p), F.col("n").alias(f"{p}n"), *[F.col(s).alias(f"{p}{s}") for s in SIGS]) for p in "ab"}
    near = (differing("a", "b") <= TAU) & (100 * F.least("an", "bn") >= percent * F.greatest("an", "bn"))
    stars = buckets.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    tried = materialize(stars.join(sides["a"], "a").join(sides["b"], "b").where(near).select("a", "b"), "tried")
    texts = texts_of(tried.select(F.explode(F.array("a", "b")).alias("node")), classes, rows)
    linked = materialize(confirm(tried, texts, width, percent), "linked")
    found = components(linked)
    more = links_across(buckets, classes, rows, found, width, percent)
    if not more.isEmpty():
        found = components(linked.union(more))
    return signed, classes, found


def with_first(classes: DataFrame, found: DataFrame) -> DataFrame:
    """c1, c2, f (no_id, id, tag of the first row of the class's component)."""
    own = classes.join(found, "node", "left").select("c1", "c2", F.struct(*NAME).alias("own"), F.coalesce("component", "node").alias("component"))
    least = own.groupBy("component").agg(F.min("own").alias("f"))
    return own.join(least, "component").select("c1", "c2", "f")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id = component_id)."""
    rows = named(docs, id_col, text_col, F.xxhash64(F.col(text_col)))
    signed, classes, found = linked_classes(rows, width, percent)
    whole = signed.select("no_id", "id", "n", "c1", "c2").join(with_first(classes, found), ["c1", "c2"], "left")
    f = F.coalesce("f", F.struct("no_id", "id", F.lit(0).cast("long").alias("tag")))
    given = lambda c: F.when(~c["no_id"], c["id"])
    out = whole.select(F.struct("no_id", "id").alias("own"), "n", f.alias("f"))
    kept = (F.col("own.no_id") == F.col("f.no_id")) & (F.col("own.id") == F.col("f.id"))
    return out.select(given(F.col("own")).alias("doc_id"), F.col("n").alias("n_shingles"), given(F.col("f")).alias("component_id"), kept.alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Of the rows of each component the one with the smallest id (null last) stays, just one however many share the
    id; of texts under one id the one whose row has the smallest hash. Rows without words stay all. Columns are those of docs."""
    hashable = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    no_id, number, tag = fresh_names(docs, "_no_id", "_id", "_tag")
    keyed = docs.withColumns({tag: F.xxhash64(*[F.col(c) for c in hashable]), no_id: F.col(id_col).cast("long").isNull(), number: F.coalesce(F.col(id_col).cast("long"), F.lit(0))})
    _, classes, found = linked_classes(named(docs, id_col, text_col, F.xxhash64(*[F.col(c) for c in hashable])), width, percent)
    kept = with_first(classes, found).select("f.*").distinct().toDF(no_id, number, tag)
    stay = keyed.where(has_words(F.col(text_col))).join(kept, [no_id, number, tag], "left_semi").dropDuplicates([no_id, number, tag])
    return stay.unionByName(keyed.where(~has_words(F.col(text_col)))).select(*docs.columns)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)
