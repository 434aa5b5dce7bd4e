"""Language-model scores by a hierarchical Pitman-Yor model.

Every context is a restaurant: the word before, by its 64-bit hash (a text's start is one
of its own). All context restaurants share one parent, whose customers are their tables.
A word w in context u has
c customers at t tables; with discount d and strength s,
    P(w | u) = (c - d t + (s + d T_u) P(w)) / (s + N_u),
    P(w)     = (c0 - d0) / (s0 + N0)    (c0: tables of w in all contexts),
and a word never seen has the parent's mass for new dishes, (s0 + d0 V) / (s0 + N0).
These sum to one over the V words and "unseen".

Gibbs sampling: a sweep empties, for each context and word, the tables of that word
and seats its customers anew one after another, given the tables of all the rest
as the sweep before left them: a customer opens a table with odds
(s + d T_u) P(w) against c - d t. Sweeps are synchronised by the totals T_u. Discounts come
from the counts of counts. The first BURN sweeps, which still show the start of one table for each pair, are
discarded; predictive probabilities of the SAMPLES sweeps after them are averaged.

Layout: a map task turns a chunk of texts into numbers: its distinct words, in the order of
their hashes, and its distinct (word, context) pairs with training counts. The tokens stay in
a file of the chunk in the shared folder. Pairs go, packed, to the owner of the word's hash:
words of a hot context are spread over all owners, and a hot word is one entry for each chunk;
the contexts of one word stay with its owner. Owners hold counts and seat customers. The
totals T_u are a table dealt by the context's hash, with the owner of u as a word: owners send
it the sums of their tables, and get back the totals of the contexts whose pairs have more than
one customer (others can't be reseated); only sums of all come to the driver. In the end owners answer each
chunk with the tables of its pairs and the totals of its words, which as contexts are the
restaurants of the chunk's pairs; chunk by chunk these meet the tokens. What is
shuffled is in proportion to the distinct pairs of chunks, hence to the corpus.
Chunks are named by partition, so that a repeated task writes the same file;
the input must have partitions that repeat (files, or a written table).

Defined results: null or empty text is the end token alone; a null id counts as the
empty string for the held-out rule and stays null; repeated rows are scored each, and
count each in training; without training rows all words are unseen, with probability
1, and base scores follow the formula (V = N = 0); other columns are not used.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import chunks
from .common import fresh_dir, materialize, release, table
from .langid import remainder
from .token_files import file_system

CHUNK, OWNER_CHARS, BURN, SAMPLES, STRENGTH, SEED = 1 << 25, 12_000_000, 1, 2, 1.0, 7
CONTEXTS = 1024  # length of the totals that tests give an Owner; not a bound of contexts
END, START = b"\n", b""  # no word holds a line feed, none is empty


def packed(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def raw(x: bytes, dtype: str) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(x), dtype=dtype)


def rising(a: np.ndarray, dtype: str) -> bytes:
    """Packs ascending numbers by their steps."""
    return packed(np.diff(a.astype(dtype), prepend=np.zeros(1, dtype)))


def risen(x: bytes, dtype: str) -> np.ndarray:
    return np.cumsum(raw(x, dtype), dtype=dtype)


def owner_of(hashes: np.ndarray, owners: int) -> np.ndarray:
    """Ascending with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


def pairs_of(tokens: np.ndarray, lengths: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of texts, (word << 32) | word before, and each token's place among them."""
    key = tokens.astype(np.int64)
    key <<= 32
    key[1:] |= tokens[:-1]
    at = np.cumsum(lengths) - lengths
    key[at] = (tokens[at].astype(np.int64) << 32) | start
    order = np.argsort(key)
    key = key[order]
    first = np.concatenate((np.ones(len(key[:1]), dtype=bool), key[1:] != key[:-1]))
    of = np.empty(len(key), dtype=np.uint32)
    of[order] = np.cumsum(first, dtype=np.uint32) - np.uint32(1)
    return key[first], of


class Chunk:
    """Numbers its words and (word, context) pairs."""

    def __init__(self):
        self.index: dict[bytes, int] = {END: 0, START: 1}
        self.docs: list[tuple] = []
        self.tokens: list[np.ndarray] = []

    def add(self, doc_id, held_out: bool, text: str | None) -> None:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        index = self.index
        for w in set(words).difference(index):
            index[w] = len(index)
        self.tokens.append(np.array([*map(index.__getitem__, words), 0], dtype=np.uint32))
        self.docs.append((doc_id, held_out))

    def close(self, owners: int) -> tuple[dict, list[dict]]:
        """Tokens as numbers of words by hash, and the packed pairs for each owner of words."""
        import xxhash

        names = list(self.index)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), dtype=np.uint64, count=len(names))
        del names
        self.index = {}  # the largest thing here, and done with
        order = np.argsort(hashes)
        rank = np.empty(len(hashes), dtype=np.uint32)
        rank[order] = np.arange(len(hashes), dtype=np.uint32)
        hashes, start = hashes[order], int(rank[1])
        lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        flat = np.concatenate(self.tokens)
        self.tokens = []
        flat = rank[flat]
        train = np.repeat(~np.array([d[1] for d in self.docs], dtype=bool), lengths)
        pairs, of = pairs_of(flat, lengths, start)
        count = np.bincount(of, weights=train, minlength=len(pairs)).astype(np.uint32)
        word, before = pairs >> 32, pairs & 0xFFFFFFFF
        per = np.bincount(word, minlength=len(hashes)).astype("<u4")
        cut_w = np.searchsorted(owner_of(hashes, owners), np.arange(owners + 1, dtype=np.uint64))
        cut_p, out = np.searchsorted(word, cut_w), []
        for k in range(owners):
            w, p = slice(cut_w[k], cut_w[k + 1]), slice(cut_p[k], cut_p[k + 1])
            if cut_w[k] < cut_w[k + 1]:
                contexts, at = np.unique(before[p], return_inverse=True)
                out.append({"owner": k, "words": rising(hashes[w], "<u8"), "per": packed(per[w]), "contexts": rising(hashes[contexts], "<u8"), "context": packed(at.astype("<u4")), "count": packed(count[p])})
        kept = {"tokens": flat, "lengths": lengths, "start": np.array(start), "held_out": np.array([d[1] for d in self.docs], dtype=bool), "null": np.array([d[0] is None for d in self.docs], dtype=bool), "ids": np.array([d[0] or 0 for d in self.docs], dtype=np.int64)}
        return kept, out


def save(folder: str, name: str, arrays: dict) -> None:
    """Written under another name first: a reader never sees half a file."""
    import uuid

    import zstandard

    system, root = file_system(folder)
    system.create_dir(root, recursive=True)
    raw = io.BytesIO()
    np.savez(raw, **arrays)
    part = f"{root}/{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part, compression=None) as out:
        out.write(zstandard.compress(raw.getbuffer(), 3))
    system.move(part, f"{root}/{name}")


def load(folder: str, name: str) -> dict:
    import zstandard

    system, root = file_system(folder)
    with system.open_input_file(f"{root}/{name}") as source:
        return dict(np.load(io.BytesIO(zstandard.decompress(source.read()))))


def gather(docs: DataFrame, folder: str, owners: int) -> DataFrame:
    """(doc_id, held_out, text) -> chunk, owner, words, per, contexts, context, count; leaves a file of tokens for each chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, k, chunk, size = TaskContext.get().partitionId(), 0, Chunk(), 0

        def close() -> pd.DataFrame:
            kept, out = chunk.close(owners)
            save(folder, f"{part}-{k}", kept)
            return pd.DataFrame(out).assign(chunk=f"{part}-{k}")[["chunk", "owner", "words", "per", "contexts", "context", "count"]]

        for b in batches:
            texts = ["" if t is None else t for t in b["text"]]
            ids = b["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)
            for lo, hi in chunks(texts, CHUNK):
                for i, h, t in zip(ids[lo:hi], b["held_out"].iloc[lo:hi], texts[lo:hi], strict=True):
                    if size and size + len(t) > CHUNK:
                        yield close()
                        k, chunk, size = k + 1, Chunk(), 0
                        release()
                    chunk.add(i, bool(h), t)
                    size += len(t) + 8
        if chunk.docs:
            yield close()
        del chunk
        release()

    return docs.mapInPandas(run, "chunk string, owner int, words binary, per binary, contexts binary, context binary, count binary")


def own(packed_rows: DataFrame) -> DataFrame:
    """One row for each owner: its words and pairs with counts of all chunks, and where each chunk's stand."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        release()  # of the owner before
        rows = rows.sort_values("chunk")
        words, around = ([risen(x, "<u8") for x in rows[c]] for c in ("words", "contexts"))
        known, of = np.unique(np.concatenate(words), return_inverse=True)
        contexts, context_of = np.unique(np.concatenate(around), return_inverse=True)
        at, from_ = (np.cumsum([0, *map(len, x)]) for x in (words, around))
        context = [raw(x, "<u4") for x in rows["context"]]
        here = np.concatenate([context_of[a + c] for a, c in zip(from_[:-1], context, strict=True)])
        pair_word = np.repeat(of, np.concatenate([raw(x, "<u4") for x in rows["per"]]))
        pairs, pair_of = np.unique((pair_word.astype(np.int64) << 32) | here, return_inverse=True)
        count = np.bincount(pair_of, weights=np.concatenate([raw(x, "<u4") for x in rows["count"]]), minlength=len(pairs))
        cut = np.cumsum([0, *map(len, context)])
        total = np.bincount(pairs >> 32, weights=count, minlength=len(known))
        return pd.DataFrame({
            "owner": [key[0]], "word": [packed((pairs >> 32).astype("<u4"))], "context": [packed((pairs & 0xFFFFFFFF).astype("<u4"))], "count": [packed(count.astype("<u8"))],
            "total": [packed(total.astype("<u8"))], "words": [rising(known, "<u8")], "contexts": [rising(contexts, "<u8")], "chunks": [rows["chunk"].tolist()],
            "word_at": [[rising(of[a:b], "<u4") for a, b in zip(at[:-1], at[1:], strict=True)]],
            "pair_at": [[rising(pair_of[a:b], "<u4") for a, b in zip(cut[:-1], cut[1:], strict=True)]],
        })

    schema = "owner int, word binary, context binary, count binary, total binary, words binary, contexts binary, chunks array<string>, word_at array<binary>, pair_at array<binary>"
    return packed_rows.groupBy("owner").applyInPandas(run, schema)


def seat(count: np.ndarray, opens: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each pair after its customers sat down; opens: a new table's weight. Up to 64 customers one by one, then from
    table to table: the number of customers until the next table opens is drawn at once. Its tail is a ratio of gamma functions,
    that of a geometric number whose odds are drawn from a beta distribution."""
    tables = (count > 0).astype(np.int64)
    act = np.flatnonzero(count > 1)
    for j in range(1, 64):
        act = act[count[act] > j]
        if not len(act):
            return tables
        a = opens[act]
        tables[act] += rng.random(len(act)) * (j - d * tables[act] + a) < a
    act = act[count[act] > 64]
    seated = np.full(len(act), 64.0)
    while len(act):
        a = np.maximum(opens[act], 1e-12)
        old = np.maximum(seated - d * tables[act], 1e-9)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            seated = seated + np.floor(np.log(1 - rng.random(len(act))) / np.log1p(-rng.beta(a, old))) + 1
        live = seated <= count[act]
        act, seated = act[live], seated[live]
        tables[act] += 1
    return tables


class Owner:
    """An owner's share of the restaurants, and the chain of sweeps up to the given totals."""

    def __init__(self, row: dict, d: float, d0: float):
        self.word = np.frombuffer(row["word"], dtype="<u4").astype(np.int64)
        self.context = np.frombuffer(row["context"], dtype=f"<u{len(row['context']) // max(1, len(self.word)) or 4}").astype(np.int64)
        self.count, self.total = np.frombuffer(row["count"], dtype="<u8").astype(np.int64), np.frombuffer(row["total"], dtype="<u8").astype(np.int64)
        self.owner, self.d, self.d0 = int(row["owner"]), d, d0

    def parent(self, tables: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """P(w) of each word; unseen words get the mass of new dishes. totals: T_u by number of the context, then the tables of
        all the rest, and in the last place V."""
        customers = np.bincount(self.word, weights=tables, minlength=len(self.total))
        n0, v = totals[:-1].sum(), totals[-1]
        return np.where(customers > 0, customers - self.d0, STRENGTH + self.d0 * v) / (STRENGTH + n0)

    def sweep(self, k: int, tables: np.ndarray, totals: np.ndarray) -> np.ndarray:
        opens = (STRENGTH + self.d * totals[self.context]) * self.parent(tables, totals)[self.word]
        return seat(self.count, opens, self.d, np.random.default_rng((SEED, self.owner, k)))

    def chain(self, totals: list[np.ndarray]) -> list[np.ndarray]:
        """Tables at the start (one for each pair), and after each sweep."""
        out = [(self.count > 0).astype(np.int64)]
        for k, t in enumerate(totals):
            out.append(self.sweep(k, out[-1], t))
        return out

    def predictive(self, tables: np.ndarray, totals: np.ndarray, customers: np.ndarray) -> np.ndarray:
        return predict(self.count, tables, totals[self.context], customers[self.context], self.parent(tables, totals)[self.word], self.d)


def predict(count, tables, total, customers, parent, d: float) -> np.ndarray:
    """P(w | u) of pairs: their customers and tables, the T_u and N_u of their contexts, the P(w) of their words."""
    return (count - d * tables + (STRENGTH + d * total) * parent) / (STRENGTH + customers)


class Share(Owner):
    """An owner's row with its words and contexts by hash."""

    def __init__(self, row: dict, d: float, d0: float):
        import zstandard

        super().__init__({k: zstandard.decompress(row[k]) if k in ("word", "context", "count", "total") else row[k] for k in row}, d, d0)
        self.words, self.contexts = risen(row["words"], "<u8"), risen(row["contexts"], "<u8")
        self.active = np.unique(self.context[self.count > 1])

    def known(self, folder: str, sums: list[float], v: float) -> list[np.ndarray]:
        """totals for each sweep whose sum of all tables is given; of the active contexts, the rest in one number."""
        out = []
        for k, n0 in enumerate(sums):
            t = np.zeros(len(self.contexts) + 2)
            t[self.active] = load(folder, f"totals-{k}-{self.owner}")["totals"]
            t[-2:] = n0 - t.sum(), v
            out.append(t)
        return out

    def start_customers(self) -> int:
        """Training texts, where this is the owner of their end."""
        import xxhash

        return int(self.total[self.words == np.uint64(xxhash.xxh3_64_intdigest(END))].sum())


COLUMNS = ["owner", "word", "context", "count", "total", "words", "contexts"]


def _sums(owned: DataFrame, d: float, d0: float) -> list[float]:
    """Over all owners: training tokens, pairs and words; training texts; pairs of one and two customers; words of one and two contexts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                o = Share(row, d, d0)
                contexts = np.bincount(o.word[o.count > 0], minlength=len(o.total))
                x = (o.count.sum(), (o.count > 0).sum(), (o.total > 0).sum(), o.start_customers(), (o.count == 1).sum(), (o.count == 2).sum(), (contexts == 1).sum(), (contexts == 2).sum())
                yield pd.DataFrame({f"x{i}": [float(y)] for i, y in enumerate(x)})

    cols = [f"x{i}" for i in range(8)]
    got = owned.select(*COLUMNS).mapInPandas(run, ", ".join(f"{c} double" for c in cols)).agg(*[F.sum(c) for c in cols]).collect()[0]
    return [float(x or 0) for x in got]


def share_totals(owned: DataFrame, folder: str, owners: int, sums: list[float], v: float, d: float, d0: float) -> float:
    """Brings the T_u after sweep len(sums) to those who need them; returns the sum of all. Contexts are dealt like words. The
    first time (one table for each pair) owners name their contexts, later they send what may have changed in the same order."""
    k = len(sums)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                o = Share(row, d, d0)
                tables = o.chain(o.known(folder, sums, v))[-1]
                n = np.bincount(o.context, weights=tables, minlength=len(o.contexts)).astype("<u4")
                active = np.zeros(len(n), dtype=np.uint8)
                active[o.active] = 1
                use = np.flatnonzero(active) if k else np.flatnonzero(n)
                to = owner_of(o.contexts[use], owners)
                out = []
                for s in np.union1d(np.unique(to), [o.owner]):
                    at = use[slice(*np.searchsorted(to, np.array([s, s + 1], dtype=np.uint64)))]
                    out.append({"shard": int(s), "owner": o.owner, "keys": b"" if k else rising(o.contexts[at], "<u8"), "active": b"" if k else packed(active[at]), "tables": packed(n[at])})
                yield pd.DataFrame(out)

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard, rows = int(key[0]), rows.sort_values("owner")
        n, who = [raw(x, "<u4") for x in rows["tables"]], rows["owner"].to_numpy(dtype=np.int64)
        if k:
            held = load(folder, f"shard-{shard}")
            total, cut = held["base"].copy(), held["cut"]
            at = [held["at"][cut[i] : cut[i + 1]] for i in np.searchsorted(held["who"], who)]
            for a, x in zip(at, n, strict=True):
                total += np.bincount(a, weights=x, minlength=len(total))
        else:
            keys, of = np.unique(np.concatenate([risen(x, "<u8") for x in rows["keys"]]), return_inverse=True)
            active, n = np.concatenate([raw(x, "u1") for x in rows["active"]]) > 0, np.concatenate(n)
            total = np.bincount(of, weights=n, minlength=len(keys)).astype(np.float64)
            base = np.bincount(of[~active], weights=n[~active], minlength=len(keys)).astype(np.float64)
            ends = np.cumsum([0, *[len(raw(x, "u1")) for x in rows["active"]]])
            cut = np.concatenate(([0], np.cumsum(active)))[ends]
            held_at = of[active].astype("<u4")
            at = [held_at[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            save(folder, f"shard-{shard}", {"keys": keys, "base": base, "at": held_at, "cut": cut, "who": who})
        save(folder, f"contexts-{k}-{shard}", {"totals": total})
        return pd.DataFrame({"owner": who, "shard": shard, "totals": [packed(total[a].astype("<u4")) for a in at], "mass": np.where(who == shard, total.sum(), 0.0)})

    def keep(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        save(folder, f"totals-{k}-{int(key[0])}", {"totals": np.concatenate([raw(x, "<u4") for x in rows["totals"]])})
        return pd.DataFrame({"mass": [rows["mass"].sum()]})

    sent = owned.select(*COLUMNS).mapInPandas(send, "shard int, owner int, keys binary, active binary, tables binary")
    back = sent.groupBy("shard").applyInPandas(add, "owner int, shard int, totals binary, mass double")
    return float(back.groupBy("owner").applyInPandas(keep, "mass double").agg(F.sum("mass")).collect()[0][0] or 0)


def _discount(n1: float, n2: float) -> float:
    return float(min(0.95, max(0.05, n1 / (n1 + 2 * n2)))) if n1 + n2 else 0.5


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, burn: int = BURN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns from the rows not held out."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    folder = fresh_dir(spark, "chunks")
    owners = max(12, -(-chars // OWNER_CHARS))
    owned = materialize(own(gather(rows, folder, owners)), "owners")
    n, _, v, texts, n1, n2, m1, m2 = _sums(owned, 0.5, 0.5)
    d, d0 = _discount(n1, n2), _discount(m1, m2)
    sums: list[float] = []
    for _ in range(burn + samples + 1):
        sums.append(share_totals(owned, folder, owners, list(sums), v, d, d0))

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            for row in b.to_dict("records"):
                o = Share(row, d, d0)
                totals = o.known(folder, sums, v)
                chain = o.chain(totals[:-1])[1 + burn :]
                parent = [o.parent(t, x) for t, x in zip(chain, totals[1 + burn :], strict=True)]
                keys = load(folder, f"shard-{o.owner}")["keys"]
                at = np.minimum(np.searchsorted(keys, o.words), max(0, len(keys) - 1))
                found = keys[at] == o.words if len(keys) else np.zeros(len(at), dtype=bool)
                tables = [np.where(found, load(folder, f"contexts-{k}-{o.owner}")["totals"][at], 0) if len(keys) else np.zeros(len(at)) for k in range(burn + 1, burn + samples + 1)]
                customers = np.where(o.words == np.uint64(xxhash.xxh3_64_intdigest(START)), int(texts), o.total)
                for c, w, q in zip(row["chunks"], row["word_at"], row["pair_at"], strict=True):
                    w, q = risen(w, "<u4"), risen(q, "<u4")
                    yield pd.DataFrame({
                        "chunk": [c], "owner": [o.owner], "total": [packed(o.total[w])], "customers": [packed(customers[w])], "count": [packed(o.count[q].astype("<u4"))],
                        "parent": [[packed(x[w]) for x in parent]], "totals": [[packed(x[w].astype("<u4")) for x in tables]], "tables": [[packed(x[q].astype("<u4")) for x in chain]],
                    })

    def finish(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        release()  # of the chunk before
        part, kept = part.sort_values("owner"), load(folder, key[0])
        whole = lambda c, dtype: np.concatenate([raw(x, dtype) for x in part[c]])
        nth = lambda c, k, dtype: np.concatenate([raw(x[k], dtype) for x in part[c]])
        total, customers, count = whole("total", "<i8"), whole("customers", "<i8"), whole("count", "<u4")
        pairs, of = pairs_of(kept["tokens"], kept["lengths"], int(kept["start"]))
        word, before = pairs >> 32, pairs & 0xFFFFFFFF
        p = np.zeros(len(pairs))
        for k in range(samples):
            p += predict(count, nth("tables", k, "<u4"), nth("totals", k, "<u4")[before], customers[before], nth("parent", k, "<f8")[word], d) / samples
        cuts = np.cumsum(kept["lengths"]) - kept["lengths"]
        base = np.log10((total + 0.5) / (n + 0.5 * (v + 1)))
        ids = pd.array(kept["ids"], dtype="Int64")
        ids[kept["null"]] = pd.NA
        return pd.DataFrame({
            "doc_id": ids.to_numpy(dtype=object, na_value=None), "held_out": kept["held_out"], "n_tokens": kept["lengths"], "n_known": np.add.reduceat((total > 0).astype(np.int64)[kept["tokens"]], cuts),
            "train_tokens": int(n), "base_score": np.add.reduceat(base[kept["tokens"]], cuts), "score": np.add.reduceat(np.log10(np.maximum(p, 1e-300))[of], cuts),
        })

    answers = owned.mapInPandas(answer, "chunk string, owner int, total binary, customers binary, count binary, parent array<binary>, totals array<binary>, tables array<binary>")
    return answers.groupBy("chunk").applyInPandas(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 5) == 1)
