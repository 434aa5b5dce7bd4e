"""BPE encoding and decoding by a pair occurrence index.

The pieces of text between merges ("pretokens") of a chunk of a partition are
made distinct and laid end to end in one array of symbols, linked both ways
within each piece. An index maps every rank to the places where its pair
stands. Active ranks are taken from a heap in ascending order; all places of a
rank are merged at once, and only the pairs next to a merge are looked up anew and
added to their lists. As pieces don't touch each other, this equals merging
each piece's lowest rank first. A rank costs a few array operations however many places it has, so many texts
are encoded at once: a text waits as the numbers of its words, until NEW words are new
or CHUNK characters wait. The ids of words that come again are kept.

Every document is encoded whole and alone: partitions need no shuffle, a lost
executor costs the repetition of its tasks, and memory is bounded by NEW and CACHE
words and the numbers of CHUNK characters of text (of one text, if it is longer).

Defined results: null or empty text gives no ids and decodes to the empty
text; the strings of special tokens in a text become their ids, as in the
library; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, table

#: Characters of texts, and words not met before, that are encoded at once; words kept for what comes; characters handed on at once.
CHUNK, NEW, CACHE, SLICE = 1 << 25, 200_000, 200_000, 1 << 21
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Blanks other than single spaces and line feeds inside a text.
IRREGULAR = re.compile(r"[ \n][ \n]|\A[ \n]|[ \n]\Z|[^\S \n]|[\x1c-\x1f]")


class PairIndexBPE:
    """encode(texts) -> little-endian u32 ids as bytes for each text; decode(ids) -> text."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        of = {c: b for b, c in letters.items()}
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        pairs = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pairs.setdefault((vocab[a] << 24) | vocab[b], (rank, vocab[a + b], vocab[a], vocab[b]))
        keys = sorted(pairs)
        self.keys = np.array(keys, dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in keys], dtype=np.int64)
        self.merge = {r: (new, a, b) for r, new, a, b in pairs.values()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.piece_bytes: dict[int, bytes] = {i: bytes(of[c] for c in s) for s, i in vocab.items() if all(c in of for c in s)}
        self.piece_bytes |= {i: s.encode() for s, i in self.special.items()}
        self.findall = regex.compile(PATTERN).findall
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.index: dict = {}  # words by number, in this order
        self.done: list[bytes] = []  # ids of the first of them; the rest are new

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 without one."""
        key = (left.astype(np.int64) << 24) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge_pieces(self, pieces: list[bytes]) -> list[bytes]:
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(ends) else 0
        sym = self.byte_id[np.frombuffer(b"".join(pieces), dtype=np.uint8)].astype(np.int32)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[ends[lengths > 0] - 1] = -1
        prv[(ends - lengths)[lengths > 0]] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(places: np.ndarray) -> None:
            rank = self.lookup(sym[places], sym[nxt[places]])
            places, rank = places[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            edges = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(rank)], strict=True):
                if lo < hi:
                    r = int(rank[lo])
                    if r not in index:
                        index[r] = []
                        heapq.heappush(heap, r)
                    index[r].append(places[lo:hi])

        enter(np.flatnonzero(nxt >= 0).astype(np.int32))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            new, a, b = self.merge[r]
            at = np.unique(lists[0] if len(lists) == 1 else np.concatenate(lists))
            at = at[(sym[at] == a) & (nxt[at] >= 0)]
            at = at[sym[nxt[at]] == b]
            if a == b and len(at) > 1:  # of places in a row every second one stands, from the left
                keep, used = [], -1
                for x in at.tolist():
                    if x != used:
                        keep.append(x)
                        used = int(nxt[x])
                    else:
                        used = -1
                at = np.array(keep, dtype=np.int32)
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at], sym[gone] = new, -1
            nxt[at] = after
            has = after >= 0
            prv[after[has]] = at[has]
            before = prv[at]
            enter(np.concatenate((before[before >= 0], at[has])))
        alive = sym >= 0
        ids = sym[alive].astype("<u4").tobytes()
        upto = np.concatenate(([0], np.cumsum(alive)))[np.concatenate(([0], ends))] * 4
        return [ids[x:y] for x, y in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]

    def parts(self, text: str) -> list[str]:
        """Pretokens of a text and special tokens; the latter are told by self.special."""
        if self.cut is None or not self.cut.search(text):
            return self.findall(text)
        out, last = [], 0
        for m in self.cut.finditer(text):
            out += [*self.findall(text[last : m.start()]), ("", m.group())]
            last = m.end()
        return out + self.findall(text[last:])

    def words(self, text: str) -> list:
        """Parts of a text whose pretokens don't depend on each other: special tokens, and else, if blanks stand alone,
        what follows each blank (kept without a space, with a line feed), or if they don't, the pretokens as (space or not, piece)."""
        if IRREGULAR.search(text) or self.cut is not None and self.cut.search(text):
            return [p if isinstance(p, tuple) else ("", p, "") for p in self.parts(text)]
        first, *rest = text.replace("\n", " \n").split(" ")
        return [("", first, ""), *rest] if first else rest

    def numbers(self, text: str) -> np.ndarray:
        """A text as the numbers of its words."""
        words, index = self.words(text), self.index
        for w in set(words).difference(index):
            index[w] = len(index)
        return np.fromiter(map(index.__getitem__, words), dtype=np.uint32, count=len(words))

    def waiting(self) -> int:
        return len(self.index) - len(self.done)

    def resolve(self) -> None:
        """Encodes the words that are new."""
        findall = self.findall
        parts = []
        for w in islice(self.index, len(self.done), None):
            if isinstance(w, str):
                parts.append(findall(w if w[0] == "\n" else " " + w))
            else:
                parts.append(findall(w[1]) if len(w) == 3 else [w])
        every = set().union(*parts)
        pieces = [p for p in every if isinstance(p, str)]
        ids = dict(zip(pieces, self.merge_pieces([p.encode() for p in pieces]), strict=True))
        if len(pieces) < len(every):
            ids |= {p: int(self.special[p[1]]).to_bytes(4, "little") for p in every if not isinstance(p, str)}
        of = ids.__getitem__
        self.done += [of(ps[0]) if len(ps) == 1 else b"".join(map(of, ps)) for ps in parts]

    def ids(self, numbers: np.ndarray) -> bytes:
        return b"".join(map(self.done.__getitem__, numbers.tolist()))

    def forget(self, texts: list[np.ndarray], most: int = CACHE) -> None:
        """Of more than most words those stay that came twice in the texts just encoded, and aren't long."""
        if len(self.index) > most:
            often = np.bincount(np.concatenate(texts), minlength=len(self.index)) > 1 if texts else np.zeros(len(self.index), dtype=bool)
            kept = [(w, x) for w, x, o in zip(self.index, self.done, often.tolist(), strict=True) if o and len(x) <= 64]
            kept = kept[: most // 2]
            self.index, self.done = {w: i for i, (w, _) in enumerate(kept)}, [x for _, x in kept]

    def encode(self, texts: list[str]) -> list[bytes]:
        numbers = [self.numbers(t) for t in texts]
        self.resolve()
        out = [self.ids(x) for x in numbers]
        self.forget(numbers)
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.piece_bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def codec(path: str) -> PairIndexBPE:
    """One codec for each Python worker."""
    return PairIndexBPE(path)


def ranges(sizes, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of the given sizes with about most in each; a longer text is a range of its own."""
    lo = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield lo, i
            lo, size = i, 0
        size += int(n)
    if lo < len(sizes):
        yield lo, len(sizes)


def chunks(texts: list[str], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    return ranges([len(t) for t in texts], most)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, new: int = NEW) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (binary: little-endian u32) and decoded text.
    new: words encoded at once, and kept; a worker takes some 700 bytes for each, and fewer cost more time."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        held: list[tuple[pa.Array, list[np.ndarray]]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            bpe.resolve()
            for doc_ids, texts in held:
                ids = [bpe.ids(x) for x in texts]
                decoded = [bpe.decode(x) for x in ids]
                cols = [
                    doc_ids, pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()),
                ]
                cols += [pa.array(ids, pa.binary()), pa.array(decoded, pa.string())] if with_ids else []
                yield pa.RecordBatch.from_arrays(cols, names=names)
            bpe.forget([x for _, texts in held for x in texts], new)
            held.clear()

        size = 0
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
            for lo, hi in ranges(sizes, SLICE):
                texts = ["" if t is None else t for t in b.column("text").slice(lo, hi - lo).to_pylist()]
                held.append((pa.array(b.column("doc_id").slice(lo, hi - lo).to_pylist(), pa.int64()), [bpe.numbers(t) for t in texts]))
                size += int(sizes[lo:hi].sum())
                if size >= CHUNK or bpe.waiting() >= new:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()
        bpe.index, bpe.done = {}, []
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
