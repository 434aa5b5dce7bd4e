r"""Token-ID output: shards of concatenated ids with Elias-Fano document boundaries.

Layout of a shard (little-endian): ids of all its documents, end to end, each
ID_BYTES wide (2 if the vocabulary allows, else 4); an Elias-Fano sequence
of the documents' ends; one of their ids above the smallest, ascending; a JSON
footer with the places of these; the footer's length (8 bytes); b"EFTOK001".

An Elias-Fano sequence of n ascending numbers below u keeps the low
l = floor(log2(u/n)) bits of each packed, and the rest in unary in a bit
vector of at most 2n + u/2^l bits: under 2 + log2(u/n) bits a number. Every
SAMPLE-th one's place in the vector is kept, so select(k) reads one short run
of words; a boundary costs about 2 bytes where a 64-bit table takes 8.

Shards are ranges of document ids: a range partitioning orders documents over
shards, a sort orders them inside. A task writes its shard to a name of its own
attempt, and the list of shards names the files of the attempts that succeeded;
so a lost executor or a task run twice leaves no wrong reader. The list (one row a
shard) is all that meets on the driver; offsets of shards are its running sums.

Defined results: null or empty text is a document with the end id only; a
null id comes before all others; repeated ids stay, ordered by a hash of their text; an empty
table gives no shards and an empty result. Other columns are not used.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import chunks, vocabulary
from .common import fresh_dir, release, table

CHUNK = 1 << 22  # characters encoded at once

MAGIC, SAMPLE, END_ID = b"EFTOK001", 256, 1


class EliasFano:
    """Ascending numbers (repeats allowed) from 0 on; of(values) builds, get(k) selects, slice(a, b) decodes a run."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, b"", b"", np.zeros(0, dtype="<u8"))
        low_bits = max(0, (int(v[-1]) // n).bit_length() - 1)
        bits = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        places = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        vector = np.zeros(int(places[-1]) + 1, dtype=np.uint8)
        vector[places] = 1
        return cls(n, low_bits, low, np.packbits(vector, bitorder="little").tobytes(), places[::SAMPLE].astype("<u8"))

    def slice(self, a: int, b: int) -> np.ndarray:
        if not 0 <= a <= b <= self.n:
            raise IndexError((a, b, self.n))
        if a == b:
            return np.zeros(0, dtype=np.uint64)
        s = a // SAMPLE  # select: from the sample before a, to the one after b
        first = int(self.samples[s])
        last = int(self.samples[-(-b // SAMPLE)]) + 1 if -(-b // SAMPLE) < len(self.samples) else len(self.high) * 8
        bits = np.unpackbits(np.frombuffer(self.high, dtype=np.uint8)[first // 8 : -(-last // 8)], bitorder="little")
        ones = np.flatnonzero(bits[first % 8 :]) + first
        k = np.arange(a, b)
        top = (ones[k - s * SAMPLE] - k).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return top
        lo, hi = a * self.low_bits, b * self.low_bits
        bits = np.unpackbits(np.frombuffer(self.low, dtype=np.uint8)[lo // 8 : -(-hi // 8)], bitorder="little")[lo % 8 :][: hi - lo]
        return top | (bits.reshape(-1, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def get(self, k: int) -> int:
        return int(self.slice(k, k + 1)[0])

    def dump(self) -> tuple[bytes, dict]:
        return self.samples.tobytes() + self.high + self.low, {"n": self.n, "low_bits": self.low_bits, "samples": len(self.samples), "high": len(self.high), "low": len(self.low)}

    @classmethod
    def load(cls, data: bytes, meta: dict) -> EliasFano:
        a = meta["samples"] * 8
        b = a + meta["high"]
        return cls(meta["n"], meta["low_bits"], data[b : b + meta["low"]], data[a:b], np.frombuffer(data[:a], dtype="<u8"))


class ShardWriter:
    """Appends documents to an open binary file; close() adds boundaries, ids and footer."""

    def __init__(self, out, id_bytes: int = 2):
        self.out, self.id_bytes, self.tokens = out, id_bytes, 0
        self.ends: list[int] = []
        self.ids: list[int] = []
        self.nulls = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: packed id_bytes each."""
        self.out.write(ids)
        self.tokens += len(ids) // self.id_bytes
        self.ends.append(self.tokens)
        if doc_id is None:
            self.nulls += 1
        else:
            self.ids.append(doc_id)

    def close(self) -> dict:
        base = self.ids[0] if self.ids else 0
        ends, m1 = EliasFano.of(np.array(self.ends, dtype=np.uint64)).dump()
        ids, m2 = EliasFano.of(np.array([x - base for x in self.ids], dtype=np.uint64)).dump()
        at = self.tokens * self.id_bytes
        foot = {"id_bytes": self.id_bytes, "docs": len(self.ends), "tokens": self.tokens, "nulls": self.nulls, "base": base, "ends": m1 | {"at": at, "size": len(ends)}, "ids": m2 | {"at": at + len(ends), "size": len(ids)}}
        text = json.dumps(foot).encode()
        self.out.write(ends + ids + text + len(text).to_bytes(8, "little") + MAGIC)
        self.out.close()
        return foot


class ShardReader:
    """Random access to a shard: ids of documents k..m by two selects and one read."""

    def __init__(self, source, size: int):
        self.source = source
        tail = self._read(size - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token shard, or a broken one")
        n = int.from_bytes(tail[:8], "little")
        self.foot = json.loads(self._read(size - 16 - n, n))
        f = self.foot
        self.ends = EliasFano.load(self._read(f["ends"]["at"], f["ends"]["size"]), f["ends"])
        self.ids = EliasFano.load(self._read(f["ids"]["at"], f["ids"]["size"]), f["ids"])

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return bytes(self.source.read(n))

    def __len__(self) -> int:
        return self.foot["docs"]

    def doc_ids(self, a: int, b: int) -> list[int | None]:
        nulls = self.foot["nulls"]
        found = self.ids.slice(max(a - nulls, 0), max(b - nulls, 0)).tolist()
        return [None] * (min(b, nulls) - min(a, nulls)) + [self.foot["base"] + x for x in found]

    def bounds(self, a: int, b: int) -> np.ndarray:
        """Where documents a..b-1 start, and where the last ends."""
        return np.concatenate(([self.ends.get(a - 1) if a else 0], self.ends.slice(a, b))).astype(np.int64)

    def documents(self, a: int, b: int) -> list[np.ndarray]:
        at, w = self.bounds(a, b), self.foot["id_bytes"]
        ids = np.frombuffer(self._read(int(at[0]) * w, int(at[-1] - at[0]) * w), dtype=f"<u{w}")
        return [ids[x - at[0] : y - at[0]] for x, y in zip(at[:-1], at[1:], strict=True)]


def file_system(uri: str):
    """pyarrow's file system for a folder, and the folder's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


#: The normaliser and the splitter that Encoder's short cuts rest on.
SHORT_CUTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "model": {"type": "BPE", "dropout": None, "end_of_word_suffix": "</w>"},
}


def short_cuts_hold(told: dict) -> bool:
    """Whether a tokenizer's description has just these parts, and no added token that could be found in a lowered word."""
    model = {k: told["model"].get(k) for k in SHORT_CUTS["model"]}
    marks = all(t["content"].startswith("<|") and t["special"] and not t["normalized"] for t in told["added_tokens"])
    return marks and model == SHORT_CUTS["model"] and all(told[k] == SHORT_CUTS[k] for k in ("normalizer", "pre_tokenizer"))


class Encoder:
    """ids(texts) by the tokenizers library. A tokenizer of other parts than SHORT_CUTS gets whole texts; otherwise: Neither normaliser nor splitter of the vocabularies used here looks across
    ASCII blanks, so each distinct piece between blanks is encoded once and its ids are kept (CACHE pieces at most).
    Pieces are lowered first where that is what the normaliser does (characters below U+0250), marks at the end of a
    word are pieces of their own, and words of letters alone go to the library in one line, to be told apart by
    the ends of words in their tokens."""

    CACHE, KEPT = 1 << 19, 1 << 17

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocab.values()) < 1 << 16 else 4
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.high = re.compile("[^\\x00-\u024f]|\u0130")
        self.known: dict[str, bytes] = {}
        self.split = short_cuts_hold(json.loads(self.tok.to_str()))

    def _encode(self, pieces: list[str]) -> Iterator[bytes]:
        got = self.tok.encode_batch_fast(pieces, add_special_tokens=False)
        return (np.array(e.ids, dtype=f"<u{self.width}").tobytes() for e in got)

    def _learn(self, new: list[str]) -> None:
        known = self.known
        letters = [w for w in new if w.isalpha()]
        for lo in range(0, len(letters), 4096):
            part = letters[lo : lo + 4096]
            ids = np.array(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=f"<u{self.width}")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(part):
                raw, at = ids.tobytes(), (np.concatenate(([0], cut)) * self.width).tolist()
                known.update((w, raw[a:b]) for w, a, b in zip(part, at[:-1], at[1:], strict=True))
            else:
                known.update(zip(part, self._encode(part), strict=True))
        others = [w for w in new if not w.isalpha()]
        parts = [w.rstrip(".,;:!?*#$%&") for w in others]
        # a tail is a token run of its own only after a letter or digit
        bases = [p if p[-1:].isascii() and p[-1:].isalnum() and len(p) < len(w) and p.isalpha() else "" for w, p in zip(others, parts, strict=True)]
        need = {x for w, b in zip(others, bases, strict=True) if b for x in (b, w[len(b) :])}.difference(known)
        if need:
            self._learn_flat([*need])
        whole = [w for w, b in zip(others, bases, strict=True) if not b]
        for lo in range(0, len(whole), 20_000):
            known.update(zip(whole[lo : lo + 20_000], self._encode(whole[lo : lo + 20_000]), strict=True))
        known.update((w, known[b] + known[w[len(b) :]]) for w, b in zip(others, bases, strict=True) if b)

    def _learn_flat(self, need: list[str]) -> None:
        letters = [w for w in need if w.isalpha()]
        if letters:
            self._learn(letters)
        tails = [w for w in need if not w.isalpha()]
        self.known.update(zip(tails, self._encode(tails), strict=True))

    def trim(self) -> None:
        """Between tasks only the KEPT pieces met first stay, as most texts have them."""
        self.known = dict(islice(self.known.items(), self.KEPT))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed self.width bytes each."""
        if not self.split:
            return list(self._encode(texts))
        split = [(t if "<|" in t or self.high.search(t) else t.lower()).split(" ") for t in map(_spaced, texts)]
        if len(self.known) > self.CACHE:
            self.trim()
        known = self.known
        known[""] = b""
        new = list(set().union(*split).difference(known))
        self._learn(new)
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > 64:
                del known[w]
        return out


def _spaced(text: str) -> str:
    for blank in "\n\t\r\x0b\x0c":
        if blank in text:
            text = text.replace(blank, " ")
    return text


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_shards(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> list[dict]:
    """Encodes and writes all documents; returns the list of shards in order of their ids, with start (ids in shards before)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc = encoder(path)
        part, writer, name = TaskContext.get().partitionId(), None, f"{folder}/shard-{uuid.uuid4().hex}.eftok"
        system, root = file_system(folder)
        for b in batches:
            texts = ["" if t is None else t for t in b["text"]]
            ids = b["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)
            for lo, hi in chunks(texts, CHUNK):
                for i, x in zip(ids[lo:hi], enc.ids(texts[lo:hi]), strict=True):
                    if writer is None:
                        system.create_dir(root, recursive=True)
                        writer = ShardWriter(system.open_output_stream(f"{root}/{os.path.basename(name)}"), enc.width)
                    writer.add(i, x + int(end_id).to_bytes(enc.width, "little"))
        enc.trim()
        release()
        if writer is not None:
            foot = writer.close()
            yield pd.DataFrame({"part": [part], "file": [os.path.basename(name)], "docs": [foot["docs"]], "tokens": [foot["tokens"]]})

    # by the text's hash as well: rows of one id, or without any, are dealt over several tasks
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    shards, start = [], 0
    for r in sorted(dealt.mapInPandas(run, "part int, file string, docs long, tokens long").collect(), key=lambda r: r["part"]):
        shards.append({"folder": folder, "file": r["file"], "start": start, "docs": r["docs"], "tokens": r["tokens"]})
        start += r["tokens"]
    return shards


def read_shards(spark: SparkSession, shards: list[dict], block: int = 4096) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from the files."""
    rows = [(s["folder"], s["file"], s["start"]) for s in shards]
    frame = spark.createDataFrame(rows, "folder string, file string, start long").repartition(max(1, len(rows)), "file")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for folder, file, start in b.itertuples(index=False):
                system, root = file_system(folder)
                name = f"{root}/{file}"
                with system.open_input_file(name) as source:
                    r = ShardReader(source, system.get_file_info(name).size)
                    for a in range(0, len(r), block):
                        z = min(a + block, len(r))
                        at = r.bounds(a, z)
                        yield pd.DataFrame({
                            "doc_id": pd.array(r.doc_ids(a, z), dtype="Int64").to_numpy(dtype=object, na_value=None),
                            "start": at[:-1] + start, "n_tokens": np.diff(at),
                            "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in r.documents(a, z)],
                        })

    return frame.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_shards(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), fresh_dir(spark, "tokens"))
    return read_shards(spark, shards)
