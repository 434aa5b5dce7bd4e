r"""Personal data: base patterns, and a semi-Markov conditional random field over them.

Base spans are what the four patterns of the contract find, leftmost and not overlapping
for each kind, without retries when a match fails its test. Patterns are applied in
linear time whatever the text (runs are found first, then tested).

The field sees the regions of a text that hold digits or "@": white-space separated
tokens with one, joined over single spaces. A region is cut into atoms (runs of digits, runs
of letters, single other characters). A candidate segment is a run of at most ATOMS
atoms that could be an entity by its characters; every other atom is a segment of its
own outside. Features describe whole segments (digits, groups, separators, checksum,
octets, what stands before and after, words before), so that a checksum over
all of a number counts, which no tagging of single characters sees. Dynamic
programming over (place, kind) with bounded segments picks boundaries and kinds
jointly; training maximises the conditional likelihood with the same
recursion (forward and backward), on TRAIN generated regions with
hard negatives, from a fixed seed. So numbers that the base patterns run together
("+1 (269) 555-3296 4524132264652876") come apart. The model adds spans where
no base span lies; base spans stay as they are.

A row is worked on alone and whole, without shuffle; tasks can be repeated anywhere.

Defined results: null or empty text has no spans; positions are code points, the end is
exclusive; spans are sorted by start, then email, ip, card, phone; n_* count base
spans, added counts the others; repeated rows give equal rows; other columns are not used.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
ATOMS, TRAIN, EPOCHS, SEED = 24, 500, 6, 11
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        x = ord(c) - 48
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > last and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at) if lo < at else None
        if m:
            out.append(("email", lo, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            last = at + 1  # what stands before an "@" can't be part of a later match
            at = text.find("@", last)
    for m in _DOTTED.finditer(text):
        if m.group().count(".") >= 3:
            parts = [(p.start() + m.start(), p.end() + m.start(), p.group()) for p in re.finditer("[0-9]+", m.group())]
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                if all(len(p[2].lstrip("0")) <= 3 and int(p[2].lstrip("0") or "0") <= 255 for p in four):
                    out.append(("ip", four[0][0], four[3][1]))
    for m in _CARD.finditer(text):
        d = digits(m.group()) if m.end() - m.start() <= 64 else ""
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Runs of tokens with a digit or "@", one space apart."""
    lo = hi = -1
    for m in _TOKEN.finditer(text):
        if not _ANY.search(text, m.start(), m.end()):
            continue
        if lo >= 0 and m.start() == hi + 1 and text[hi] == " ":
            hi = m.end()
            continue
        if lo >= 0:
            yield lo, hi
        lo, hi = m.start(), m.end()
    if lo >= 0:
        yield lo, hi


def side(c: str) -> str:
    return "0" if c.isdigit() else "a" if c.isalpha() else "." if c in ".@-+_%=/:" else " "


_CUES = (("phone", re.compile(r"(?i)(phone|tel|call|mobile|fax|whatsapp)\W*$")), ("ip", re.compile(r"(?i)(\bip|host|server|addr\w*)\W*$")), ("card", re.compile(r"(?i)(card|visa|pan|credit)\W*$")), ("email", re.compile(r"(?i)(e-?mail|contact)\W*$")))


def features(kind: str, s: str, before: str, after: str) -> list[str]:
    """Of a whole segment; before is up to 24 characters, after two."""
    d = digits(s)
    out = [f"{kind}|left{side(before[-1:] or ' ')}", f"{kind}|right{' ' if after[:1] in (*'.,',) and not after[1:].isalnum() else side(after[:1] or ' ')}", kind]
    out += [f"{kind}|cue {k}" for k, p in _CUES if p.search(before)]
    if kind == "email":
        local, _, domain = s.partition("@")
        labels = domain.split(".")
        good = bool(local) and len(labels) > 1 and all(x and not x.startswith("-") and not x.endswith("-") for x in labels)
        out += [f"email|good{good}", f"email|top{labels[-1].isalpha() and len(labels[-1]) >= 2}", f"email|edge{local[:1] == '.' or local[-1:] == '.' or '..' in local}"]
    elif kind == "ip":
        parts = s.split(".")
        out += [f"ip|parts{min(len(parts), 6)}", f"ip|octets{all(p.isdigit() and int(p[:4]) <= 255 for p in parts)}", f"ip|zero{any(len(p) > 1 and p[0] == '0' for p in parts)}"]
        out.append(f"ip|valid{len(parts) == 4 and all(p.isdigit() and int(p[:4]) <= 255 for p in parts)}")
    elif kind == "card":
        n, groups = len(d), [len(x) for x in re.split(r"[ -]", s)]
        style = "solid" if len(groups) == 1 else "fours" if all(x == 4 for x in groups[:-1]) or groups in ([4, 6, 5], [4, 6, 4]) else "other"
        out += [f"card|n{'few' if n < 14 else 'many' if n > 19 else 'ok'}", f"card|luhn{luhn(d)}|{style}", f"card|first{d[:1]}", f"card|16{n in (15, 16)}", f"card|valid{14 <= n <= 19 and luhn(d)}"]
    else:
        n, groups = len(d), re.findall(r"[0-9]+", s)
        out += [f"phone|n{'few' if n < 10 else 'many' if n > 15 else 'ok'}", f"phone|plus{s[0] == '+'}|{'ok' if 10 <= n <= 15 else 'bad'}", f"phone|groups{min(len(groups), 6)}", f"phone|paren{'(' in s and s.count('(') == s.count(')')}", f"phone|longest{min(max(map(len, groups)), 8)}"]
        out.append(f"phone|plan{bool(re.fullmatch(r'(?:[+][0-9]{1,3}[ .-]?)?[(][0-9]{2,4}[)][ .-]?[0-9]{3,4}[ .-][0-9]{3,4}', s))}")
    return out


_ALLOWED = {"email": re.compile(r"[A-Za-z0-9._%+@-]+"), "ip": re.compile(r"[0-9.]+"), "card": re.compile(r"[0-9 -]+"), "phone": re.compile(r"[0-9 ().+-]+")}


class Region:
    """Atoms of a region and its candidate segments by their end: (start, kind, features)."""

    def __init__(self, text: str, lo: int, hi: int):
        self.at = [m.start() + lo for m in _ATOM.finditer(text[lo:hi])] + [hi]
        n = len(self.at) - 1
        self.ending: list[list[tuple[int, str, list[str]]]] = [[] for _ in range(n + 1)]
        for a in range(n):
            first = text[self.at[a]]
            self.ending[a + 1].append((a, "O", ["O|" + side(first)]))
            start = {"email": first in _LOCAL, "ip": first.isdigit(), "card": first.isdigit(), "phone": first.isdigit() or first in "+("}
            live = [k for k in KINDS if start[k]]
            for b in range(a + 1, min(a + ATOMS, n) + 1):
                atom = text[self.at[b - 1] : self.at[b]]
                live = [k for k in live if _ALLOWED[k].fullmatch(atom)]
                if not live:
                    break
                s = text[self.at[a] : self.at[b]]
                for k in live:
                    if k == "email":
                        whole = s.count("@") == 1 and s[-1].isalnum() and "." in s.partition("@")[2]
                    elif k == "ip":
                        whole = s.count(".") >= 2 and s[-1].isdigit() and ".." not in s
                    else:
                        whole = s[-1].isdigit() and len(digits(s)) >= (12 if k == "card" else 7) and (k == "phone" or "  " not in s and s.find("--") < 0)
                    if whole:
                        before, after = text[max(0, self.at[a] - 24) : self.at[a]], text[self.at[b] : self.at[b] + 2]
                        self.ending[b].append((a, k, features(k, s, before, after)))


def _score(w: dict[str, float], feats: list[str]) -> float:
    return sum(w.get(f, 0.0) for f in feats)


def viterbi(region: Region, w: dict[str, float]) -> list[Span]:
    """The best segmentation's spans, in code points."""
    n = len(region.at) - 1
    best: list[dict[str, tuple[float, int, str]]] = [{"O": (0.0, -1, "")}] + [{} for _ in range(n)]
    for b in range(1, n + 1):
        for a, kind, feats in region.ending[b]:
            s = _score(w, feats)
            for prev, (x, _, _) in best[a].items():
                t = x + s + w.get(f"{prev}>{kind}", 0.0)
                if kind not in best[b] or t > best[b][kind][0]:
                    best[b][kind] = (t, a, prev)
    out, b = [], n
    kind = max(best[n], key=lambda k: (best[n][k][0], k))
    while b > 0:
        _, a, prev = best[b][kind]
        if kind != "O":
            out.append((kind, region.at[a], region.at[b]))
        b, kind = a, prev
    return out[::-1]


def _logsum(xs: list[float]) -> float:
    m = max(xs)
    return m + math.log(sum(math.exp(x - m) for x in xs))


def gradient(region: Region, gold: set[tuple[str, int, int]], w: dict[str, float]) -> dict[str, float]:
    """Of the log-likelihood of the gold segmentation: its features minus their expectation (forward and backward sums)."""
    n = len(region.at) - 1
    states = ("O", *KINDS)
    scored = [[(a, k, f, _score(w, f)) for a, k, f in e] for e in region.ending]
    fwd: list[dict[str, float]] = [{"O": 0.0}] + [{} for _ in range(n)]
    for b in range(1, n + 1):
        into: dict[str, list[float]] = {}
        for a, k, _, s in scored[b]:
            into.setdefault(k, []).extend(x + s + w.get(f"{p}>{k}", 0.0) for p, x in fwd[a].items())
        fwd[b] = {k: _logsum(v) for k, v in into.items() if v}
    total = _logsum(list(fwd[n].values()))
    back: list[dict[str, list[float]]] = [{} for _ in range(n + 1)]
    bwd: list[dict[str, float]] = [{} for _ in range(n + 1)]
    grad: dict[str, float] = {}
    for b in range(n, -1, -1):
        bwd[b] = dict.fromkeys(states, 0.0) if b == n else {p: _logsum(v) for p, v in back[b].items()}
        for a, k, feats, s in scored[b]:
            if k not in bwd[b]:
                continue
            for p, x in fwd[a].items():
                t = s + w.get(f"{p}>{k}", 0.0) + bwd[b][k]
                back[a].setdefault(p, []).append(t)
                mass = math.exp(x + t - total)
                if mass > 1e-9:
                    for f in (*feats, f"{p}>{k}"):
                        grad[f] = grad.get(f, 0.0) - mass
    prev, b = "O", 0
    starts = {s: (k, e) for k, s, e in gold}
    while b < n:
        k, end = starts.get(region.at[b], ("O", region.at[b + 1]))
        found = next(((e, f) for e in range(b + 1, n + 1) if region.at[e] == end for a, kk, f in region.ending[e] if a == b and kk == k), None)
        if found is None:
            return {}
        for f in (*found[1], f"{prev}>{k}"):
            grad[f] = grad.get(f, 0.0) + 1
        b, prev = found[0], k
    return grad


def example(rng: random.Random) -> tuple[str, list[Span]]:
    """A made-up line with entities and look-alikes, and the entities' spans."""
    num = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8)))

    def card() -> str:
        n = rng.choice((14, 15, 16, 16, 16, 16, 19))
        body = rng.choice("3456") + num(n - 2)
        number = body + next(str(c) for c in range(10) if luhn(body + str(c)))
        if n == 16 and rng.random() < 0.4:
            return rng.choice(" -").join(number[i : i + 4] for i in range(0, 16, 4))
        return number

    def not_card() -> str:
        while True:
            x = rng.choice("123456789") + num(rng.choice((11, 12, 13, 15, 15, 15)))
            if not luhn(x):
                return x

    octet = lambda: str(rng.randint(1, 255))
    entity = {
        "email": lambda: rng.choice((f"{word()}.{rng.randint(1, 99)}@mail{rng.randint(0, 9)}.example.com", f"{word()}@{word()}.{rng.choice(('com', 'org', 'net', 'de'))}", f"{word()}_{word()}+{word()}@{word()}.co.uk")),
        "ip": lambda: ".".join(octet() for _ in range(4)),
        "card": card,
        "phone": lambda: rng.choice((f"+{rng.randint(1, 99)} ({num(3)}) 555-{num(4)}", f"+1 ({num(3)}) {num(3)}-{num(4)}", f"+{rng.randint(10, 99)}{num(10)}", f"+{rng.randint(1, 99)} {num(3)} {num(3)} {num(4)}", f"+1-{num(3)}-{num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}")),
    }
    odd = (
        lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 9)}.", lambda: f"{rng.randint(1, 20)}.", lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", not_card, not_card,
        lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", lambda: ".".join(str(rng.randint(256, 999)) for _ in range(4)), lambda: f"{rng.randint(1, 9)}.{rng.randint(1, 9)}.{rng.randint(1, 9)}.{rng.randint(1, 9)}.{rng.randint(1, 9)}",
        lambda: '"' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"', lambda: "AKIA" + "".join(rng.choice("ABCDEFGH234567") for _ in range(16)), lambda: f"@{word()}", lambda: f"{word()}@{word()}", lambda: f"{num(3)}-{num(4)}", lambda: f"{num(5)} {num(4)}",
        lambda: f"{rng.randint(10, 23)}:{rng.randint(10, 59)}", lambda: f"{num(2)},{num(3)}.{num(2)}", lambda: f"password={num(3)}{word()}{num(9)}", lambda: f"{num(3)}-{num(2)}-{num(4)}", lambda: num(10), lambda: num(8) + "-" + num(4), lambda: " ".join(num(2) for _ in range(rng.randint(3, 9))),
    )
    text, spans = word() + " ", []
    for _ in range(rng.randint(1, 4)):
        if rng.random() < 0.2:
            text += word() + " "
        if rng.random() < 0.55:
            k = rng.choice(KINDS)
            s = entity[k]()
            spans.append((k, len(text), len(text) + len(s)))
        else:
            s = rng.choice(odd)()
        text += s + rng.choice((" ", " ", " ", "### ", ", ", "$$$ ", ". " if not s.endswith(".") else " "))
    return text + word(), spans


@lru_cache(maxsize=2)
def train(n: int = TRAIN, epochs: int = EPOCHS, seed: int = SEED) -> dict[str, float]:
    """Weights by stochastic gradient with adaptive steps and a small pull to zero."""
    rng = random.Random(seed)
    data = []
    for _ in range(n):
        text, spans = example(rng)
        for lo, hi in regions(text):
            data.append((Region(text, lo, hi), {s for s in spans if lo <= s[1] < hi}))
    w: dict[str, float] = {}
    squares: dict[str, float] = {}
    for _ in range(epochs):
        rng.shuffle(data)
        for r, gold in data:
            for f, g in gradient(r, gold, w).items():
                g -= 1e-3 * w.get(f, 0.0)
                squares[f] = squares.get(f, 1e-6) + g * g
                w[f] = w.get(f, 0.0) + 0.5 * g / math.sqrt(squares[f])
    return w


def find(text: str | None, w: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a whole text."""
    if not text or not _ANY.search(text):
        return [], []
    base = base_spans(text)
    added, k = [], 0
    by_end = sorted(base, key=lambda s: s[2])
    for lo, hi in regions(text):
        while k < len(by_end) and by_end[k][2] <= lo:
            k += 1
        here, j = [], k
        while j < len(by_end) and by_end[j][1] < hi:
            here.append(by_end[j])
            j += 1
        for s in viterbi(Region(text, lo, hi), w):
            if not any(s[1] < e and b < s[2] for _, b, e in here):
                added.append(s)
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    w = train() if weights is None else weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [find(t, w) for t in b["text"]]
            out = {"doc_id": b["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None)}
            out |= {f"n_{k}": [sum(s[0] == k for s in base) for base, _ in found] for k in KINDS}
            out |= {"base_sha256": [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], "spans": [written(every) for _, every in found]}
            yield pd.DataFrame(out | {"n_added": [len(every) - len(base) for base, every in found]})

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
