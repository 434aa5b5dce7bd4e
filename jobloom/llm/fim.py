r"""Fill-in-middle transformation over a run-length encoding of character classes.

A text is cut in units: lines (what ends with "\n", and a last line without
it), words (a run of other characters with the blanks after it; leading blanks
are a unit of their own) or chars (code points). It is stored as its maximal runs of
characters of one class: for lines "\n" and the rest, for words blanks and the rest, for chars
the lengths of a character in UTF-8. Each run has its first byte, its first code point and
the units that end before it. In a *stepping* run ("\n"; every run of chars) each character ends a unit;
any other run ends one as a whole, or none. So a cut after c units lies in the first run that ends at least c units in all:
a binary search finds it, and the offset follows from the run's start by multiplication, without a table of units.

Two cuts give prefix, middle and suffix. The document is written as psm (prefix, suffix, middle),
as spm (suffix, prefix, middle), or left plain. The draws are taken from sha256 of
"<seed>:<id>": the same on every run and in every partition. `restore` gives the text back from
output and form: no mark overlaps another or itself, so the first of each is the one that was put there.

Scale: no shuffle. Python gets texts and returns three numbers a row; texts are cut, joined and hashed in the JVM. A task
encodes at most CHUNK bytes at once (or one longer text), and keeps runs, not units.

Defined results: null text counts as empty; a text that is empty or holds a mark is plain; a null id draws from
"<seed>:"; repeated rows give equal rows; one unit leaves at least two parts empty; columns
named like new ones are replaced, others are carried; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_names, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("lines", "words", "chars")
SEED, RATE, SPM = 7, 100, 50
CHUNK = 4 << 20
NEW = ["n", "form", "prefix_chars", "middle_chars", "output"]


def classes(data: np.ndarray, units: str) -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte, and by class the bytes of a step (0: the class doesn't step)."""
    if units == "lines":
        return (data == 10).astype(np.uint8), np.array([0, 1])
    if units == "words":
        return ((data == 32) | ((data >= 9) & (data <= 13))).astype(np.uint8), np.array([0, 0])
    lead = (data & 0xC0) != 0x80
    width = np.ones(256, dtype=np.uint8)
    width[0xC0:0xE0], width[0xE0:0xF0], width[0xF0:] = 2, 3, 4
    at = np.flatnonzero(lead)
    return np.repeat(width[data[at]], np.diff(np.append(at, len(data)))), np.arange(5)


class Runs:
    """The runs of several texts that stand one after the other in data; text i is data[bounds[i]:bounds[i + 1]]."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, units: str):
        kind, steps = classes(data, units)
        starts = bounds[:-1][bounds[:-1] < bounds[1:]]
        self.start = np.union1d(starts, np.flatnonzero(kind[1:] != kind[:-1]) + 1)
        end = np.append(self.start[1:], len(data))
        of = kind[self.start] if len(self.start) else kind[:0]
        self.step = steps[of]
        chars = np.add.reduceat((data & 0xC0) != 0x80, self.start, dtype=np.int64) if len(self.start) else np.zeros(0, dtype=np.int64)
        whole = np.isin(end, bounds)  # the last run of a text ends a unit
        if units == "words":
            whole |= of == 1
        ends = np.where(self.step > 0, (end - self.start) // np.maximum(self.step, 1), whole)
        self.after = np.cumsum(ends)
        self.before = self.after - ends
        self.chars_after = np.cumsum(chars)
        self.chars_before = self.chars_after - chars
        first = np.searchsorted(self.start, bounds)
        total = np.append(self.before, self.after[-1:] if len(ends) else [0])
        all_chars = np.append(self.chars_before, self.chars_after[-1:] if len(ends) else [0])
        self.base, self.char_base = total[first], all_chars[first]

    def counts(self) -> np.ndarray:
        return np.diff(self.base)

    def chars(self, text: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Code points of each text before its cut, which follows so many of its units."""
        wanted = self.base[text] + cut
        run = np.searchsorted(self.after, wanted)  # the first run that ends so many
        inside = cut > 0
        run = np.where(inside, run, 0)
        if not len(self.after):
            return np.zeros(len(cut), dtype=np.int64)
        at = np.where(self.step[run] > 0, self.chars_before[run] + wanted - self.before[run], self.chars_after[run])
        return np.where(inside, at - self.char_base[text], 0)


def slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most CHUNK bytes together, or of one longer row."""
    lo = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and total + n > CHUNK:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def cuts(text: Column, one: Column, two: Column, units: str) -> Column:
    """struct<n, a, b> of each text: its units, and the code points before the smaller and the larger of one % (n + 1) and two % (n + 1) units."""

    @F.pandas_udf("n long, a long, b long")
    def run(texts: pd.Series, ones: pd.Series, twos: pd.Series) -> pd.DataFrame:
        column = pa.array(texts, type=pa.large_string())
        bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
        draws = np.stack([ones.to_numpy(dtype=np.int64), twos.to_numpy(dtype=np.int64)])
        out = np.zeros((3, len(texts)), dtype=np.int64)
        for lo, hi in slices(np.diff(bounds)):
            runs = Runs(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], units)
            n = runs.counts()
            cut = np.sort(draws[:, lo:hi] % (n + 1), axis=0)
            rows = np.arange(hi - lo)
            out[:, lo:hi] = n, runs.chars(rows, cut[0]), runs.chars(rows, cut[1])
        return pd.DataFrame(dict(zip("nab", out, strict=True)))

    return run(text, one, two)


def draw(id_: Column, seed: int, k: int) -> Column:
    """The k-th 8-digit group (from 1) of the hex sha256 of "seed:id", as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: str = "lines", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output. rate: per cent of documents that are cut; spm: per cent of these
    whose suffix comes first."""
    if units not in UNITS:
        raise ValueError(f"units must be one of {', '.join(UNITS)}")
    clash = [c for c in docs.columns if c.lower() in NEW and c not in (id_col, text_col)]
    docs = docs.drop(*clash)
    cut, body = fresh_names(docs, "_cut", "_body")
    rows = docs.withColumn(body, F.coalesce(F.col(text_col), F.lit("")))
    t, h = F.col(body), lambda k: draw(F.col(id_col), seed, k)
    rows = rows.withColumn(cut, cuts(t, h(1), h(2), units))
    marked = t.contains(PREFIX) | t.contains(SUFFIX) | t.contains(MIDDLE)
    form = F.when((t == "") | marked | (h(3) % 100 >= rate), "plain").when(h(4) % 100 < spm, "spm").otherwise("psm")
    a, b = F.col(f"{cut}.a").cast("int"), F.col(f"{cut}.b").cast("int")
    prefix, middle, suffix = F.substr(t, F.lit(1), a), F.substr(t, a + 1, b - a), F.substr(t, b + 1)
    changed = F.col("form") != "plain"
    return rows.withColumns({"n": F.col(f"{cut}.n"), "form": form}).withColumns({
        "prefix_chars": F.when(changed, a.cast("long")), "middle_chars": F.when(changed, (b - a).cast("long")),
        "output": F.when(~changed, t).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)),
    }).drop(cut, body)


def restore(output: Column, form: Column) -> Column:
    """The text that transform() was given, from its output and form alone."""
    first, second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), F.lit(MIDDLE)
    one, two, size = F.instr(output, first), F.instr(output, second), len(MIDDLE)
    left, right, middle = F.substr(output, F.lit(size + 1), one - size - 1), F.substr(output, one + size, two - one - size), F.substr(output, two + size)
    return F.when(form == "plain", output).when(form == "psm", F.concat(left, middle, right)).otherwise(F.concat(right, middle, left))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u,
         sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (SELECT *, len(u)::BIGINT AS n, [('0x' || substr(h, 8 * k + 1, 8))::BIGINT FOR k IN [0, 1, 2, 3]] AS r FROM d),
f AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR r[3] % 100 >= {RATE} THEN 'plain'
             WHEN r[4] % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM g
"""
