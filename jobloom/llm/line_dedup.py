r"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A line is what "\n" separates; blank lines (no words) are never compared, never
removed. Two lines are equal if they are so without blanks at their ends.
A *gram* starts at a line and has as many lines as it takes to reach
``noise`` words. A *window* starts at a line and has as many lines as it
takes to reach ``guarantee`` words; of the grams inside, the one with the
smallest hash (then the first) is a fingerprint. Windows depend on their own
lines only, so equal runs of at least ``guarantee`` words choose equal
fingerprints: each such run is found. A fingerprint stands under the hash of
its gram and under those of the windows that chose it. An *end window* ends at a
line and has as many lines before it as it takes to reach ``guarantee`` words; it
stands under its own hash. Each line of a repeated run of at least ``guarantee``
words is in a window that starts at it, or else in the end window of the run's last
line; the first place of either has all of it, so that the run is removed whole,
whatever shorter runs came before. A text of ``noise`` words or more that has
no full window is one window. Places are ordered by document id, then
line; a fingerprint's first place is the keeper, and a later place with that
fingerprint is matched against it, or against the place before it in its own text if that has one: the match is extended line by line both ways
and the later run is removed. Every removed line has an equal line at an
earlier place, so that one copy of each always stays. Nothing of less than
``noise`` words is ever removed.

Scale: lines are dealt by document; work is linear in a text's lines, also where thousands of them are equal (each is
matched with the one before it, and extended guarantee lines at most, as windows find what goes on beyond); first places come from a min with map-side
combine; matches are linear in the fingerprints (each meets one first place, not
all others); texts move once, in the last join. Hot fingerprints and hot first
documents meet in plain equi-joins that adaptive execution splits.

Defined results: null text stays null with 0 lines; an empty text stays empty;
a null id sorts first; rows that repeat both id and text are one document and get
the same result each; rows that share an id but not the text are told apart
by the text's hash, which also orders them; extra columns are carried, and a
column named like a new one is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, fresh_names, let, table

NOISE, GUARANTEE = 25, 50
BLOCK = 64  # lines whose hits are extended together
_BLANKS = "\t\n\x0b\x0c\r "


def _lines(text):
    return F.split(text, "\n", -1)


def _full(line):
    return line.rlike(r"[^\x20\x09-\x0D]")


def fingerprints(lines: DataFrame, noise: int, guarantee: int) -> DataFrame:
    """(id, th, at, h, words) with at counting the lines that are not blank -> id, th, at, gram of the fingerprints, where gram
    is the hash of the fingerprint's own gram or of a whole window that chose it; and id, th, at, gram of the last lines of windows
    by their end."""
    by = Window.partitionBy("id", "th").orderBy("at")
    lines = lines.withColumn("to", F.sum("words").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("to") - F.col("words"))
    run = Window.partitionBy("id", "th").orderBy("start")
    short, long = run.rangeBetween(0, noise - 1), run.rangeBetween(0, guarantee - 1)
    grams = (
        lines.withColumn("gram", F.xxhash64(F.collect_list("h").over(short)))
        .withColumn("gram_to", F.max("to").over(short))
        .withColumn("run_to", F.max("to").over(long))
        .withColumn("run", F.xxhash64(F.collect_list("h").over(long), F.lit("run")))
        .withColumn("whole", F.sum("words").over(Window.partitionBy("id", "th")))
    )
    back = Window.partitionBy("id", "th").orderBy("to").rangeBetween(1 - guarantee, 0)
    ends = lines.withColumn("run", F.xxhash64(F.collect_list("h").over(back), F.lit("end"))).withColumn("size", F.col("to") - F.min("start").over(back))
    # shorter without its last line, it is the window that starts at its first line
    ends = ends.where(F.col("size") - F.col("words") >= guarantee).select("id", "th", "at", F.col("run").alias("gram"))
    # a gram that the text's end cuts short counts as none
    grams = grams.withColumn("gram", F.when(F.col("gram_to") - F.col("start") >= noise, F.struct("gram", "at", "gram_to")))
    grams = grams.withColumn("inside", F.collect_list("gram").over(long))
    full = (F.col("run_to") - F.col("start") >= guarantee) | ((F.col("start") == 0) & (F.col("whole") < guarantee))
    best = F.array_min(F.filter("inside", lambda g: g["gram_to"] <= F.col("run_to")))
    picked = grams.where(full).select("id", "th", best.alias("best"), "run").where(F.col("best").isNotNull())
    return picked.select("id", "th", F.col("best.at").alias("at"), F.explode(F.array("best.gram", "run")).alias("gram")).distinct().unionByName(ends)


def repeated_runs(docs: DataFrame, noise: int, guarantee: int) -> DataFrame:
    """(id, th, text) -> id, th, runs: array of (s, e), counts of lines that are not blank, both ends included."""
    hashed = docs.where(F.regexp_count("text", F.lit(WORD)) >= noise).select(
        "id", "th", F.filter(_lines(F.col("text")), _full).alias("lines")
    )
    lines = (
        hashed.select("id", "th", F.posexplode("lines").alias("at", "line"))
        .select("id", "th", "at", F.xxhash64(F.trim("line", F.lit(_BLANKS))).alias("h"), F.regexp_count("line", F.lit(WORD)).cast("long").alias("words"))
        .repartition("id", "th")
        .dropDuplicates(["id", "th", "at"])
    )
    prints = fingerprints(lines, noise, guarantee)
    first = prints.groupBy("gram").agg(F.min(F.struct("id", "th", "at")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    before = F.lag("at").over(Window.partitionBy("id", "th", "gram").orderBy("at"))
    hits = prints.join(first, "gram").select("id", "th", "gram", "at", "f").repartition("id", "th").withColumn("before", before)
    own = F.col("before").isNotNull()
    hits = hits.select("id", "th", "at", *[F.when(own, F.col(c)).otherwise(F.col(f"f.{o}")).alias(n) for c, o, n in (("id", "id", "fid"), ("th", "th", "fth"), ("before", "at", "fat"))])
    hits = hits.where((F.col("id") != F.col("fid")) | (F.col("th") != F.col("fth")) | (F.col("at") != F.col("fat")))
    pairs = (
        hits.groupBy("id", "th", "fid", "fth", (F.col("at") - F.col("fat")).alias("shift"), F.floor(F.col("at") / BLOCK).cast("int").alias("block"))
        .agg(F.collect_set("at").alias("hits"))
        .groupBy("id", "th", "fid", "fth")
        .agg(F.collect_list(F.struct("shift", "block", "hits")).alias("parts"))
    )
    # from the lines as they are dealt already: texts are split and hashed once
    arrays = lines.groupBy("id", "th").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]).alias("hs"))
    firsts = arrays.select(F.col("id").alias("fid"), F.col("th").alias("fth"), F.col("hs").alias("fhs"))
    both = pairs.join(arrays, ["id", "th"]).join(firsts, ["fid", "fth"])

    def extended(p):
        """Runs of equal lines around the hits of one block: a run that goes on beyond guarantee lines has windows of its own there."""
        lo = F.greatest(F.lit(0), p["shift"], p["block"] * BLOCK - guarantee)
        hi = F.least(F.size("hs"), F.size("fhs") + p["shift"], (p["block"] + 1) * BLOCK + guarantee) - 1
        unlike = F.filter(F.sequence(lo, hi), lambda j: F.get("hs", j) != F.get("fhs", j - p["shift"]))
        runs = lambda u: F.zip_with(F.concat(F.array(lo - 1), u), F.concat(u, F.array(hi + 1)), lambda a, b: F.struct((a + 1).alias("s"), (b - 1).alias("e")))
        return let(unlike, lambda u: F.filter(runs(u), lambda r: F.exists(p["hits"], lambda x: (x >= r["s"]) & (x <= r["e"]))))

    runs = both.select("id", "th", F.explode(F.array_distinct(F.flatten(F.transform("parts", extended)))).alias("r")).select("id", "th", "r.s", "r.e").repartition("id", "th")
    by = Window.partitionBy("id", "th").orderBy("s", "e")
    apart = F.coalesce(F.col("s") > F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True)).cast("int")
    islands = runs.withColumn("apart", apart).withColumn("island", F.sum("apart").over(by))
    islands = islands.groupBy("id", "th", "island").agg(F.struct(F.min("s").alias("s"), F.max("e").alias("e")).alias("r"))
    return islands.groupBy("id", "th").agg(F.array_sort(F.collect_list("r")).alias("runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE, guarantee: int = GUARANTEE) -> DataFrame:
    """docs with later repeated runs cut out of text_col, plus n_lines (blank ones too) and n_removed."""
    if not 1 <= noise <= guarantee:
        raise ValueError("1 <= noise <= guarantee")
    rid, rth, did, dth, druns = fresh_names(docs, "_rid", "_rth", "_did", "_dth", "_druns")
    keyed = docs.withColumn(rid, F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))).withColumn(rth, F.xxhash64(F.col(text_col)))
    runs = repeated_runs(keyed.select(F.col(rid).alias("id"), F.col(rth).alias("th"), F.col(text_col).alias("text")), noise, guarantee)
    runs = runs.select(F.col("id").alias(did), F.col("th").alias(dth), F.col("runs").alias(druns))
    out = keyed.join(runs, (F.col(rid) == F.col(did)) & (F.col(rth) == F.col(dth)), "left")
    lines = _lines(F.col(text_col))

    def cut(lines):
        """Flags of all lines are built from the gaps and the runs, so that work is linear in both."""
        places = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: _full(F.get(lines, i)))
        raw = let(places, lambda at: F.transform(F.col(druns), lambda r: F.struct(F.get(at, r["s"]).alias("s"), F.get(at, r["e"]).alias("e"))))
        flags = let(raw, lambda rs: F.flatten(F.zip_with(
            F.concat(F.array(F.lit(-1)), F.transform(rs, lambda r: r["e"])), F.concat(rs, F.array(F.struct(F.size(lines).alias("s"), (F.size(lines) - 1).alias("e")))),
            lambda end, r: F.concat(F.array_repeat(F.lit(False), r["s"] - end - 1), F.array_repeat(F.lit(True), r["e"] - r["s"] + 1)),
        )))
        return F.transform(F.filter(F.zip_with(lines, flags, lambda line, gone: F.struct(line.alias("line"), gone.alias("gone"))), lambda x: ~(x["gone"] & _full(x["line"]))), lambda x: x["line"])

    kept = let(lines, cut)
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines))
    hit = F.col(druns).isNotNull() & F.col(text_col).isNotNull()
    (rkept,) = fresh_names(out, "_rkept")
    out = out.withColumn(rkept, F.when(hit, kept))
    out = out.withColumns({
        "n_lines": n_lines.cast("long"),
        "n_removed": F.when(F.col(rkept).isNotNull(), F.size(lines) - F.size(rkept)).otherwise(F.lit(0)).cast("long"),
        text_col: F.when(F.col(rkept).isNotNull(), F.array_join(rkept, "\n")).otherwise(F.col(text_col)),
    })
    return out.drop(rid, rth, did, dth, druns, rkept)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")
