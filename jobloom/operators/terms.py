"""Where a text names a term: the first match, what stands around it, and whether that asks for it. Column functions only.

A match is told by the text before it, the match, and the text after it, so that its place is a length. Places of words around it come
from one replacement that puts marks about each of them: between the marks every second piece is such a word, and running lengths
give the places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import rules as R
from ..functions.text import let, squeeze, text

#: Characters around a match in which words count, and that a quote shows on each side.
NEAR, SHOWN = 150, 80
_OPEN, _SHUT = "\u0001", "\u0002"


def flagged(name: str, pattern: str) -> str:
    return ("(?U)" if name in R.CASE_SENSITIVE else "(?iuU)") + f"(?:{pattern})"


def first_match(t: Column, pattern: str) -> Column:
    """Struct (b, m, a) of the first match: at most NEAR + 1 characters before it, the match, at most NEAR after it. t must match."""
    before = F.regexp_extract(t, f"(?s)^(.*?){pattern}", 1)
    return let(before, lambda b: let(F.substr(t, F.length(b) + 1), lambda rest: let(F.regexp_extract(rest, f"^{pattern}", 0), lambda m: F.struct(
        F.right(b, F.lit(NEAR + 1)).alias("b"), m.alias("m"), F.left(F.substr(rest, F.length(m) + 1), F.lit(NEAR)).alias("a"),
    ))))


def nearest(around: Column, pattern: str, target: Column) -> Column:
    """Twice the distance of the nearest match's middle from a place (given twice, in around); null without a match."""
    pieces = F.split(F.regexp_replace(around, f"(?iuU)({pattern})", f"{_OPEN}$1{_SHUT}"), f"[{_OPEN}{_SHUT}]", -1)
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("d"))

    def step(s: Column, piece: Column) -> Column:
        far = F.abs(2 * s["at"] + F.length(piece) - target)
        return F.struct((~s["inside"]).alias("inside"), (s["at"] + F.length(piece)).alias("at"), F.when(s["inside"], F.least(s["d"], far)).otherwise(s["d"]).alias("d"))

    return F.aggregate(pieces, start, step, lambda s: s["d"])


def wanted(hit: Column) -> Column:
    """required, preferred or mentioned: by the nearest word of need or preference; required where both are as near."""
    b, m, a = hit["b"], hit["m"], hit["a"]
    left = F.right(b, F.lit(NEAR))
    # the character before counts as far as words begin after it, but starts none itself
    edge = F.when((F.length(b) > NEAR) & F.left(b, F.lit(1)).rlike(r"(?U)\w"), "x").otherwise(" ")
    around = F.translate(F.concat(edge, left, m, a), _OPEN + _SHUT, "\u0003\u0003")
    target = 2 * (F.length(left) + 1) + F.length(m)
    near = let(around, lambda t: F.struct(nearest(t, R.REQUIRED_NEAR, target).alias("r"), nearest(t, R.PREFERRED_NEAR, target).alias("p")))
    return let(near, lambda n: F.when(n["r"].isNull() & n["p"].isNull(), "mentioned").when(n["p"].isNull() | (n["r"] <= n["p"]), "required").otherwise("preferred"))


def quoted_line(hit: Column) -> Column:
    """The match within its line, SHOWN characters on each side at most, blanks squeezed."""
    left = F.substring_index(F.right(hit["b"], F.lit(SHOWN)), "\n", -1)
    right = F.substring_index(F.left(hit["a"], F.lit(SHOWN)), "\n", 1)
    return squeeze(F.concat(left, hit["m"], right))


TERMS = [(n, p, "certificate") for n, p in R.CERTIFICATES] + [(n, p, "tool") for n, p in R.TOOLS]


def term_hits(market: DataFrame, terms=TERMS) -> DataFrame:
    """A row for each posting of the market and each term it names: seq, term, grp, level, place, hit (its first match)."""
    t = F.concat(text(F.col("title")), F.lit("\n"), text(F.col("full_text")))
    base = market.select("seq", t.alias("t"), M.level_bucket(F.col("seniority")).alias("level"), M.location_bucket(F.col("work_format"), F.col("country")).alias("place"))
    hits = [F.when(F.col("t").rlike(flagged(n, p)), F.struct(F.lit(n).alias("term"), F.lit(g).alias("grp"), first_match(F.col("t"), flagged(n, p)).alias("hit"))) for n, p, g in terms]
    found = base.select("seq", "level", "place", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("h"))
    return found.select("seq", "h.term", "h.grp", "level", "place", "h.hit")


#: Rows of a dictionary that are broadcast; a larger one is joined.
BROADCAST_PHRASES = 200_000


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)(\w+)"), F.lit(1))


def begun_runs(texts: DataFrame, key: str, begun: DataFrame, longest: int | None = None, t: str = "t") -> DataFrame:
    """(key, run): the n words of a text from each place where a word of begun (word, n) stands. begun is broadcast; with longest, the largest n, it is joined,
    and each word goes with the words after it that a run may take, not with its whole text."""
    cut_up = texts.select(key, _words(F.col(t)).alias("w")).select(key, "w", F.posexplode("w").alias("at", "word"))
    if longest is None:
        starts = cut_up.join(F.broadcast(begun), "word")
    else:
        starts = cut_up.select(key, "word", F.slice("w", F.col("at") + 1, longest).alias("w"), F.lit(0).alias("at")).join(begun, "word")
    run = F.when(F.col("n") == 1, F.col("word")).otherwise(F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " "))
    return starts.where(F.col("at") + F.col("n") <= F.size("w")).select(key, run.alias("run"))


def phrase_hits(texts: DataFrame, key: str, phrases: DataFrame, t: str = "t") -> DataFrame:
    """(key, term), each once: the terms that a folded text names, by a dictionary (term, phrase) of any size.

    Texts are cut in words once. Only words that begin a phrase are followed, by as many words as such a phrase has, and these runs are met with the dictionary: what a row costs
    follows from its words, not from the number of terms. A phrase is words in a row, whatever stands between them. Blank phrases name nothing.
    """
    known = phrases.select("term", _words(F.col("phrase")).alias("w")).where(F.size("w") > 0).select("term", F.array_join("w", " ").alias("run"), F.size("w").alias("n")).distinct()
    named, begun = known.select("term", "run"), known.select(F.substring_index("run", " ", 1).alias("word"), "n").distinct()
    size = known.agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("longest")).first()
    if size["rows"] <= BROADCAST_PHRASES:
        named, longest = F.broadcast(named), None
    else:
        longest = size["longest"]
    return begun_runs(texts, key, begun, longest, t).join(named, "run").select(key, "term").distinct()
