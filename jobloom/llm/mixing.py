"""Mixing sources to target weights by Pareto order sampling.

Every source has a target of words. Its documents are wanted in unequal numbers of
copies: a document of s words has the measure q = s / (s + HALF), cut to 1024ths, long texts
more than short ones, and is wanted
    wanted = mean + tilt * (q - mean q)
times, where mean is the target over the source's size and mean q is weighted by
words, so that the wanted words of a source sum up to its target; tilt is half of what
would bring a document to 0 or to MOST copies. The whole part of wanted is allotted as
certain copies, and the rest is drawn without replacement: a document with inclusion
probability p gets the rank (u/(1-u)) / (p/(1-p)), u being a uniform number made from its id, and
documents are taken by ascending rank as far as the words still wanted go. What is left
open at the edge is filled in the same way by those that are no longer than it (ROUNDS in all), and in the end by one
more: the document not drawn whose size is nearest to it, if it brings the sum nearer. So the sample has a fixed size in words, a source misses
its target by less than one document, most often by a word or two, and a rerun takes the same documents.

Texts are read once; ids and sizes are a table of their own. Ranks are cut into
cells; a cell's words are summed before the shuffle, and the
running sum inside a cell starts from the sum of the cells before it. A source
with a third of all rows is thus dealt over CELLS tasks.

Defined results: null text or text without words has size 0 and takes 0; null
source is a source of its own and comes last; repeated rows are documents of
their own with the same rank, taken in any order that gives the same sums (equal
id and size); a source without words has target 0; an empty table gives an
empty result. Other columns of the input are carried as they are if asked for; a column named like a new one is replaced. No
document has more copies than MOST, rounded up if it is no whole number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, fresh_names, materialize, table

CELLS = 4096
HALF = 256
ROUNDS = 2
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"


def uniform(id_col: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) with 52 bits from md5 of seed and id."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 13), 16, 10)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> source, source_size, target: share of all words dealt by weight, no source above most times its size.

    Sources in ascending order of size/weight reach their ceiling first; with the
    first k at their ceiling the others get (total - ceilings) / weights each, and
    the first k at which the next source stays below its ceiling is the answer.
    This is one sort over the table of sources, not a loop of rounds.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    picks = F.array(*[F.lit(float(w)) for w in weights])
    w = sizes.withColumn("nth", F.row_number().over(by_name)).withColumn("weight", F.element_at(picks, ((F.col("nth") - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("ceiling", F.lit(most) * F.col("source_size")).withColumn("fill", F.col("ceiling") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("fill", "nth").rowsBetween(Window.unboundedPreceding, -1)
    w = (
        w.withColumn("total", F.lit(share) * F.sum("source_size").over(every))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("stop", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "nth", "level"))).over(every)["level"])
    )
    return w.select("source", "source_size", F.least("ceiling", F.coalesce(F.col("stop") * F.col("weight"), F.col("ceiling"))).alias("target"))


def wanted(size: Column, mean: Column, sums: Column, total: Column, most: float) -> Column:
    """Copies wanted of a document on average. sums: size * q over the source, in 1024ths; total: words of the source."""
    q = F.floor(size * 1024 / (size + HALF)).cast("long") / F.lit(1024.0)
    middle = sums / F.lit(1024.0) / total
    tilt = F.lit(0.5) * F.least(mean / middle, (F.lit(float(most)) - mean) / (F.lit(1.0) - middle))
    return mean + tilt * (q - middle)


def with_open(rows: DataFrame) -> DataFrame:
    """rows with open: words that their source still wants."""
    left = rows.groupBy("source").agg((F.first("target") - F.sum((F.col("whole") + F.col("one")) * F.col("size"))).alias("open"))
    return rows.join(left.withColumnRenamed("source", "os"), F.col("source").eqNullSafe(F.col("os"))).drop("os")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED, carry: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies for every row of docs; or all columns of docs, and copies."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    if carry:  # texts travel with their row from here on, as rows have no name of their own
        number, words = fresh_names(docs, "_row", "_size")
        docs = materialize(docs.withColumns({number: F.monotonically_increasing_id(), words: size}), "numbered")
        size = F.col(words)
    row = F.col(number) if carry else F.lit(0).cast("long")
    base = docs.select(row.alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    base = materialize(base, "sizes")
    per = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.floor(F.col("size") * 1024 / (F.col("size") + HALF)).cast("long")).alias("sums"))
    targets = source_targets(per.select("source", "source_size"), weights, share, most).withColumnRenamed("source", "s")
    targets = targets.join(per.select(F.col("source").alias("t"), "sums"), F.col("s").eqNullSafe(F.col("t"))).drop("t")
    rows = base.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    some = (F.col("source_size") > 0) & (F.col("size") > 0)
    mean = F.col("target") / F.col("source_size")
    rows = rows.withColumn("wanted", F.when(some, wanted(F.col("size"), mean, F.col("sums"), F.col("source_size"), most)).otherwise(F.lit(0.0))).drop("sums")
    rows = rows.withColumn("whole", F.floor("wanted").cast("long")).withColumn("p", F.col("wanted") - F.col("whole")).withColumn("u", uniform(F.col("doc_id"), seed))
    rank = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    rows = rows.withColumn("rank", F.when(F.col("p") > 0, rank)).withColumn("cell", F.coalesce(F.floor(F.col("rank") / (1 + F.col("rank")) * CELLS).cast("int"), CELLS + F.floor(F.rand(1) * CELLS).cast("int")))  # who isn't drawn may be anywhere
    rows = materialize(rows, "ranked")

    earlier = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("source", "cell").orderBy("rank", "doc_id", "size")
    rows = rows.withColumn("one", F.lit(0))
    for _ in range(ROUNDS):
        fits = F.col("rank").isNotNull() & (F.col("one") == 0) & (F.col("size") > 0) & (F.col("size") <= F.col("open"))
        now = with_open(rows).withColumn("words", F.when(fits, F.col("size")).otherwise(F.lit(0)))
        cells = now.groupBy("source", "cell").agg(F.sum("words").alias("n"))
        cells = cells.select(F.col("source").alias("s"), F.col("cell").alias("c"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("from"))
        now = now.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
        upto = F.col("from") + F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0))
        now = now.withColumn("nth", F.row_number().over(inside)).withColumn("one", F.col("one") + ((F.col("words") > 0) & (upto <= F.col("open"))).cast("int"))
        rows = materialize(now.drop("words", "from", "open", "s", "c"), "drawn")

    # what is left open goes to the document nearest to it in size
    free = with_open(rows).where("rank IS NOT NULL AND one = 0 AND size > 0")
    miss = F.abs(F.col("open") - F.col("size"))
    fill = free.where(miss < F.col("open")).groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "rank", "doc_id", "size", "cell", "nth")).alias("f"))
    fill = fill.select(F.col("source").alias("s"), F.col("f.cell").alias("c"), F.col("f.nth").alias("k"))
    rows = rows.join(fill, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")) & (F.col("nth") == F.col("k")), "left")
    rows = rows.withColumn("copies", (F.col("whole") + F.col("one") + F.when(F.col("k").isNotNull(), 1).otherwise(0)).cast("int"))
    if carry:
        copies = rows.select(F.col("row").alias(number), "copies")
        return docs.drop(words, *[c for c in docs.columns if c.lower() == "copies"]).join(copies, number).drop(number)
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def op2_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _rounds() -> str:
    """CTEs g1.. of the rounds, each from the one before."""
    fits = "rank IS NOT NULL AND one = 0 AND size > 0 AND size <= open"
    upto = f"sum(CASE WHEN {fits} THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank, doc_id, size, nr ROWS UNBOUNDED PRECEDING)"
    return ",\n".join(
        f"n{k} AS (SELECT * REPLACE (one + CASE WHEN {fits} AND {upto} <= open THEN 1 ELSE 0 END AS one) FROM g{k - 1}),\n"
        f"g{k} AS (SELECT * REPLACE (target - sum((whole + one) * size) OVER (PARTITION BY source) AS open) FROM n{k})"
        for k in range(1, ROUNDS + 1)
    )


SQL = f"""
WITH d AS (
  SELECT doc_id, source, row_number() OVER () AS nr,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size,
         (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size * ((size * 1024) // (size + {HALF})))::BIGINT AS sums FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") AS nth FROM s),
x AS (SELECT *, [3.0, 1.0, 2.0][((nth - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM w),
y AS (SELECT *, 2.0::DOUBLE * source_size AS ceiling, 2.0::DOUBLE * source_size / weight AS fill FROM x),
z AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
        coalesce(sum(ceiling) OVER (ORDER BY fill, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS full_c,
        coalesce(sum(weight) OVER (ORDER BY fill, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS full_w FROM y),
l AS (SELECT *, (total - full_c) / (all_weight - full_w) AS level FROM z),
m AS (SELECT *, (min(CASE WHEN level <= fill THEN {{'fill': fill, 'nth': nth, 'level': level}} END) OVER ()).level AS stop FROM l),
t AS (SELECT source, source_size, sums, least(ceiling, coalesce(stop * weight, ceiling))::DOUBLE AS target FROM m),
a AS (SELECT *, target / source_size AS mean, sums / 1024.0::DOUBLE / source_size AS middle FROM t),
b AS (SELECT *, 0.5::DOUBLE * least(mean / middle, (2.0::DOUBLE - mean) / (1.0::DOUBLE - middle)) AS tilt FROM a),
e AS (SELECT d.*, b.source_size, b.target,
        CASE WHEN b.source_size > 0 AND d.size > 0
             THEN b.mean + b.tilt * (((d.size * 1024) // (d.size + {HALF}))::DOUBLE / 1024.0::DOUBLE - b.middle) ELSE 0.0 END::DOUBLE AS wanted
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
f AS (SELECT *, floor(wanted)::BIGINT AS whole, wanted - floor(wanted) AS p FROM e),
g0 AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank, 0 AS one, target - sum(whole * size) OVER (PARTITION BY source) AS open FROM f),
{_rounds()},
j AS (SELECT *, CASE WHEN rank IS NOT NULL AND one = 0 AND size > 0 AND abs(open - size) < open THEN abs(open - size) END AS miss FROM g{ROUNDS}),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY miss NULLS LAST, rank, doc_id, size, nr) AS place FROM j)
SELECT doc_id, size, source_size, target,
       ((whole + one + CASE WHEN place = 1 AND miss IS NOT NULL THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM k
"""
