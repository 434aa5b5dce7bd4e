"""Groups of postings that are the same job: greedy, complete-link, in order of job_id, as rounds of joins.

In order, each profile joins the first group (that of the smallest founder) all of whose members so far are the same as it,
or founds one. One after the other that is a loop over all; here every profile is decided anew in each
round, in parallel, by what the round before says of the profiles before it. A profile is right for good once
all before it are, so the only assignment that a round leaves as it is, is that of the loop; rounds end there. The first round starts from
the smallest profile that each is the same as, which is nearly right wherever copies agree.

No pairs are made within a group. A profile shows keys (its name with each of its place's words, or with a mark) and is the
same as another that shows a key it asks for (see similar). In each group the members before it that show such a key are
counted by running counts for each key, and all members of a kind that one key covers need no more. Only where keys
cover members in part (places of several words that overlap here and there) are these members met one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedup import first_per_key
from .similar import _BLANK, _VAGUE, PROFILE, asked, distinct_profiles, profiles, shown
from .store import cut

NAME = ["company", "title", "key"]


def _before(members: DataFrame, questions: DataFrame, keys: list[str]) -> DataFrame:
    """questions (keys, i) with c, how many members (keys, j) have the same keys and j < i: one running count for all."""
    both = members.select(*keys, F.col("j").alias("at"), F.lit(1).alias("m")).unionByName(questions.select(*keys, F.col("i").alias("at"), F.lit(0).alias("m")))
    running = Window.partitionBy(*keys).orderBy("at", "m").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("c", F.sum("m").over(running)).where("m = 0").select(*keys, F.col("at").alias("i"), "c")


def _round(labels: DataFrame, asks: DataFrame, shows: DataFrame) -> DataFrame:
    """i, label of every profile that is the same as one before it, given labels (j, label) of all."""
    founders = labels.where("j = label").select(F.col("j").alias("f"))
    offers = shows.join(founders, F.col("j") == F.col("f")).select("f", *NAME)
    questions = asks.join(offers, NAME).where("f < i").select("f", "i").distinct()
    members = labels.join(founders, F.col("label") == F.col("f")).select("f", "j")
    faces = members.join(shows, "j").select("f", "j", *NAME)
    asking = questions.join(asks, "i").select("f", "i", *NAME)
    kind = F.when(F.col("key").isin(_VAGUE, _BLANK), F.col("key")).otherwise("named")
    seen = _before(faces, asking, ["f", *NAME]).groupBy("f", "i", "company", "title", kind.alias("kind")).agg(F.max("c").alias("c"))
    seen = seen.groupBy("f", "i").agg(F.sum("c").alias("covered"))
    counted = cut(_before(members, questions, ["f"]).join(seen, ["f", "i"], "left"), "counted")
    fits = counted.where("c = covered").select("f", "i")
    open_ = counted.where("covered < c").select("f", "i", "c")
    if not open_.isEmpty():
        met = open_.join(asks, "i").join(faces, ["f", *NAME]).where("j < i").select("f", "i", "c", "j").distinct()
        fits = fits.unionByName(met.groupBy("f", "i", "c").agg(F.count(F.lit(1)).alias("n")).where("n = c").select("f", "i"))
    return fits.groupBy("i").agg(F.min("f").alias("label"))


def greedy_labels(found: DataFrame) -> DataFrame:
    """first, label of each profile: the smallest job_id of its group."""
    shows, asks = shown(found), cut(asked(found), "asked")
    least = shows.groupBy(*NAME).agg(F.min("j").alias("before"))
    near = asks.join(least, NAME).where("before < i").groupBy("i").agg(F.min("before").alias("label"))
    every = found.select(F.col("first").alias("j"))
    labels = cut(every.join(near, F.col("j") == F.col("i"), "left").select("j", F.coalesce("label", "j").alias("label")), "labels")
    while True:
        new = labels.withColumnRenamed("label", "was").join(_round(labels, asks, shows), F.col("j") == F.col("i"), "left")
        new = cut(new.select("j", F.coalesce("label", "j").alias("label"), "was"), "labels")
        labels = new.select("j", "label")
        if new.where("label <> was").isEmpty():
            return labels.select(F.col("j").alias("first"), "label")


def duplicate_groups(postings: DataFrame) -> DataFrame:
    """job_id, duplicate_group of every posting: the smallest job_id of its group, blank for one that stands alone.

    Rows of one profile (company, title, places, blank) are the same job and land in one group, so they are counted first, with
    map-side combine; profiles are ordered by their smallest job_id. Postings without a company or a title stand alone.
    """
    rows = cut(profiles(postings), "profiles")
    found = cut(distinct_profiles(rows), "distinct")
    labels = greedy_labels(found).withColumnRenamed("first", "_first")
    formed = cut(found.join(labels, F.col("first") == F.col("_first")).select(*PROFILE, "n", "label"), "formed")
    many = formed.groupBy("label").agg(F.sum("n").alias("m")).where("m > 1").select(F.col("label").alias("duplicate_group"))
    labelled = formed.join(many, F.col("label") == F.col("duplicate_group")).select(*PROFILE, "duplicate_group")
    return rows.join(labelled, PROFILE, "left").select("job_id", F.coalesce("duplicate_group", F.lit("")).alias("duplicate_group"))


def group_stats(rows: DataFrame) -> DataFrame:
    """n_groups, n_rows of rows that have a duplicate_group."""
    return rows.where("duplicate_group <> ''").agg(F.countDistinct("duplicate_group").alias("n_groups"), F.count(F.lit(1)).alias("n_rows"))


def best_of_group(rows: DataFrame, rank: list[Column]) -> DataFrame:
    """The row of each duplicate_group that comes first by rank; rows without a group are left out."""
    return first_per_key(rows.where("duplicate_group <> ''"), [F.col("duplicate_group")], rank)


def also_on(rows: DataFrame, source: str) -> DataFrame:
    """Rows of groups with also_on: the sources of all other members, sorted, each once; blank where there is none. Members of each source are
    counted, so that a row can be taken off its own source."""
    grouped = rows.where("duplicate_group <> ''")
    per = grouped.groupBy("duplicate_group", source).agg(F.count(F.lit(1)).alias("n"))
    of = per.groupBy(F.col("duplicate_group").alias("_g")).agg(F.collect_list(F.struct(F.col(source).alias("source"), "n")).alias("_s"))  # a run has a few sources
    others = F.filter("_s", lambda x: (x["source"] != F.col(source)) | (x["n"] > 1))
    out = grouped.join(of, F.col("duplicate_group") == F.col("_g"))
    return out.withColumn("also_on", F.array_join(F.array_sort(F.transform(others, lambda x: x["source"])), ", ")).drop("_g", "_s")


def without_handled_groups(rows: DataFrame, handled: Column) -> DataFrame:
    """Rows whose duplicate_group has no handled member; rows without a group stay."""
    done = rows.where((F.col("duplicate_group") != "") & handled).select(F.col("duplicate_group").alias("_g")).distinct()
    return rows.join(done, F.col("duplicate_group") == F.col("_g"), "left_anti")
