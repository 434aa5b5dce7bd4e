"""Steps of a collection run and of the checks after it: identity over sources, category filter, listings, gaps filled from a posting's own text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import metadata as M
from ..functions import rules as R
from ..functions.text import fold, strip, text


def dedup_sources(rows: DataFrame, adapter: str, key: str, order: str) -> DataFrame:
    """First row of each key, as a run keeps it: first within each adapter, then over all of them.

    Adds duplicates (other rows of the key from the same adapter) and across (rows that other adapters
    kept). Both passes are sums with map-side combine, so that a hot key costs one row a task.
    """
    row = F.struct(order, *[c for c in rows.columns if c not in (order, adapter, key)])
    within = rows.groupBy(adapter, key).agg(F.min_by(row, order).alias("r"), (F.count(F.lit(1)) - 1).alias("duplicates"))
    first = F.struct(F.col(f"r.{order}").alias(order), adapter, "r", "duplicates")
    over = within.groupBy(key).agg(F.min_by(first, F.struct(f"r.{order}", adapter)).alias("f"), (F.count(F.lit(1)) - 1).alias("across"))
    return over.select(key, F.col(f"f.{adapter}").alias(adapter), "f.r.*", F.col("f.duplicates").alias("duplicates"), "across")


def union_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """The relations of several sources as one; columns that a source lacks are null."""
    out = None
    for part in parts.values():
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source")
    return out


def category_filter(rows: DataFrame, sources: tuple[str, ...], queries: dict[str, tuple[str, ...]] = R.QUERIES) -> DataFrame:
    """Rows of the given sources stay only if their title matches a phrase of their own category; rows of others all stay."""
    matches = M.category_matches(F.col("title"), F.col("job_category"), F.col("search_query"), queries)
    return rows.where(~F.col("source").isin(*sources) | matches)


def backfill(rows: DataFrame, stated: tuple[str, ...] = R.PAY_STATED) -> DataFrame:
    """Blank country, work format and salary of saved postings, from their own place and text; pay not for sources that state it."""
    c = F.col
    found = M.infer_work_format(c("full_text"))
    blank = text(c("work_format")).isin("", "Unknown")
    fmt = F.when(blank, F.when(found != "Unknown", found).otherwise(c("work_format"))).otherwise(c("work_format"))
    pay = F.when((text(c("salary")) == "") & ~c("source").isin(*stated), M.extract_salary(F.lit(""), c("full_text"))).otherwise(c("salary"))
    land = F.when(text(c("country")) == "", M.infer_country(c("city_region"))).otherwise(c("country"))
    return rows.withColumns({"country": land, "work_format": fmt, "salary": pay})


def company_listing(pages: DataFrame, page_size: int = 20) -> tuple[DataFrame, DataFrame]:
    """Pages of companies' listings (slug, page, total: null if not told, urls; failed pages have null urls) as (slug, url) and (slug, complete).

    A listing is complete if the total is told and the pages read before the first that failed or is missing reach it.
    """
    c = F.col
    read = pages.groupBy("slug", "page").agg(F.max("total").alias("total"), F.max(c("urls").isNotNull()).alias("read"))
    last = read.groupBy("slug").agg(F.max("total").alias("total"), F.collect_list(F.when(c("read"), c("page"))).alias("pages"))  # a listing has some fifty pages
    wanted = F.greatest(F.ceil(c("total") / page_size), F.lit(1))
    complete = c("total").isNotNull() & (F.size(F.array_except(F.sequence(F.lit(1).cast("long"), wanted), F.transform("pages", lambda p: p.cast("long")))) == 0)
    urls = pages.select("slug", F.explode("urls").alias("url")).select("slug", I.normalize_url(c("url")).alias("url")).where("url <> ''").distinct()
    return urls, last.select("slug", F.coalesce(complete, F.lit(False)).alias("complete"))


def listing_status(saved: DataFrame, urls: DataFrame, listings: DataFrame, status: str = "status") -> DataFrame:
    """saved (slug, url, ..) with active if the company lists the posting, closed if its whole listing lacks it, else unknown."""
    u = urls.select(F.col("slug").alias("_s"), F.col("url").alias("_u"))
    done = listings.select(F.col("slug").alias("_l"), F.col("complete").alias("_complete"))
    out = saved.join(u, (F.col("slug") == F.col("_s")) & (I.normalize_url(F.col("url")) == F.col("_u")), "left").join(done, F.col("slug") == F.col("_l"), "left")
    value = F.when(F.col("_u").isNotNull(), "active").when(F.coalesce("_complete", F.lit(False)), "closed").otherwise("unknown")
    return out.withColumn(status, value).drop("_s", "_u", "_l", "_complete")


def ats_presence(saved: DataFrame, jobs: DataFrame, name: str = "present") -> DataFrame:
    """saved (ats, slug, url, ..) with whether its board lists it: by address, or by the id that its address holds.

    jobs: ats, slug, id, absolute_url, hosted_url of every job that a board lists.
    """
    c = F.col
    by_url = lambda u: F.when(text(c(u)) != "", F.concat(F.lit("url:"), I.presence_url(c(u))))
    listed = F.explode(F.array(by_url("absolute_url"), by_url("hosted_url"), F.concat(F.lit("id:"), c("id").cast("string"))))
    keys = jobs.select(fold(c("ats")).alias("_a"), c("slug").alias("_b"), listed.alias("_k")).where("_k IS NOT NULL").distinct()
    asked = saved.select(fold(c("ats")).alias("_a"), c("slug").alias("_b"), I.presence_keys(c("ats"), c("url")).alias("_ks"), c("ats"), c("url")).distinct()
    found = asked.withColumn("_k", F.explode("_ks")).join(keys, ["_a", "_b", "_k"], "left_semi").select(c("ats").alias("_ats"), c("_b"), c("url").alias("_url")).distinct()
    on = c("ats").eqNullSafe(c("_ats")) & c("slug").eqNullSafe(c("_b")) & c("url").eqNullSafe(c("_url"))
    return saved.join(found, on, "left").withColumn(name, c("_b").isNotNull()).drop("_ats", "_b", "_url")


def recheck_report(rows: DataFrame, keys: list[str], status: str = "availability_status") -> DataFrame:
    """What a recheck found for each group: something open now, else something that could not be read, else still nothing."""
    some = lambda v: F.count_if(F.col(status) == v) > 0
    return rows.groupBy(*keys).agg(F.when(some("active"), "newly open").when(some("unknown"), "failed").otherwise("still empty").alias("outcome"))


def unscored(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Postings without a decision that have no fit score yet; scores: job_id, fit_score."""
    s = scores.select(F.col("job_id").alias("_j"), F.col("fit_score").alias("_score"))
    return rows.where(strip(F.col("decision")) == "").join(s, F.col("job_id") == F.col("_j"), "left").where(text(F.col("_score")) == "").drop("_j", "_score")


def draft_candidates(rows: DataFrame, drafts: DataFrame) -> DataFrame:
    """Postings decided for that are open and have no draft yet."""
    wanted = rows.where((strip(F.col("decision")) == R.YES) & (fold(F.col("availability_status")) == "active"))
    return wanted.join(drafts.select("job_id"), "job_id", "left_anti")


def copy_marks(rows: DataFrame, sheet: DataFrame, column: Column | str = "applied") -> DataFrame:
    """A mark set by hand in a sheet (job_id, and the column) goes to rows that have none."""
    marks = sheet.select(F.col("job_id").alias("_s"), F.col(column).alias("_mark"))
    value = F.when(strip(F.col(column)) == "", F.coalesce("_mark", F.lit(""))).otherwise(F.col(column))
    return rows.join(marks, F.col("job_id") == F.col("_s"), "left").withColumn(column, value).drop("_s", "_mark")


def observed_run(rows: DataFrame, keep: Column, path: str, sources: tuple[str, ...], source: str = "source", key: str = "key", order: str = "seq") -> DataFrame:
    """Writes the rows of a run that keep holds for, the first of each key within its source, and returns source, found,
    filtered_out, uniq, duplicates of each source, counted by observations of the one plan that writes: no second scan.

    sources are the adapters of a run, a fixed few. A stage that is run again after a lost executor may count its rows twice; reports
    that must not can be taken from the table (run_stats).
    """
    each = [F.count_if(F.col(source) == s).alias(f"n{i}") for i, s in enumerate(sources)]
    seen = {step: Observation() for step in ("found", "kept", "uniq")}
    kept = rows.observe(seen["found"], *each).where(keep).observe(seen["kept"], *each)
    row = F.struct(order, *[c for c in kept.columns if c not in (source, key, order)])
    first = kept.groupBy(source, key).agg(F.min_by(row, order).alias("r")).select(source, key, "r.*")
    first.observe(seen["uniq"], *each).write.mode("overwrite").parquet(path)
    n = {step: [o.get[f"n{i}"] for i in range(len(sources))] for step, o in seen.items()}
    told = [(s, f, f - k, u, k - u) for s, f, k, u in zip(sources, n["found"], n["kept"], n["uniq"], strict=True)]
    return rows.sparkSession.createDataFrame(told, "source string, found long, filtered_out long, uniq long, duplicates long")
