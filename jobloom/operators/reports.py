"""Reports over postings and reviews: gaps, demand, recommendations, rejections, certificates, apply list, application log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import metadata as M
from ..functions import rules as R
from ..functions.text import fold, holds, split_list, strip, text
from .dedup import cap_per_key, first_per_key
from .terms import quoted_line, wanted
from .terms import term_hits as find_terms


def run_stats(rows: DataFrame) -> DataFrame:
    """source, found, uniq, duplicates, filtered_out, errors, new, existing, updated for each source and for all ("TOTAL").

    rows: source, key, filtered and, if known, error (a request of that source that failed; it has no key) and state (new, existing or updated, as the merge told).
    """
    has = lambda c, v: F.col(c).cast("string") == v if c in rows.columns else F.lit(False)
    failed = F.coalesce(has("error", "true"), F.lit(False))
    states = ("new", "existing", "updated")
    per = rows.groupBy("source", "key").agg(
        F.count_if(~failed).alias("n"), F.count_if(~failed & ~F.col("filtered")).alias("kept"), F.count_if(failed).alias("errors"), *[F.count_if(has("state", s)).alias(s) for s in states]
    )
    out = per.rollup("source").agg(
        F.sum("n").alias("found"), F.count_if(F.col("kept") > 0).alias("uniq"),
        F.sum(F.greatest(F.col("kept") - 1, F.lit(0))).alias("duplicates"), F.sum(F.col("n") - F.col("kept")).alias("filtered_out"), *[F.sum(c).alias(c) for c in ("errors", *states)], F.grouping("source").alias("_g"),
    )
    return out.select(F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col("source")).alias("source"), "found", "uniq", "duplicates", "filtered_out", "errors", *states)


def near_fit_skills(joined: DataFrame) -> DataFrame:
    """seq, title, skill: distinct learnable skills of near-fit postings."""
    near = joined.where(M.is_near_fit(F.col("decision"), F.col("should_be_filtered")))
    both = F.array_union(split_list(F.col("required_skills")), split_list(F.col("preferred_skills")))
    return near.select("seq", strip(F.col("title")).alias("title"), F.explode(F.array_except(both, F.array(*[F.lit(s) for s in R.NOT_LEARNABLE]))).alias("skill"))


def skill_demand(joined: DataFrame, known=R.KNOWN_SKILLS, partial=R.PARTIAL_SKILLS) -> DataFrame:
    status = F.when(F.col("skill").isin(*partial), "partial").when(F.col("skill").isin(*known), "known").otherwise("gap")
    return near_fit_skills(joined).groupBy("skill").agg(F.count(F.lit(1)).alias("demand")).withColumn("status", status)


def skill_examples(joined: DataFrame, n: int = 3) -> DataFrame:
    """The first n distinct titles of each skill, in row order."""
    titles = near_fit_skills(joined).where("title <> ''").groupBy("skill", "title").agg(F.min("seq").alias("seq"))
    rn = F.row_number().over(Window.partitionBy("skill").orderBy("seq"))
    top = titles.withColumn("rn", rn).where(F.col("rn") <= n)
    return top.groupBy("skill").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "title"))), lambda x: x["title"]), " | ").alias("examples"))


def rejection_buckets(joined: DataFrame, n: int = 3) -> DataFrame:
    """bucket, postings, total_rejected, share, structural, examples."""
    rejected = joined.where(M.is_rejected(F.col("decision"), F.col("should_be_filtered")))
    reason = strip(F.col("main_reason"))
    found = M.reasons(F.concat(reason, F.lit("\n"), text(F.col("review_notes"))))
    excerpt = F.left(F.regexp_replace(reason, r"(?U)\s+", " "), F.lit(160))
    hits = rejected.select("seq", excerpt.alias("excerpt"), F.explode(found).alias("bucket"))
    counts = hits.groupBy("bucket").agg(F.count(F.lit(1)).alias("postings"))
    firsts = hits.where("excerpt <> ''").groupBy("bucket", "excerpt").agg(F.min("seq").alias("seq"))
    firsts = firsts.withColumn("rn", F.row_number().over(Window.partitionBy("bucket").orderBy("seq"))).where(F.col("rn") <= n)
    texts = firsts.groupBy("bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "excerpt"))), lambda x: x["excerpt"]), " | ").alias("examples"))
    total = rejected.agg(F.count(F.lit(1)).alias("total_rejected"))
    out = counts.join(texts, "bucket", "left").crossJoin(F.broadcast(total))  # one row
    share = F.bround(100.0 * F.col("postings") / F.greatest("total_rejected", F.lit(1)), 1)
    return out.select("bucket", "postings", "total_rejected", share.alias("share_pct"), F.col("bucket").isin(*R.STRUCTURAL).alias("structural"), F.coalesce("examples", F.lit("")).alias("examples"))


def market(postings: DataFrame) -> DataFrame:
    """The first posting of each company and title."""
    return first_per_key(postings, [I.company_title_key(F.col("company"), F.col("title"))], [F.col("seq")])


def _unpivot(counts: DataFrame, names: list[str], value: str, key: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias(key), F.col(f"c{i}").alias(value)) for i, n in enumerate(names)])
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


def market_demand(postings: DataFrame, rules=R.SKILLS) -> DataFrame:
    """skill, market, certs, market_total: all patterns counted in one pass over the market."""
    t = fold(F.concat(text(F.col("title")), F.lit("\n"), text(F.col("full_text"))))
    base = market(postings.select("seq", "company", "title", "full_text")).select(t.alias("t"))
    aggs = [F.count_if(holds(F.col("t"), p)).alias(f"m{i}") for i, (_, p) in enumerate(rules)]
    aggs += [F.count_if(holds(F.col("t"), M.cert_near(p))).alias(f"k{i}") for i, (_, p) in enumerate(rules)]
    one = base.agg(F.count(F.lit(1)).alias("total"), *aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("skill"), F.col(f"m{i}").alias("market"), F.col(f"k{i}").alias("certs"), F.col("total").alias("market_total")) for i, (n, _) in enumerate(rules)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def recommendations(joined: DataFrame, postings: DataFrame) -> DataFrame:
    need = skill_demand(joined).where("status <> 'known'")
    rows = need.join(F.broadcast(market_demand(postings)), "skill", "left")  # a row for each rule
    total, have, certs = F.coalesce("market_total", F.lit(0)), F.coalesce("market", F.lit(0)), F.coalesce("certs", F.lit(0))
    share = F.when(total > 0, have / total).otherwise(0.0)
    action = F.when(F.col("demand") < R.LEAST_NEAR_FIT, "low priority").when(share >= R.LEARN_SHARE, F.when(F.col("skill").isin(*R.LOW_CONFIDENCE), "verify first").otherwise("learn")).when(share >= R.OPTIONAL_SHARE, "optional").otherwise("low priority")
    advice = (
        F.when(certs >= R.LEAST_CERTS, F.format_string("certificate mentioned in %d postings: worth considering", certs))
        .when(certs > 0, F.format_string("certificate mentioned in %d posting(s): not a market signal, learn the skill instead", certs))
        .otherwise("no certificate asked: learn the skill, skip the exam")
    )
    note = F.when(F.col("skill").isin(*R.LOW_CONFIDENCE), "pattern matches short or generic tokens, market count is inflated").otherwise("")
    out = rows.select("skill", "status", F.col("demand").alias("near_fit"), have.alias("market"), share.alias("share"), certs.alias("certs"), action.alias("action"), advice.alias("advice"), note.alias("note"))
    line = F.concat(
        F.rpad(F.upper("action"), 13, " "), F.lit(" "), F.col("skill"), F.lit(": near-fit "), F.col("near_fit").cast("string"), F.lit(", all postings "), F.col("market").cast("string"), F.lit(" ("),
        F.bround(100 * F.col("share"), 0).cast("int").cast("string"), F.lit("%); "), F.col("advice"),
        F.when(F.col("status") == "partial", " [known at a basic level: go deeper]").otherwise(""), F.when(F.col("note") != "", F.concat(F.lit(" ["), F.col("note"), F.lit("]"))).otherwise(""),
    )
    return out.withColumn("line", line)


MARKET_COLUMNS = ("seq", "company", "title", "full_text", "seniority", "work_format", "country")


def term_hits(postings: DataFrame) -> DataFrame:
    """seq, term, grp, level, place, status, quote for each posting of the market and each term that it names."""
    hits = find_terms(market(postings.select(*MARKET_COLUMNS)))
    return hits.withColumns({"status": wanted(F.col("hit")), "quote": quoted_line(F.col("hit"))}).drop("hit")


def quote_samples(hits: DataFrame, n: int = 3, seed: int = 1) -> DataFrame:
    """n quotes of each term, chosen by a hash: a bounded rank, so that a hot term sends n rows of each task."""
    return cap_per_key(hits.select("term", "seq", "quote"), ["term"], [F.md5(F.concat(F.lit(f"{seed}:"), "quote")), F.col("seq")], n)


def cert_report(postings: DataFrame) -> DataFrame:
    """One row for each of the 21 terms, zeros included."""
    spark = postings.sparkSession
    terms = spark.createDataFrame([(n, "certificate") for n, _ in R.CERTIFICATES] + [(n, "tool") for n, _ in R.TOOLS], "term string, grp string")
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    counts = term_hits(postings).groupBy("term").agg(
        F.count(F.lit(1)).alias("postings"), is_("level", "junior").alias("junior"), is_("level", "middle").alias("middle"), is_("level", "senior").alias("senior_lead_manager"), is_("level", "unknown").alias("level_unknown"),
        is_("place", "europe").alias("europe"), is_("place", "remote").alias("remote"), is_("place", "other").alias("other_location"),
        is_("status", "required").alias("req"), is_("status", "preferred").alias("pref"), is_("status", "mentioned").alias("only"),
    )
    total = F.broadcast(market(postings).agg(F.count(F.lit(1)).alias("total")))  # one row
    out = terms.join(counts, "term", "left").crossJoin(total).na.fill(0)
    cert = lambda c: F.when(F.col("grp") == "certificate", F.col(c).cast("string")).otherwise("")
    return out.select(
        "term", "grp", "postings", F.when(F.col("total") > 0, F.bround(100.0 * F.col("postings") / F.col("total"), 1)).otherwise(0.0).alias("pct_of_all"),
        "junior", "middle", "senior_lead_manager", "level_unknown", "europe", "remote", "other_location", cert("req").alias("cert_required"), cert("pref").alias("cert_preferred"), cert("only").alias("cert_mentioned_only"),
    )


def cert_guards(postings: DataFrame, least: int = 50) -> DataFrame:
    """ok, missing columns, postings of the market."""
    missing = sorted({"title", "company", "full_text", "seniority", "work_format", "country"} - set(postings.columns))
    if missing:
        return postings.sparkSession.createDataFrame([(False, ", ".join(missing), 0)], "ok boolean, missing string, postings long")
    return market(postings).agg(F.count(F.lit(1)).alias("postings")).select((F.col("postings") >= least).alias("ok"), F.lit("").alias("missing"), "postings")


def handled(joined: DataFrame, applications: DataFrame) -> DataFrame:
    """joined with a column handled: by job_id, by URL, or by mark. Two semi flags, never one join on an OR."""
    done = applications.where(strip(F.col("status")).isin(*R.HANDLED))
    by_id = done.where(strip(F.col("job_id")) != "").select(strip(F.col("job_id")).alias("_hid")).distinct()
    by_url = done.where(strip(F.col("url")) != "").select(I.normalize_url(F.col("url")).alias("_hurl")).distinct()
    out = joined.join(by_id, text(F.col("job_id")) == F.col("_hid"), "left").join(by_url, I.normalize_url(F.col("url")) == F.col("_hurl"), "left")
    return out.withColumn("handled", F.col("_hid").isNotNull() | F.col("_hurl").isNotNull() | (strip(F.col("applied")) != "")).drop("_hid", "_hurl")


def near_fit_list(joined: DataFrame, applications: DataFrame) -> DataFrame:
    """Open near-fit postings not yet handled, one for each group, with the sources of its other copies."""
    rows = handled(joined, applications).withColumn("_g", strip(F.col("duplicate_group")))
    done = rows.where((F.col("_g") != "") & F.col("handled")).select("_g").distinct()
    kept = rows.where(M.is_near_fit(F.col("decision"), F.col("should_be_filtered")) & (strip(F.col("availability_status")) == "active") & ~F.col("handled"))
    kept = kept.join(done, "_g", "left_anti")
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in R.SOURCE_ORDER]), F.col("source")), F.lit(0)), F.lit(99))
    unit = F.when(F.col("_g") != "", F.col("_g")).otherwise(F.concat(F.lit("seq:"), F.col("seq").cast("string")))
    best = first_per_key(kept, [unit], [(strip(F.col("decision")) != R.YES), place, text(F.col("job_id")), F.col("seq")])
    # copies of each source are counted, so that the shown row can be taken off its own source
    sources = rows.where("_g <> ''").groupBy("_g", "source").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("_g").alias("_og")).agg(F.collect_list(F.struct("source", "n")).alias("_s"))
    out = best.join(sources, F.col("_g") == F.col("_og"), "left")
    others = F.filter("_s", lambda s: (s["source"] != F.col("source")) | (s["n"] > 1))
    also = F.coalesce(F.array_join(F.array_sort(F.transform(others, lambda s: s["source"])), ", "), F.lit(""))
    return out.withColumn("also_on", also).drop("_g", "_og", "_s", "handled")


def resolve_keys(existing: DataFrame, records: DataFrame, order: Column) -> DataFrame:
    """Log rows keyed by URL take the job_id of the posting with that URL; of rows that meet, one with a decision stays."""
    urls = records.where(strip(F.col("url")) != "").select(I.normalize_url(F.col("url")).alias("_u"), F.struct("seq", "job_id").alias("_j")).groupBy("_u").agg(F.max("_j").alias("_j"))
    rows = existing.withColumn("_k", I.app_key(F.col("job_id"), F.col("url"))).where(F.col("_k").isNotNull())
    rows = rows.join(urls, F.col("_k") == F.concat(F.lit("url:"), F.col("_u")), "left").withColumn("key", F.coalesce("_j.job_id", "_k")).drop("_u", "_j", "_k")
    # the first row with a decision wins; without one the last row
    decided = ~text(F.col("status")).isin("", "draft")
    w = Window.partitionBy("key").orderBy(F.when(decided, 0).otherwise(1), F.when(decided, order).otherwise(-order))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def build_applications(drafts: DataFrame, records: DataFrame, existing: DataFrame, today: str) -> DataFrame:
    """Rows of the log: every draft, and every other row with a decision. existing has key (resolve_keys)."""
    e = existing.select("key", *[F.col(c).alias(f"e_{c}") for c in ("status", "response", "date_sent", "notes", "date_added", "title", "company", "url")])
    r = records.select(F.col("job_id").alias("r_id"), *[F.col(c).alias(f"r_{c}") for c in ("title", "company", "url", "date_published", "date_collected")])
    d = drafts.select(F.col("job_id").alias("d_id"), "review_verdict", "pdf_ready")
    rows = d.join(e, F.col("d_id") == F.col("key"), "full_outer").withColumn("id", F.coalesce("d_id", "key"))
    rows = rows.join(r, F.col("id") == F.col("r_id"), "left")
    drafted, has = F.col("d_id").isNotNull(), F.col("r_id").isNotNull()
    status = F.when(drafted, F.coalesce(F.nullif(text(F.col("e_status")), F.lit("")), F.lit("draft"))).otherwise(F.coalesce(F.nullif(strip(F.col("e_status")), F.lit("")), F.lit("sent")))
    sent = M.date_text(F.col("e_date_sent"))
    part = lambda c: F.when(has, text(F.col(f"r_{c}"))).when(drafted, "").otherwise(text(F.col(f"e_{c}")))
    published, found = M.parse_date(F.col("r_date_published")), M.parse_date(F.col("r_date_collected"))
    out = rows.select(
        F.when(F.col("id").startswith("url:"), "").otherwise(F.col("id")).alias("job_id"), part("title").alias("title"), part("company").alias("company"), part("url").alias("url"), status.alias("status"),
        text(F.col("e_response")).alias("response"), sent.alias("date_sent"), text(F.col("e_notes")).alias("notes"), F.coalesce(F.nullif(M.date_text(F.col("e_date_added")), F.lit("")), F.lit(today)).alias("date_added"),
        F.when(drafted, text(F.col("review_verdict"))).otherwise("").alias("review_verdict"), F.when(drafted, F.when(F.col("pdf_ready"), "Да").otherwise("Нет")).otherwise("").alias("pdf_ready"),
        F.coalesce(F.date_format(published, "yyyy-MM-dd"), F.lit("")).alias("date_published"), M.days_between(M.parse_date(sent), published).alias("days_from_published"), M.days_between(M.parse_date(sent), found).alias("days_from_found"),
        drafted.alias("_d"),
    )
    return out.where(F.col("_d") | (F.col("status") != "draft")).drop("_d")


def apply_marks(existing: DataFrame, marks: DataFrame, today: str) -> DataFrame:
    """Marks (job_id, applied) folded into the log: new rows and drafts become sent, decided rows stay."""
    m = marks.where(strip(F.col("applied")) != "").select(F.col("job_id").alias("_m"), M.mark_date(F.col("applied"), F.lit(today)).alias("_on"))
    both = existing.join(m, F.col("key") == F.col("_m"), "full_outer")
    new, hit = F.col("key").isNull(), F.col("_m").isNotNull() & text(F.col("status")).isin("", "draft", "approved")
    sent = M.date_text(F.col("date_sent"))
    return both.select(
        F.coalesce("key", "_m").alias("key"), F.when(new | hit, "sent").otherwise(F.col("status")).alias("status"),
        F.when(new, F.col("_on")).when(hit, F.coalesce(F.nullif(sent, F.lit("")), F.col("_on"))).otherwise(F.col("date_sent")).alias("date_sent"),
        F.when(new, "").otherwise(F.col("notes")).alias("notes"), F.when(new, F.lit(today)).otherwise(F.col("date_added")).alias("date_added"),
    )


def join_manual_inputs(postings: DataFrame, review: DataFrame, inputs: list[str]) -> DataFrame:
    """Review rows rebuilt from the postings; what a human typed comes along by job_id."""
    r = review.select(F.col("job_id").alias("_r"), *[F.col(c).alias(f"_{c}") for c in inputs])
    out = postings.drop(*inputs).join(r, F.col("job_id") == F.col("_r"), "left")
    return out.withColumns({c: text(F.col(f"_{c}")) for c in inputs}).drop("_r", *[f"_{c}" for c in inputs])


def join_review_master(review: DataFrame, master: DataFrame) -> DataFrame:
    """Review rows with the master's columns; where both have one, the review's counts, blank or not."""
    extra = [c for c in master.columns if c not in review.columns]
    return review.join(master.select("job_id", *extra), "job_id", "left")


def join_records(log: DataFrame, records: DataFrame) -> DataFrame:
    """Rows of the log, or drafts, each with its posting's columns; a row whose posting is gone keeps its own."""
    extra = [c for c in records.columns if c not in log.columns]
    return log.join(records.select(F.col("job_id").alias("_r"), *extra), F.col("job_id") == F.col("_r"), "left").drop("_r")
