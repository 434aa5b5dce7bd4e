"""Queries of the collection run and the checks after it, each beside its SQL. Texts under test have every marker planted in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import metadata as M
from ..functions import rules as R
from ..functions.html import without_upsell
from ..operators import collection as C
from ..operators import reports as P
from ..operators.store import fresh_dir
from ..sources import feeds as S
from ..sources import tables as T
from .more_queries import _drafted, flag
from .queries import SQL as _SQL
from .queries import Query, _match_sql
from .source_queries import _folder
from .view import WITH, any_sql, postings, q, sql_list

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _pick(values, n):
    """One of the values for each row, by turns."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def _pick_sql(values, n: str) -> str:
    return f"{sql_list(values)}[({n} % {len(values)} + 1)::INT]"


# --- availability ----------------------------------------------------------------------------------------------------

_STATUS = (404, 410, 500, None, 302, 200, 200, 200, 200, 200, 200)
_GENERIC = tuple(m.title() for m in R.CLOSED_BANNERS) + ("job is closed", "no longer available", "", "")


@query(f"""WITH b AS (SELECT page_id, CASE WHEN page_id % 13 = 0 THEN ' ' ELSE html || ' ' || {_pick_sql(_GENERIC, 'page_id')} END AS body,
[{', '.join('NULL' if s is None else str(s) for s in _STATUS)}][(page_id % {len(_STATUS)} + 1)::INT] AS status FROM pages),
s AS (SELECT page_id, CASE WHEN status IN (404, 410) OR {any_sql('lower(body)', R.CLOSED_BANNERS)} THEN 'closed' WHEN status >= 200 AND status < 400 AND trim(body) <> '' THEN 'active' ELSE 'unknown' END AS state FROM b)
SELECT page_id, state, CASE WHEN state = 'unknown' AND page_id % 2 = 0 THEN 'closed' ELSE state END AS kept FROM s""")
def generic_availability(spark, d):
    """Status and banner of whole pages, and what is kept of a posting known to be closed."""
    n = F.col("page_id")
    body = F.when(n % 13 == 0, " ").otherwise(F.concat("html", F.lit(" "), _pick(_GENERIC, n)))
    state = M.availability(_pick(_STATUS, n), body)
    before = F.when(n % 2 == 0, "closed").otherwise("active")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", state.alias("state")).withColumn("kept", M.keep_known_closed(before, F.col("state")))


_LI_URLS = ("https://www.linkedin.com/jobs/view/1", "https://www.linkedin.com/JOBS/View/2", "https://www.linkedin.com/jobs/search", "https://www.linkedin.com/jobs/view/3", *[f"https://www.linkedin.com{u}?next=/jobs/view/4" for u in R.LINKEDIN_WALL_URLS])
_LI_TEXTS = ("", "", *[m.upper() for m in R.LINKEDIN_CLOSED], "", "", *R.LINKEDIN_WALL_TEXTS, "position has been filled")
_WTTJ_URLS = ("https://www.welcometothejungle.com/en/companies/a/jobs/b", "https://www.welcometothejungle.com/EN/Companies/a/Jobs/b", "https://www.welcometothejungle.com/en/companies/a", *[f"https://www.welcometothejungle.com{u}?to=/jobs/c" for u in R.WTTJ_WALL_URLS])
_WTTJ_TEXTS = ("", "", *[m.title() for m in R.WTTJ_CLOSED], "", "page not found")


def _body(texts):
    return F.when(F.col("seq") % 23 == 0, " \n").otherwise(F.concat("full_text", F.lit("\n"), _pick(texts, F.floor(F.col("seq") / 3))))


def _body_sql(texts) -> str:
    return f"CASE WHEN seq % 23 = 0 THEN ' ' || chr(10) ELSE full_text || chr(10) || {_pick_sql(texts, '(seq // 3)')} END"


def _site_sql(urls, texts, wall: str, closed, path: str) -> str:
    return f"""{WITH}, b AS (SELECT seq, lower({_pick_sql(urls, 'seq')}) AS u, lower({_body_sql(texts)}) AS t FROM p)
SELECT seq, CASE WHEN {wall} THEN 'unknown' WHEN {any_sql('t', closed)} THEN 'closed' WHEN contains(u, '{path}') AND trim(replace(t, chr(10), ' ')) <> '' THEN 'active' ELSE 'unknown' END AS value FROM b"""


@query(_site_sql(_LI_URLS, _LI_TEXTS, f"{any_sql('u', R.LINKEDIN_WALL_URLS)} OR {any_sql('t', R.LINKEDIN_WALL_TEXTS)}", R.LINKEDIN_CLOSED, "/jobs/view/"))
def linkedin_availability(spark, d):
    return postings(spark, d).select("seq", M.linkedin_availability(_pick(_LI_URLS, F.col("seq")), _body(_LI_TEXTS)).alias("value"))


@query(_site_sql(_WTTJ_URLS, _WTTJ_TEXTS, any_sql("u", R.WTTJ_WALL_URLS), R.WTTJ_CLOSED, "/jobs/"))
def wttj_availability(spark, d):
    return postings(spark, d).select("seq", M.wttj_availability(_pick(_WTTJ_URLS, F.col("seq")), _body(_WTTJ_TEXTS)).alias("value"))


def _pages(spark, d):
    """Landed pages of companies' listings: 20 postings a page; of some companies a page is missing or failed, or the total isn't told."""
    p, c = postings(spark, d), F.col
    rows = p.where("seq % 5 <> 0").select(c("source").alias("slug"), (F.floor(c("seq") / 20) % 50 + 1).alias("page"), "url")
    pages = rows.groupBy("slug", "page").agg(F.collect_list("url").alias("urls"))
    most = pages.groupBy("slug").agg(F.max("page").alias("most"))
    told = F.when(F.ascii(F.substring("slug", -1, 1)) % 3 != 0, c("most") * 20)
    return pages.join(most, "slug").select("slug", "page", told.alias("total"), F.when((c("page") == 2) & (F.ascii(F.substring("slug", -1, 1)) % 4 == 1), F.lit(None)).otherwise(c("urls")).alias("urls"))


@query(f"""{WITH}, r AS (SELECT source AS slug, (seq // 20) % 50 + 1 AS page, seq % 100 AS u FROM p WHERE seq % 5 <> 0),
g AS (SELECT slug, page, list(u) AS us FROM r GROUP BY ALL),
f AS (SELECT slug, page, us, page = 2 AND ascii(right(slug, 1)) % 4 = 1 AS failed FROM g),
l AS (SELECT slug, ascii(right(slug, 1)) % 3 <> 0 AND count(*) FILTER (WHERE NOT failed) = max(page) AS complete FROM f GROUP BY slug),
o AS (SELECT DISTINCT slug, unnest(us) AS u FROM f WHERE NOT failed)
SELECT p.seq, CASE WHEN o.u IS NOT NULL THEN 'active' WHEN l.complete THEN 'closed' ELSE 'unknown' END AS status FROM p LEFT JOIN o ON p.source = o.slug AND p.seq % 100 = o.u LEFT JOIN l ON p.source = l.slug""")
def listing_status(spark, d):
    """Saved postings against whole listings of their companies: what an incomplete one lacks proves nothing."""
    urls, listings = C.company_listing(_pages(spark, d))
    return C.listing_status(postings(spark, d).select("seq", F.col("source").alias("slug"), "url"), urls, listings).select("seq", "status")


_ATS = ("Greenhouse", "lever", "bamboohr")


@query(f"""{WITH}, b AS (SELECT seq, seq % 3 AS a, (seq // 3) % 9 AS k FROM p)
SELECT seq, CASE WHEN a = 1 THEN k < 6 ELSE k < 7 END AS present FROM b""")
def ats_presence(spark, d):
    """Found by address, by gh_jid, or by the id under /careers/; boards list two of three ids and some addresses."""
    n = F.col("seq")
    k = F.floor(n / 3) % 9
    by_url = F.concat(F.lit("HTTPS://Jobs.Example/p"), n.cast("string"), F.lit("/?x=1"))
    by_id = F.when(n % 3 == 0, F.concat(F.lit("https://own.example/job?gh_jid="), n.cast("string"))).otherwise(F.concat(F.lit("https://b.example/careers/"), n.cast("string")))
    saved = postings(spark, d).select("seq", _pick(_ATS, n).alias("ats"), F.col("source").alias("slug"), F.when((n % 3 == 1) | (k >= 3), F.when(n % 3 == 1, by_url).otherwise(by_id)).otherwise(by_url).alias("url"))
    listed = saved.where(F.when(n % 3 == 1, k < 6).otherwise(k < 7))
    address = F.when(F.col("url") == by_url, F.concat(F.lit("https://jobs.example/p"), n.cast("string")))
    jobs = listed.select("ats", "slug", F.when(n % 3 != 1, n).alias("id"), F.when(n % 2 == 0, address).alias("absolute_url"), F.when(n % 2 == 1, address).alias("hosted_url"))
    return C.ats_presence(saved, jobs).select("seq", "present")


@query("SELECT page_id, lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://' || lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) || regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS url FROM pages")
def presence_url(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", I.presence_url(F.col("url")).alias("url"))


@query(f"{WITH} SELECT seq, 'greenhouse' AS ats, 'board ' || (seq % 9)::VARCHAR AS slug, 'acme-' || (seq % 9)::VARCHAR AS company FROM p WHERE seq % 4 <> 3")
def parse_ats_board(spark, d):
    """Notes of a board, and notes that are none."""
    n = (F.col("seq") % 9).cast("string")
    note = F.when(F.col("seq") % 4 == 3, F.concat(F.lit("ATS: Workday; board: board"), n)).otherwise(F.concat(F.lit("ats: Greenhouse;  board: board "), n, F.lit(" ; seen")))
    s = postings(spark, d).select("seq", M.ats_board(note).alias("b"), M.company_slug(F.concat(F.lit("https://x.example/companies/acme-"), n, F.lit("/jobs?x=1"))).alias("company"))
    return s.where("b IS NOT NULL").select("seq", "b.ats", "b.slug", "company")


# --- a run -----------------------------------------------------------------------------------------------------------


@query(f"""{WITH}, k AS (SELECT board, source, seq % 100 AS u, min(seq) AS first, count(*) - 1 AS duplicates FROM p GROUP BY ALL)
SELECT min(first) AS seq, arg_min(board, first) AS board, arg_min(duplicates, first)::BIGINT AS duplicates, (count(*) - 1)::BIGINT AS across FROM k GROUP BY source, u""")
def dedup_first(spark, d):
    """First within each board, then over all boards."""
    c = F.col
    keyed = postings(spark, d).select("seq", "board", I.dedup_key(c("source"), c("url"), c("company"), c("title"), c("city_region")).alias("k"))
    return C.dedup_sources(keyed, "board", "k", "seq").select("seq", "board", "duplicates", "across")


_CATEGORIES = ("data", "crypto", "risk", "market_data", "sales")


@query(f"""{WITH}, c AS (SELECT *, {_pick_sql(_CATEGORIES, 'seq')} AS job_category FROM p)
SELECT seq FROM c WHERE board NOT IN ('LinkedIn', 'Jobicy') OR CASE job_category {' '.join(f"WHEN {q(n)} THEN " + ' OR '.join(_match_sql(x) for x in R.QUERIES[n]) for n in _CATEGORIES[:-1])} ELSE {_match_sql('Analyst, Fraud')} END""")
def category_query_filter(spark, d):
    """Titles against the phrases of each record's own category; one category has none and goes by the phrase it was searched by."""
    rows = postings(spark, d).select("seq", F.col("board").alias("source"), "title", _pick(_CATEGORIES, F.col("seq")).alias("job_category"), F.lit("Analyst, Fraud").alias("search_query"))
    return C.category_filter(rows, ("LinkedIn", "Jobicy")).select("seq")


@query(f"""WITH f AS ({_SQL['infer_work_format']}), s AS ({_SQL['extract_salary']}), {WITH.removeprefix('WITH ')}
SELECT p.seq, CASE WHEN p.country <> '' THEN p.country WHEN p.city_region = 'Europe' THEN 'Europe' ELSE '' END AS country,
CASE WHEN p.work_format = 'Unknown' THEN f.work_format ELSE p.work_format END AS work_format,
CASE WHEN p.salary <> '' OR p.board IN ('Jobicy', 'Himalayas') THEN p.salary ELSE s.salary END AS salary
FROM p JOIN f ON p.seq = f.seq JOIN s ON p.seq = s.seq""")
def backfill_saved_metadata(spark, d):
    rows = postings(spark, d).select("seq", F.col("board").alias("source"), "city_region", "country", "work_format", "salary", "full_text")
    return C.backfill(rows).select("seq", "country", "work_format", "salary")


_STATES = ("new", "existing", "existing", "updated")


@query(f"""{WITH}, r AS (SELECT source, seq % 100 AS k, availability_status <> 'closed' AS kept, seq % 41 = 0 AS error, {_pick_sql(_STATES, 'seq')} AS state FROM p),
k AS (SELECT source, k, count(*) FILTER (WHERE NOT error) AS n, count(*) FILTER (WHERE kept AND NOT error) AS kept, count(*) FILTER (WHERE error) AS errors,
{', '.join(f"count(*) FILTER (WHERE state = '{s}') AS {s}" for s in ('new', 'existing', 'updated'))} FROM r GROUP BY ALL)
SELECT coalesce(source, 'TOTAL') AS source, sum(n)::BIGINT AS found, (count(*) FILTER (WHERE kept > 0))::BIGINT AS uniq, sum(greatest(kept - 1, 0))::BIGINT AS duplicates, sum(n - kept)::BIGINT AS filtered_out,
sum(errors)::BIGINT AS errors, sum(new)::BIGINT AS new, sum(existing)::BIGINT AS existing, sum(updated)::BIGINT AS updated FROM k GROUP BY ROLLUP (source)""")
def run_stats(spark, d):
    c = F.col
    p = postings(spark, d).select(
        "source", I.dedup_key(c("source"), c("url"), c("company"), c("title"), c("city_region")).alias("key"), (c("availability_status") == "closed").alias("filtered"),
        (c("seq") % 41 == 0).alias("error"), _pick(_STATES, c("seq")).alias("state"),
    )
    return P.run_stats(p)


@query(f"""{WITH} SELECT company, title, CASE WHEN count(*) FILTER (WHERE availability_status = 'active') > 0 THEN 'newly open' WHEN count(*) FILTER (WHERE availability_status = 'unknown') > 0 THEN 'failed' ELSE 'still empty' END AS outcome FROM p GROUP BY company, title""")
def recheck_report(spark, d):
    return C.recheck_report(postings(spark, d), ["company", "title"])


@query(f"{WITH} SELECT seq FROM p WHERE decision = '' AND seq % 3 <> 0")
def undecided_unscored(spark, d):
    p = postings(spark, d)
    return C.unscored(p, p.where("seq % 3 = 0").select("job_id", F.lit("50").alias("fit_score"))).select("seq")


@query(f"{WITH} SELECT seq FROM p WHERE decision = {q(R.YES)} AND availability_status = 'active' AND seq % 5 <> 0")
def draft_candidates(spark, d):
    p = postings(spark, d)
    return C.draft_candidates(p, p.where("seq % 5 = 0")).select("seq")


@query(f"{WITH} SELECT seq, CASE WHEN applied = '' AND seq % 5 = 0 THEN {q(R.MARK)} ELSE applied END AS applied FROM p")
def copy_applied_marks(spark, d):
    p = postings(spark, d)
    return C.copy_marks(p, p.where("seq % 5 = 0").select("job_id", F.lit(R.MARK).alias("applied"))).select("seq", "applied")


@query(f"{WITH} SELECT title, company FROM p WHERE decision = {q(R.YES)} EXCEPT SELECT title, company FROM p WHERE availability_status = 'closed'")
def except_distinct(spark, d):
    p = postings(spark, d)
    return p.where(F.col("decision") == R.YES).select("title", "company").subtract(p.where("availability_status = 'closed'").select("title", "company"))


@query(f"{WITH} SELECT unnest(string_split(required_skills, '; ')) AS skill FROM p UNION SELECT unnest(string_split(preferred_skills, '; ')) FROM p")
def union_distinct(spark, d):
    p = postings(spark, d)
    part = lambda c: p.select(F.explode(F.split(c, "; ")).alias("skill"))
    return part("required_skills").union(part("preferred_skills")).distinct()


@query(f"{WITH} SELECT seq, CASE WHEN seq % 3 = 0 THEN seq % 5 >= 4 WHEN seq % 3 = 1 THEN (seq % 5 + 1) * 20 < seq % 120 ELSE FALSE END AS more FROM p")
def has_more_pages(spark, d):
    """The total decides where it is told, else whether the page was full."""
    n = F.col("seq")
    jobs = F.transform(F.sequence(F.lit(1), F.when(n % 5 >= 4, 20).otherwise(19)), lambda i: F.struct(i.cast("string").alias("guid")))
    told = F.when(n % 3 == 1, n % 120).when(n % 3 == 2, F.lit(20).cast("long"))
    payload = F.to_json(F.struct(F.when(n % 3 == 0, jobs).otherwise(F.slice(jobs, 1, 2)).alias("jobs"), told.alias("totalCount")))
    return postings(spark, d).select("seq", S.has_more_pages(payload, F.when(n % 3 == 1, n % 5 + 1).otherwise(F.lit(1))).alias("more"))


# --- analysis, prompts, files ----------------------------------------------------------------------------------------


#: Of the view's own texts, places and pay; the rules of each have queries of their own over more of them.
_OWN_YEARS = f"{WITH} SELECT seq, CASE seq % 10 WHEN 1 THEN '5' WHEN 3 THEN '2' ELSE '' END AS low, CASE seq % 10 WHEN 1 THEN '5' WHEN 3 THEN '4' ELSE '' END AS high FROM p"
_OWN_PLACE = f"""{WITH}, k AS (SELECT seq, CASE WHEN country <> '' AND ends_with(city_region, ', ' || country) THEN left(city_region, length(city_region) - length(country) - 2) ELSE city_region END AS c FROM p)
SELECT seq, string_split(c, ', ')[1] AS city, array_to_string(string_split(c, ', ')[2:], ', ') AS region FROM k"""
_OWN_PAY = f"{WITH} SELECT seq, {sql_list(('', '≈48,600-59,400 USD', '', '≈32,400 USD', '≈1,200 USD', '≈51,400-57,500 USD'))}[(seq % 6 + 1)::INT] AS usd FROM p"


@query(f"""WITH r AS ({_SQL['classify_role']}), l AS ({_SQL['classify_seniority']}), y AS ({_OWN_YEARS}), s AS ({_SQL['extract_skills']}),
h AS ({_SQL['required_preferred']}), c AS ({_OWN_PLACE}), u AS ({_OWN_PAY})
SELECT r.seq, r.role AS role_family, r.role AS role_subcategory, l.level AS seniority, y.low AS years_experience_min, y.high AS years_experience_max, s.skills AS skills_all, h.required AS required_skills,
h.preferred AS preferred_skills, c.city, c.region, u.usd AS salary_usd_equivalent, {q(R.ANALYSIS_NOTE)} AS analysis_note
FROM r JOIN l USING (seq) JOIN y USING (seq) JOIN s USING (seq) JOIN h USING (seq) JOIN c USING (seq) JOIN u USING (seq)""")
def analyze_record(spark, d):
    """All analysis columns in one projection."""
    c = F.col
    return postings(spark, d).select("seq", M.analyze(c("title"), c("full_text"), c("city_region"), c("country"), c("salary")).alias("a")).select("seq", "a.*")


_CV = "CANDIDATE CV:\nAnn Smith\n\n---\n\nJOB POSTING:\n"


def _sql_text(*parts: str) -> str:
    """Parts of a text, columns named in braces; line feeds as DuckDB wants them."""
    return " || ".join(p[1:-1] if p.startswith("{") else " || chr(10) || ".join(q(x) for x in p.split("\n")) for p in parts)


_TITLE = ("Title: ", "{title}", "\nCompany: ", "{company}")
_WHERE = ("\nLocation: ", "{city_region}", " (", "{country}", ")\nWork format: ", "{work_format}")
_TEXT = ("\nDescription:\n", "{left(full_text, 6000)}")


@query(f"""{WITH} SELECT seq, {_sql_text(_CV, *_TITLE, *_WHERE, chr(10) + 'Seniority (rule-based guess, may be wrong): ', '{seniority}', *_TEXT)} AS fit_score,
{_sql_text(_CV, *_TITLE, *_WHERE, *_TEXT)} AS cv_draft, {_sql_text(_CV, *_TITLE, *_TEXT, chr(10) * 2 + '---' + chr(10) * 2 + 'DRAFT TO REVIEW:' + chr(10) + '# T')} AS review FROM p""")
def llm_prompts(spark, d):
    """The three prompts of a posting."""
    c, cv = F.col, F.lit("Ann Smith")
    place = (c("city_region"), c("country"), c("work_format"))
    return postings(spark, d).select(
        "seq", M.fit_score_prompt(cv, c("title"), c("company"), *place, c("seniority"), c("full_text")).alias("fit_score"),
        M.cv_draft_prompt(cv, c("title"), c("company"), *place, c("full_text")).alias("cv_draft"), M.review_prompt(cv, c("title"), c("company"), c("full_text"), F.lit("# T")).alias("review"),
    )


@query(f"{WITH} SELECT job_id, CASE WHEN seq % 2 = 0 THEN 'approved' ELSE '' END AS review_verdict, seq % 4 = 0 AS pdf_ready FROM p WHERE seq % 5 = 0")
def scan_drafts(spark, d):
    """All drafts of the view as files, scanned whole into a table."""
    folder, book = _folder(spark, "drafts"), _folder(spark, "book")
    T.write_drafts(_drafted(spark, d), folder)
    T.write_sheet(T.drafts(spark, folder), book, "drafts")
    return T.read_sheet(spark, book, ("drafts",)).select("job_id", "review_verdict", "pdf_ready")


@query(f"{WITH}, k AS (SELECT DISTINCT board, title FROM p) SELECT (row_number() OVER (ORDER BY board, title) - 1)::INT AS ord, title AS query, board AS category FROM k")
def scan_yaml_config(spark, d):
    """Phrases by category, taken from the postings, as a YAML file in the store: read back as the catalogue of queries, in file order."""
    folder = fresh_dir(spark, "config")
    known = postings(spark, d).select("board", "title").distinct().groupBy("board").agg(F.array_sort(F.collect_list("title")).alias("t"))  # a few of each
    lines = known.orderBy("board").select(F.concat(F.lit('"'), "board", F.lit('":'), F.array_join(F.transform("t", lambda t: F.concat(F.lit('\n  - "'), t, F.lit('"'))), "")).alias("v"))
    text = lines.agg(F.array_join(F.array_sort(F.collect_list("v")), "\n").alias("value"))
    text.select(F.concat(F.lit("# phrases\n"), "value")).coalesce(1).write.text(folder)
    return T.query_catalogue(spark, T.yaml_config(spark, folder))


@query(f"""{WITH}, k AS (SELECT board, company || '|' || title || '|' || city_region AS key, availability_status = 'closed' AS gone FROM p)
SELECT board AS source, count(*)::BIGINT AS found, (count(*) FILTER (WHERE gone))::BIGINT AS filtered_out, (count(DISTINCT key) FILTER (WHERE NOT gone))::BIGINT AS uniq,
((count(*) FILTER (WHERE NOT gone)) - count(DISTINCT key) FILTER (WHERE NOT gone))::BIGINT AS duplicates FROM k GROUP BY 1""")
def observed_run(spark, d):
    """Counts of each step of a run, observed while its rows are written."""
    c = F.col
    rows = postings(spark, d).select("seq", c("board").alias("source"), F.concat_ws("|", "company", "title", "city_region").alias("key"), "availability_status", "full_text")
    return C.observed_run(rows, c("availability_status") != "closed", fresh_dir(spark, "run"), R.SOURCE_ORDER)


flag("strip_boilerplate", lambda: without_upsell(F.concat(F.col("title"), F.lit("\nGet AI-powered advice on this job and more. Try Premium for free"))), "title")


def flagship(spark, d):
    return run_stats(spark, d)
