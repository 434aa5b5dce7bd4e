"""Single operators as queries of their own: predicates, keys, parts of reports, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import metadata as M
from ..functions import rules as R
from ..functions.html import clean_text as html_text
from ..functions.text import fold, joined, split_list, strip
from ..operators import groups as G
from ..operators import reports as P
from ..sources import feeds as S
from ..sources import tables as T
from .queries import _GROUPED, _NEAR, _grouped, Query
from .queries import SQL as _SQL
from .source_queries import _folder, _page
from .view import WITH, any_sql, postings, q, sql_list

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _n():
    return F.col("seq")


def flag(name: str, column, sql: str | None, kind: str = "value") -> None:
    """A query seq, value over all postings; column is a function, as columns need a session."""
    QUERIES[name] = lambda spark, d: postings(spark, d).select("seq", column().alias(kind))
    if sql:
        SQL[name] = f"{WITH} SELECT seq, {sql} AS {kind} FROM p"



def _places():
    return F.when(_n() % 3 == 0, "Ukraine or India").when(_n() % 3 == 1, "Countries of Europe or Ukraine").otherwise("")


flag("has_disallowed_work_format", lambda: M.disallowed_format(F.col("work_format"), ("Hybrid",)), "work_format = 'Hybrid'")
flag("onsite_in_disallowed_country", lambda: M.onsite_in_disallowed(F.col("work_format"), F.col("country")), "work_format IN ('Hybrid', 'On-site') AND country = 'Ukraine'")
flag("candidates_only_disallowed", lambda: M.candidates_only_disallowed(_places()), "seq % 3 = 0")
flag("is_low_quality_listing", lambda: M.is_low_quality(F.col("title"), F.col("full_text")), any_sql("lower(title || chr(10) || full_text)", R.LOW_QUALITY))
flag("matches_context", lambda: M.matches_context(F.col("full_text")), any_sql("lower(full_text)", R.CONTEXT_TERMS))
#: Endings of company names by seq % 8: legal forms, brackets, camel case, and names that are nothing but a legal form.
ENDINGS = (" Inc.", " LLC", "Corp", " (EU) Ltd", " Group, S.A.", " 24/7", " & Co", "")


def _companies():
    end = F.element_at(F.array(*[F.lit(x) for x in ENDINGS]), (_n() % len(ENDINGS) + 1).cast("int"))
    return F.when(_n() % 31 == 0, "Limited GmbH").otherwise(F.concat("company", end))


_COMPANY = f"CASE WHEN seq % 31 = 0 THEN 'Limited GmbH' ELSE company || {sql_list(ENDINGS)}[(seq % {len(ENDINGS)} + 1)::INT] END"
_TOKENS = f"regexp_extract_all(lower(regexp_replace(regexp_replace({_COMPANY}, '\\([^)]*\\)', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+')"
_REAL = f"list_filter({_TOKENS}, lambda x: NOT list_contains({sql_list(R.LEGAL_SUFFIXES)}, x))"
flag("normalize_company", lambda: M.normalize_company(_companies()), f"array_to_string(CASE WHEN len({_REAL}) > 0 THEN {_REAL} ELSE {_TOKENS} END, ' ')")
flag("normalize_title", lambda: M.normalize_title(F.col("title")), "CASE seq % 12 WHEN 3 THEN 'product analyst' WHEN 4 THEN 'bi and data analyst' ELSE lower(title) END")
_AREA = "city_region || CASE seq % 3 WHEN 0 THEN ' Área Metropolitana' WHEN 1 THEN ' and more: Worldwide, Łódź' ELSE ' (Zone-7)' END"
flag("location_tokens", lambda: joined(F.array_sort(M.location_tokens(F.concat("city_region", F.when(_n() % 3 == 0, " Área Metropolitana").when(_n() % 3 == 1, " and more: Worldwide, Łódź").otherwise(" (Zone-7)")), F.col("country"))), " "),
     f"array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower({_AREA} || ' ' || country), '\\p{{L}}{{3,}}'), lambda x: NOT list_contains({sql_list(R.REGION_WORDS)}, x)))), ' ')")
flag("level_bucket", lambda: M.level_bucket(F.col("seniority")), "CASE seniority WHEN 'Junior' THEN 'junior' WHEN 'Mid-level' THEN 'middle' WHEN 'Unknown' THEN 'unknown' ELSE 'senior' END")
flag("location_bucket", lambda: M.location_bucket(F.col("work_format"), F.col("country")), "CASE WHEN work_format = 'Remote' THEN 'remote' WHEN country IN ('France', 'Germany', 'Ukraine') THEN 'europe' ELSE 'other' END")
flag("keep_known_closed", lambda: M.keep_known_closed(F.col("availability_status"), F.when(_n() % 2 == 0, "unknown").otherwise("active")), "CASE WHEN seq % 2 = 0 THEN CASE WHEN availability_status = 'closed' THEN 'closed' ELSE 'unknown' END ELSE 'active' END")
flag("company_slug", lambda: M.company_slug(F.concat(F.lit("https://x.example/companies/c"), _n().cast("string"), F.lit("?a=1"))), "'c' || seq")
flag("date_str", lambda: M.date_text(F.when(_n() % 3 == 0, "NaT").when(_n() % 3 == 1, F.concat("date_collected", F.lit(" 00:00:00"))).otherwise(F.col("date_collected"))), "CASE WHEN seq % 3 = 0 THEN '' ELSE date_collected END")
flag("parse_salary_amount", lambda: M.salary_amount(F.element_at(F.array(*[F.lit(x) for x in ("30.000,00", "30,000.5", "1.234", "12,5")]), (_n() % 4 + 1).cast("int"))), "[30000.0, 30000.5, 1234.0, 12.5][(seq % 4 + 1)::INT]::DOUBLE")
flag("posting_keywords", lambda: joined(split_list(F.col("required_skills")), "|"), "replace(required_skills, '; ', '|')")
flag("is_company_age", lambda: F.size(F.filter(M._with_context(fold(F.col("full_text")), M._YEARS_EXP, 30, 40, 2), M._company_age)) > 0, "seq % 10 = 3")
flag("format_salary_struct", lambda: S._salary(F.lit(1000), 1000 + _n() % 2 * 500, F.lit("EUR"), F.lit("Monthly")), "CASE WHEN seq % 2 = 1 THEN '1000-1500 EUR/month' ELSE '1000 EUR/month' END")


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"{WITH} SELECT 'x' || job_id AS ref, CASE WHEN seq % 3 <> 0 THEN seq END AS seq, CASE WHEN seq % 3 <> 0 THEN decision END AS decision FROM p")
def join_apps_records(spark, d):
    """A log row for each posting; a third of the postings are gone from the records."""
    p = postings(spark, d)
    log = p.select("job_id", F.concat(F.lit("x"), "job_id").alias("ref"))
    return P.join_records(log, p.where("seq % 3 <> 0").select("job_id", "seq", "decision")).select("ref", "seq", "decision")


@query(_GROUPED + ", dg AS (SELECT DISTINCT duplicate_group FROM g WHERE duplicate_group <> '' AND applied <> '') SELECT seq FROM g WHERE duplicate_group NOT IN (SELECT duplicate_group FROM dg)")
def handled_group_anti(spark, d):
    return G.without_handled_groups(_grouped(spark, d), F.col("applied") != "").select("seq")


_RANK = f"decision <> {q(R.YES)}, list_position({sql_list(R.SOURCE_ORDER)}, board), job_id"


@query(_GROUPED + f" SELECT seq, duplicate_group FROM g WHERE duplicate_group <> '' QUALIFY row_number() OVER (PARTITION BY duplicate_group ORDER BY {_RANK}) = 1")
def best_of_group(spark, d):
    place = F.array_position(F.array(*[F.lit(s) for s in R.SOURCE_ORDER]), F.col("board"))
    rows = _grouped(spark, d).select("seq", "duplicate_group", "decision", "board", "job_id")
    return G.best_of_group(rows, [F.col("decision") != R.YES, place, F.col("job_id")]).select("seq", "duplicate_group")


@query(_GROUPED + " SELECT a.seq, string_agg(DISTINCT b.board, ', ' ORDER BY b.board) AS also_on FROM g a JOIN g b ON a.duplicate_group = b.duplicate_group AND a.seq <> b.seq WHERE a.duplicate_group <> '' GROUP BY 1")
def also_on(spark, d):
    rows = _grouped(spark, d).select("seq", "duplicate_group", "board")
    return G.also_on(rows, "board").select("seq", "also_on").where("also_on <> ''")


@query(f"{WITH} SELECT seq, title, company FROM p WHERE seq % 2 = 0")
def json_ld_jobposting(spark, d):
    got = _page(spark, d).select("seq", S.json_ld(F.col("html")).alias("j")).where("j IS NOT NULL")
    return got.select("seq", F.col("j.title").alias("title"), F.col("j.hiringOrganization.name").alias("company"))


@query(f"{WITH} SELECT seq, title || chr(10) || 'Body' AS full_text FROM p")
def src_robota_ua(spark, d):
    esc = F.replace("title", F.lit("&"), F.lit("&amp;"))
    pages = postings(spark, d).select("seq", _n().cast("string").alias("url"), F.concat(F.lit("<article><h1>"), esc, F.lit("</h1><p>Body</p><p>Схожі вакансії</p><p>x</p></article>")).alias("html"))
    return S.detail_pages(pages, "Robota.ua", ("Схожі вакансії",), ("seq",)).select("seq", "full_text")


def _drafted(spark, d):
    md = F.concat(F.lit("# T\n"), F.when(_n() % 2 == 0, f"\n---\n\n{T.REVIEW_MARK}\n\n✅ Одобрено").otherwise(""), F.when(_n() % 3 == 0, "\n## ATS\n").otherwise(""))
    return postings(spark, d).where(_n() % 5 == 0).select("seq", "job_id", md.alias("md"), (_n() % 4 == 0).alias("pdf"))


@query(f"{WITH} SELECT seq FROM p WHERE seq % 5 = 0 AND seq % 2 <> 0")
def unreviewed_drafts(spark, d):
    return _drafted(spark, d).where(~T.has_review(F.col("md"))).select("seq")


@query(f"{WITH} SELECT seq FROM p WHERE seq % 5 = 0 AND (seq % 3 <> 0 OR seq % 4 <> 0)")
def pdf_pending(spark, d):
    return _drafted(spark, d).where(~F.col("md").contains("## ATS") | ~F.col("pdf")).select("seq")


@query(f"{WITH} SELECT seq, CASE WHEN seq % 2 = 0 THEN 'approved' ELSE '' END AS verdict, '# T' AS kept FROM p WHERE seq % 5 = 0 AND seq % 3 <> 0")
def verdict(spark, d):
    rows = _drafted(spark, d).where(_n() % 3 != 0)
    return rows.select("seq", T.verdict(F.col("md")).alias("verdict"), strip(T.without_review(F.col("md"))).alias("kept"))


@query(f"{WITH} SELECT seq, 'Ann Smith' || chr(10) || company AS cv FROM p")
def scan_master_cv(spark, d):
    page = F.concat(F.lit("<html><body><h1>Ann Smith</h1><p>"), F.col("company"), F.lit("</p></body></html>"))
    return postings(spark, d).select("seq", html_text(page).alias("cv"))


@query(f"{WITH} SELECT seq::VARCHAR AS seq, job_id, source FROM p")
def sink_csv(spark, d):
    folder = _folder(spark, "csv")
    T.write_csv(postings(spark, d).select(_n().cast("string").alias("seq"), "job_id", "source"), folder)
    return T.read_csv(spark, folder, ["seq", "job_id", "source"])


@query(f"{WITH} SELECT seq, job_id FROM p WHERE {_NEAR}")
def sink_xlsx(spark, d):
    book = _folder(spark, "book")
    T.write_sheet(postings(spark, d).where(M.is_near_fit(F.col("decision"), F.col("should_be_filtered"))).select("seq", "job_id"), book, "jobs_master")
    return T.read_sheet(spark, book)


@query(f"""WITH t AS ({_SQL['cert_terms']}), n AS ({_SQL['cert_guards']})
SELECT '| ' || term || ' | ' || grp || ' | ' || t.postings || ' | ' || round_even(100.0::DOUBLE * t.postings / n.postings, 1)::DOUBLE || ' |' AS line FROM t, n ORDER BY t.postings DESC, term LIMIT 10""")
def sink_markdown(spark, d):
    """The market report's table as lines of text."""
    r = P.cert_report(postings(spark, d)).orderBy(F.desc("postings"), "term").limit(10)
    return r.select(F.concat(F.lit("| "), "term", F.lit(" | "), "grp", F.lit(" | "), F.col("postings").cast("string"), F.lit(" | "), F.col("pct_of_all").cast("string"), F.lit(" |")).alias("line"))
