"""The library's queries over the test tables, each beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import metadata as M
from ..functions import rules as R
from ..functions.text import fold, joined, normalize_text, strip, text
from ..operators import collection as C
from ..operators import dedup as D
from ..operators import groups as G
from ..operators import reports as P
from ..operators import similar as N
from ..operators.terms import phrase_hits
from .view import TODAY, VIEW, WITH, any_sql, fold_sql, has, postings, q, re2, sql_list

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FT = fold_sql("title || chr(10) || full_text")


def T():
    """Folded title and text; a function, as columns need a session."""
    return M.folded_text(F.col("title"), F.col("full_text"))


# --- identity --------------------------------------------------------------------------------------------------------


@query("SELECT page_id, replace(lower(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))), 'ß', 'ss') AS norm FROM pages")
def normalize_text_q(spark, d):
    p = _table(spark, d, "pages")
    return p.select("page_id", normalize_text(F.regexp_replace("html", "<[^>]*>", " ")).alias("norm"))


_URL = """WITH u AS (SELECT page_id, trim(url) AS raw FROM pages),
s AS (SELECT *, lower(regexp_extract(raw, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) AS scheme, lower(regexp_extract(raw, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)) AS host,
 regexp_extract(raw, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(raw, '^[^?#]*\\?([^#]*)', 1) AS query FROM u),
k AS (SELECT *, list_sort(list_filter(list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: [url_decode(replace(string_split(x, '=')[1], '+', ' ')), CASE WHEN contains(x, '=') THEN url_decode(replace(regexp_replace(x, '^[^=]*=', ''), '+', ' ')) ELSE '' END]),
 lambda p: NOT (starts_with(lower(p[1]), 'utm_') OR lower(p[1]) IN ('fbclid', 'gclid', 'li_fat_id', 'lipi', 'refid', 'trk', 'trackingid')))) AS pairs FROM s),
n AS (SELECT *, list_aggregate(list_transform(pairs, lambda p: replace(url_encode(p[1]), '%20', '+') || '=' || replace(url_encode(p[2]), '%20', '+')), 'string_agg', '&') AS rest FROM k)
SELECT page_id, CASE WHEN raw = '' THEN '' WHEN scheme = '' OR host = '' THEN lower(raw) ELSE scheme || '://' || host || CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/+$', '') END || CASE WHEN coalesce(rest, '') <> '' THEN '?' || rest ELSE '' END END AS url FROM n"""


@query(_URL)
def normalize_url(spark, d):
    return _table(spark, d, "pages").select("page_id", I.normalize_url(F.col("url")).alias("url"))


_KEY = "lower(source) || '|url|https://example.com/jobs/' || (seq % 100)::VARCHAR"
_FALL = "lower(source) || '|fallback|' || lower(company) || '|' || lower(title) || '|' || lower(city_region)"


@query(f"{WITH} SELECT seq, {_KEY} AS k, {_FALL} AS fallback, lower(company) || '|' || lower(title) AS ct FROM p")
def dedup_key(spark, d):
    p, c = postings(spark, d), F.col
    return p.select(
        "seq", I.dedup_key(c("source"), c("url"), c("company"), c("title"), c("city_region")).alias("k"),
        I.dedup_key(c("source"), F.lit(""), c("company"), c("title"), c("city_region")).alias("fallback"), I.company_title_key(c("company"), c("title")).alias("ct"),
    )


@query(f"{WITH} SELECT seq, lower(source) || '_' || substr(sha1({_KEY}), 1, 12) AS job_id, regexp_replace(lower(title), '[^a-z0-9_]+', '_', 'g') AS slug0 FROM p")
def job_id(spark, d):
    p, c = postings(spark, d), F.col
    key = I.dedup_key(c("source"), c("url"), c("company"), c("title"), c("city_region"))
    return p.select("seq", I.job_id(c("source"), key).alias("job_id"), F.regexp_replace(F.lower("title"), "[^a-z0-9_]+", "_").alias("slug0"))


@query(f"{WITH} SELECT seq, trim(regexp_replace(lower(title), '[^a-z0-9_]+', '_', 'g'), '_') AS slug FROM p")
def source_slug(spark, d):
    return postings(spark, d).select("seq", I.source_slug(F.col("title")).alias("slug"))


# --- scalar functions ------------------------------------------------------------------------------------------------


@query(f"""{WITH}, t AS (SELECT seq, {fold_sql('full_text')} AS t FROM p) SELECT seq, CASE WHEN {has('t', R.HYBRID)} THEN 'Hybrid' WHEN {has('t', R.REMOTE_FIRST)} AND {has('t', R.IN_PERSON)} THEN 'Hybrid'
WHEN {has('t', R.REMOTE)} THEN 'Remote' WHEN {has('t', R.ONSITE)} THEN 'On-site' ELSE 'Unknown' END AS work_format FROM t""")
def infer_work_format(spark, d):
    return postings(spark, d).select("seq", M.infer_work_format(F.col("full_text")).alias("work_format"))


@query(f"{WITH}, t AS (SELECT seq, {FT} AS t FROM p) SELECT seq, CASE " + " ".join(f"WHEN {any_sql('t', w)} THEN {q(n)}" for n, w in R.ROLES) + " ELSE 'Other' END AS role FROM t")
def classify_role(spark, d):
    return postings(spark, d).select("seq", M.classify_role(T()).alias("role"))


_SKILLS = "list_filter([" + ", ".join(f"CASE WHEN {has('t', p)} THEN {q(n)} END" for n, p in R.SKILLS) + "], lambda x: x IS NOT NULL)"


@query(f"{WITH}, t AS (SELECT seq, {FT} AS t FROM p) SELECT seq, coalesce(array_to_string({_SKILLS}, '; '), '') AS skills FROM t")
def extract_skills(spark, d):
    return postings(spark, d).select("seq", joined(M.skills(T())).alias("skills"))


_SPLIT = f"""{WITH}, t AS (SELECT seq, {FT} AS w, regexp_extract({FT}, {q('(?s)^(.*?)(?:' + R.PREFERRED + ')')}, 1) AS head, {has(FT, R.PREFERRED)} AS cut FROM p),
h AS (SELECT seq, w, CASE WHEN cut THEN head ELSE w END AS head, CASE WHEN cut THEN substr(w, length(head) + 1) ELSE '' END AS tail FROM t),
r AS (SELECT seq, {_SKILLS.replace("regexp_matches(t,", "regexp_matches(w,")} AS every, {_SKILLS.replace("regexp_matches(t,", "regexp_matches(head,")} AS head, {_SKILLS.replace("regexp_matches(t,", "regexp_matches(tail,")} AS tail FROM h)
SELECT seq, coalesce(array_to_string(list_filter(every, lambda x: list_contains(head, x)), '; '), '') AS required, coalesce(array_to_string(list_filter(every, lambda x: list_contains(tail, x) AND NOT list_contains(head, x)), '; '), '') AS preferred FROM r"""


@query(_SPLIT)
def required_preferred(spark, d):
    s = postings(spark, d).select("seq", M.required_preferred(T()).alias("s"))
    return s.select("seq", joined(F.col("s.required")).alias("required"), joined(F.col("s.preferred")).alias("preferred"))


#: Sentences of years by seq % 7, {n} being seq % 37 and {m} two more: demands, ages of companies, numbers beyond what is plausible.
YEARS = ("{n}+ years of experience with SQL.", "{n}-{m} years of experience", "We have been on the market for over {n} years.", "over {n} years of experience", "A {n} years old codebase", "no numbers here", "{n} to {m} years of track record; {n} years ago we began")


def _years(spark, d):
    n = F.col("seq")
    said = F.element_at(F.array(*[F.lit(x) for x in YEARS]), (n % len(YEARS) + 1).cast("int"))
    filled = F.replace(F.replace(said, F.lit("{n}"), (n % 37).cast("string")), F.lit("{m}"), (n % 37 + 2).cast("string"))
    return postings(spark, d).select("seq", fold(F.concat("company", F.lit("\n"), filled, F.lit("\n"), "city_region")).alias("t"))


_N = f"SELECT seq, seq % {len(YEARS)} AS k, seq % 37 AS n, seq % 37 + 2 AS m FROM p"


@query(f"""{WITH}, y AS ({_N}) SELECT seq, CASE WHEN k IN (0, 3, 4) AND n <= 30 OR k IN (1, 6) AND m <= 30 THEN n::VARCHAR ELSE '' END AS low,
CASE WHEN k IN (0, 3, 4) AND n <= 30 THEN n::VARCHAR WHEN k IN (1, 6) AND m <= 30 THEN m::VARCHAR ELSE '' END AS high FROM y""")
def infer_experience_years(spark, d):
    """The first demand that is plausible and no company's age, as a range."""
    s = _years(spark, d).select("seq", M.experience_years(F.col("t")).alias("s"))
    return s.select("seq", "s.low", "s.high")


@query(f"{WITH}, y AS ({_N}) SELECT seq, CASE WHEN k IN (0, 1, 3, 6) AND n <= 30 THEN n ELSE 0 END::DOUBLE AS years FROM y")
def max_years_mentioned(spark, d):
    """The highest floor that stands near a word of experience."""
    return _years(spark, d).select("seq", M.max_years(F.col("t")).alias("years"))


_LEVEL = "CASE " + " ".join(f"WHEN {has('lower(title)', p)} THEN {q(n)}" for n, p in R.TITLE_LEVELS) + f" WHEN {has('b', R.TEXT_JUNIOR)} THEN 'Junior' WHEN {has('b', R.TEXT_SENIOR)} OR seq % 10 = 1 THEN 'Senior' WHEN {has('b', R.TEXT_MIDDLE)} THEN 'Mid-level' ELSE 'Unknown' END"


@query(f"{WITH}, t AS (SELECT seq, title, {fold_sql('full_text')} AS b FROM p) SELECT seq, {_LEVEL} AS level FROM t")
def classify_seniority(spark, d):
    return postings(spark, d).select("seq", M.classify_seniority(F.col("title"), F.col("full_text"), M.experience_years(T())["low"]).alias("level"))


_PAY = [re2(p).replace(r"(?<!\d)", "") for p in M.SALARY_PATTERNS]


@query(f"{WITH}, t AS (SELECT seq, regexp_extract(full_text, {q('(?i)(?:^|[^0-9])(' + _PAY[0] + ')')}, 1) AS a, regexp_extract(full_text, {q('(?i)' + _PAY[1])}, 0) AS b FROM p) SELECT seq, trim(regexp_replace(CASE WHEN a <> '' THEN a ELSE b END, '\\s+', ' ', 'g')) AS salary FROM t")
def extract_salary(spark, d):
    return postings(spark, d).select("seq", M.extract_salary(F.lit(""), F.col("full_text")).alias("salary"))


#: Pay as texts: (pattern with {a} and {b}, rate to the dollar or 0).
PAY = (("€{a} - €{b}", 1.08), ("{a}-{b} GBP per year", 1.27), ("{a} грн", 0.024), ("from ${a}", 0), ("{b} UAH", 0.024), ("competitive", 0), ("up to £{a}", 1.27), ("{a} PLN", 0))
_AMOUNTS = "SELECT seq, (seq * 7919) % 90000 + 7 AS a, (seq * 7919) % 90000 + 7 + seq % 5 * 811 AS b, seq % 8 AS k FROM p"


@query(f"""{WITH}, t AS ({_AMOUNTS}), r AS (SELECT *, {[r for _, r in PAY]}[(k + 1)::INT]::DOUBLE AS rate, CASE WHEN k = 4 THEN b ELSE a END AS lo, CASE WHEN k IN (0, 1, 4) THEN b ELSE a END AS hi FROM t),
u AS (SELECT *, lo * rate AS l, hi * rate AS h, CASE WHEN lo * rate >= 1000 THEN 100.0 WHEN lo * rate >= 100 THEN 10.0 ELSE 1.0 END::DOUBLE AS step FROM r),
v AS (SELECT *, (round_even(l / step, 0) * step)::BIGINT AS x, (round_even(h / step, 0) * step)::BIGINT AS y FROM u)
SELECT seq, CASE WHEN rate = 0 THEN '' WHEN x = y THEN '≈' || format('{{:,}}', x) || ' USD' ELSE '≈' || format('{{:,}}', x) || '-' || format('{{:,}}', y) || ' USD' END AS usd FROM v""")
def normalize_salary_usd(spark, d):
    n = F.col("seq")
    a = (n * 7919) % 90000 + 7
    shown = F.element_at(F.array(*[F.lit(x) for x, _ in PAY]), (n % len(PAY) + 1).cast("int"))
    amount = lambda c: F.when(n % 3 == 0, F.format_number(c, 0)).when(n % 3 == 1, F.replace(F.format_number(c, 0), F.lit(","), F.lit("\u00a0"))).otherwise(c.cast("string"))
    pay = F.replace(F.replace(shown, F.lit("{a}"), amount(a)), F.lit("{b}"), amount(a + n % 5 * 811))
    return postings(spark, d).select("seq", M.salary_usd(pay).alias("usd"))


@query(f"{WITH} SELECT seq, CASE WHEN seq % 3 = 0 THEN (seq % 50)::VARCHAR || '-' || (seq % 50 + 5)::VARCHAR || ' USD/year' WHEN seq % 3 = 1 THEN (seq % 50)::VARCHAR || ' USD' ELSE '' END AS salary FROM p")
def salary_structured(spark, d):
    s = F.col("seq")
    low = F.when(s % 3 < 2, (s % 50).cast("string")).otherwise("")
    high = F.when(s % 3 == 0, (s % 50 + 5).cast("string")).otherwise("")
    return postings(spark, d).select("seq", M.salary_structured(low, high, F.lit("USD"), F.when(s % 3 == 0, "YEAR").otherwise("")).alias("salary"))


@query(f"""{WITH}, t AS (SELECT seq, country, city_region || CASE seq % 4 WHEN 0 THEN ' ,  ' || upper(country) WHEN 1 THEN ', Zone ' || (seq % 13)::VARCHAR || ',' || country WHEN 2 THEN ', ,Zone ' || (seq % 11)::VARCHAR ELSE '' END AS place FROM p),
k AS (SELECT seq, country, list_filter(list_transform(string_split(place, ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM t),
c AS (SELECT seq, CASE WHEN country <> '' AND len(parts) > 0 AND lower(parts[-1]) = lower(country) THEN parts[1:len(parts) - 1] ELSE parts END AS kept FROM k)
SELECT seq, coalesce(kept[1], '') AS city, coalesce(array_to_string(kept[2:], ', '), '') AS region FROM c""")
def split_city_region(spark, d):
    n, c = F.col("seq"), F.col
    more = F.when(n % 4 == 0, F.concat(F.lit(" ,  "), F.upper("country"))).when(n % 4 == 1, F.concat(F.lit(", Zone "), (n % 13).cast("string"), F.lit(","), "country")).when(n % 4 == 2, F.concat(F.lit(", ,Zone "), (n % 11).cast("string"))).otherwise("")
    s = postings(spark, d).select("seq", M.split_city_region(F.concat("city_region", more), c("country")).alias("s"))
    return s.select("seq", "s.city", "s.region")


@query(f"{WITH} SELECT seq, CASE WHEN len(m) > 0 THEN array_to_string(m, ' / ') WHEN {has('city_region', '(?i)' + chr(92) + 'bParis' + chr(92) + 'b')} THEN 'France' ELSE '' END AS country FROM (SELECT seq, city_region, list_filter([" + ", ".join(f"CASE WHEN {has('city_region', '(?i)' + chr(92) + 'b' + k + chr(92) + 'b')} THEN {q(k)} END" for k in R.COUNTRIES) + "], lambda x: x IS NOT NULL) AS m FROM p)")
def infer_country(spark, d):
    return postings(spark, d).select("seq", M.infer_country(F.col("city_region")).alias("country"))


@query(f"{WITH} SELECT seq, CASE WHEN seq % 2 = 0 THEN city_region ELSE '' END AS place FROM p")
def location_from_text(spark, d):
    body = F.concat(F.col("company"), F.when(F.col("seq") % 2 == 0, F.concat(F.lit("\n* Location:  "), F.col("city_region"), F.lit("\n"))).otherwise(F.lit("\nno location here: x\n")))
    return postings(spark, d).select("seq", M.location_from_text(body).alias("place"))


@query(f"{WITH} SELECT seq, coalesce(array_to_string(list_filter([city_region, country], lambda x: x <> ''), ' / '), '') AS place FROM p")
def location_join(spark, d):
    return postings(spark, d).select("seq", M.location_join(F.col("city_region"), F.col("country"), F.col("city_region")).alias("place"))


@query(f"{WITH} SELECT seq, CASE (seq // 2) % 6 WHEN 0 THEN '2026-09-19' WHEN 1 THEN '2026-10-02' WHEN 2 THEN '2026-10-03' ELSE '' END AS day FROM p")
def parse_date(spark, d):
    return postings(spark, d).select("seq", F.coalesce(F.date_format(M.parse_date(F.col("date_published")), "yyyy-MM-dd"), F.lit("")).alias("day"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Reposted ' || strftime(ts - to_days((event_id % 9)::INT), '%Y-%m-%d') WHEN 1 THEN strftime(ts - to_hours(((event_id % 40))::BIGINT), '%Y-%m-%d') ELSE 'yesterday' END AS day FROM events")
def resolve_relative_date(spark, d):
    e, n = _table(spark, d, "events"), F.col("event_id")
    said = F.when(n % 3 == 0, F.concat(F.lit("Reposted "), (n % 9).cast("string"), F.lit(" days ago"))).when(n % 3 == 1, F.concat((n % 40).cast("string"), F.lit(" hours ago"))).otherwise("yesterday")
    return e.select("event_id", M.relative_date(said, F.col("ts")).alias("day"))


@query(f"{WITH} SELECT seq, CASE seq % 4 WHEN 0 THEN '2026-10-05' WHEN 1 THEN '2026-09-30' ELSE '{TODAY}' END AS day FROM p")
def mark_date(spark, d):
    n = F.col("seq")
    return postings(spark, d).select("seq", M.mark_date(F.when(n % 4 == 0, "05.10.2026").when(n % 4 == 1, "2026-09-30 00:00:00").when(n % 4 == 2, "31.02.2026").otherwise(R.MARK), F.lit(TODAY)).alias("day"))


@query(f"{WITH} SELECT seq, CASE WHEN (seq // 2) % 6 = 0 THEN date_diff('day', date_collected::DATE, DATE '2026-09-19')::VARCHAR ELSE '' END AS days FROM p")
def timing(spark, d):
    p = postings(spark, d)
    day = F.when((F.floor(F.col("seq") / 2)) % 6 == 0, M.parse_date(F.col("date_published")))
    return p.select("seq", M.days_between(day, M.parse_date(F.col("date_collected"))).alias("days"))


@query(f"{WITH} SELECT seq, CASE seniority WHEN 'Junior' THEN 'junior' WHEN 'Mid-level' THEN 'middle' WHEN 'Unknown' THEN 'unknown' ELSE 'senior' END AS level, CASE WHEN work_format = 'Remote' THEN 'remote' WHEN lower(country) IN ('france', 'germany', 'ukraine') THEN 'europe' ELSE 'other' END AS place FROM p")
def level_location_buckets(spark, d):
    return postings(spark, d).select("seq", M.level_bucket(F.col("seniority")).alias("level"), M.location_bucket(F.col("work_format"), F.col("country")).alias("place"))


@query(f"{WITH} SELECT seq, CASE WHEN decision = '' THEN '' WHEN decision = {q(R.YES)} OR main_reason = '' THEN decision ELSE decision || ' — ' || main_reason END AS fit FROM p")
def personal_fit(spark, d):
    return postings(spark, d).select("seq", M.personal_fit(F.col("decision"), F.col("main_reason")).alias("fit"))


@query(f"{WITH} SELECT seq, title, company FROM p")
def parse_title_tag(spark, d):
    s = postings(spark, d).select("seq", M.title_tag(F.concat_ws(" | ", "title", "company", F.lit("LinkedIn"))).alias("s"))
    return s.select("seq", "s.title", "s.company")


@query(f"{WITH} SELECT seq, title || ' at' AS kept FROM p")
def truncate_contamination(spark, d):
    s = F.concat(F.col("title"), F.lit(" at\nSimilar jobs: "), F.col("company"), F.lit(" See also: x"))
    return postings(spark, d).select("seq", M.cut_at(s, ("See also:", "Similar jobs")).alias("kept"))


@query(f"{WITH} SELECT seq, least(100, seq % 150)::VARCHAR AS fit_score, title AS fit_reasoning, CASE WHEN seq % 2 = 0 THEN 'ok' ELSE 'needs_revision' END AS verdict FROM p")
def llm_json_parse(spark, d):
    n = F.col("seq")
    body = F.to_json(F.struct((n % 150).cast("double").alias("fit_score"), F.col("title").alias("reasoning"), F.when(n % 2 == 0, "ok").alias("verdict")))
    s = postings(spark, d).select("seq", M.llm_answer(F.concat(F.lit("```json\n"), body, F.lit("\n```"))).alias("s"))
    return s.select("seq", "s.*")


@query(f"{WITH} SELECT seq, coalesce(array_to_string(list_filter(list_filter(string_split(required_skills, '; '), lambda x: x <> ''), lambda x: contains(lower(full_text), lower(x))), '; '), '') AS matched, coalesce(array_to_string(list_filter(list_filter(string_split(required_skills, '; '), lambda x: x <> ''), lambda x: NOT contains(lower(full_text), lower(x))), '; '), '') AS missing FROM p")
def ats_check(spark, d):
    parts, t = F.filter(F.split("required_skills", "; "), lambda x: x != ""), F.lower("full_text")
    return postings(spark, d).select("seq", joined(F.filter(parts, lambda x: t.contains(F.lower(x)))).alias("matched"), joined(F.filter(parts, lambda x: ~t.contains(F.lower(x)))).alias("missing"))


# --- filters ---------------------------------------------------------------------------------------------------------


def _match_sql(phrase: str) -> str:
    import re

    s = phrase.lower()
    words = " AND ".join(has("lower(title)", rf"\b{w}\b") for w in re.findall("[a-z0-9]+", s))
    return f"(contains(lower(title), {q(s)}) OR ({words}))"


@query(f"{WITH} SELECT seq, CASE " + " ".join(f"WHEN {_match_sql(x)} THEN {q(x)}" for c in R.QUERIES.values() for x in c) + " END AS query FROM p WHERE query IS NOT NULL")
def first_matching_query(spark, d):
    s = postings(spark, d).select("seq", M.first_matching_query(F.col("title")).alias("m")).where("m IS NOT NULL")
    return s.select("seq", "m.query")


@query(f"{WITH} SELECT seq, {_match_sql('Data Analyst')} AS data, {_match_sql('Analyst Risk')} AS words FROM p")
def query_matches(spark, d):
    return postings(spark, d).select("seq", M.query_matches("Data Analyst", F.col("title")).alias("data"), M.query_matches("Analyst Risk", F.col("title")).alias("words"))


@query(f"{WITH} SELECT seq, CASE WHEN {_match_sql('Data Analyst')} THEN 'Data Analyst' ELSE 'data' END AS label FROM p")
def label_or_default_query(spark, d):
    found = M.first_matching_query(F.col("title"), {"data": ("Data Analyst",)})
    return postings(spark, d).select("seq", F.coalesce(found["query"], F.lit("data")).alias("label"))


@query(f"{WITH} SELECT seq, ({' OR '.join(has('lower(title)', chr(92) + 'b' + m + chr(92) + 'b') for m in ('senior', 'lead', 'head of', 'director', 'principal', 'staff', 'manager'))}) OR {any_sql('lower(full_text)', R.TEXT_MARKERS)} OR seq % 10 = 1 AS over FROM p")
def is_overqualified(spark, d):
    return postings(spark, d).select("seq", M.is_overqualified(F.col("title"), F.col("full_text")).alias("over"))


def _lang_sql(phrases, words) -> str:
    b = chr(92) + "b"
    said = " OR ".join(has("t", b + p.replace("ß", "ss") + b) for p in phrases)
    hits = " + ".join(f"({has('t', b + w + b)})::INT" for w in words)
    return f"{WITH}, t AS (SELECT seq, {FT} AS t FROM p) SELECT seq, ({said}) OR ({hits}) >= 3 AS needed FROM t"


@query(_lang_sql(R.FRENCH_PHRASES, R.FRENCH_WORDS))
def requires_french(spark, d):
    return postings(spark, d).select("seq", M.requires_french(F.col("title"), F.col("full_text")).alias("needed"))


@query(_lang_sql(R.GERMAN_PHRASES, R.GERMAN_WORDS))
def requires_german(spark, d):
    return postings(spark, d).select("seq", M.requires_german(F.col("title"), F.col("full_text")).alias("needed"))


@query(f"{WITH} SELECT seq, work_format = 'Hybrid' AS hybrid, work_format IN ('Hybrid', 'On-site') AND country = 'Ukraine' AS onsite, seq % 3 = 0 AS only_there, {any_sql('lower(title || chr(10) || full_text)', R.LOW_QUALITY)} AS low, {any_sql('lower(full_text)', R.CONTEXT_TERMS)} AS context FROM p")
def posting_predicates(spark, d):
    c, n = F.col, F.col("seq")
    places = F.when(n % 3 == 0, "Ukraine or India").when(n % 3 == 1, "Countries of Europe or Ukraine").otherwise("")
    return postings(spark, d).select(
        "seq", M.disallowed_format(c("work_format"), ("Hybrid",)).alias("hybrid"), M.onsite_in_disallowed(c("work_format"), c("country")).alias("onsite"), M.candidates_only_disallowed(places).alias("only_there"),
        M.is_low_quality(c("title"), c("full_text")).alias("low"), M.matches_context(c("full_text")).alias("context"),
    )


_NEAR = f"decision IN ({q(R.YES)}, {q(R.MAYBE)}) AND should_be_filtered <> {q(R.MARK)}"
_REJ = f"(decision = {q(R.NO)} OR should_be_filtered = {q(R.MARK)})"


@query(f"{WITH} SELECT seq, decision FROM p WHERE {_NEAR}")
def near_fit(spark, d):
    return postings(spark, d).where(M.is_near_fit(F.col("decision"), F.col("should_be_filtered"))).select("seq", "decision")


@query(f"{WITH} SELECT seq, decision FROM p WHERE {_REJ}")
def rejected(spark, d):
    return postings(spark, d).where(M.is_rejected(F.col("decision"), F.col("should_be_filtered"))).select("seq", "decision")


@query(f"{WITH} SELECT seq FROM p WHERE source = 'src7' ORDER BY seq LIMIT 20")
def select_records_to_check(spark, d):
    return postings(spark, d).where("source = 'src7'").orderBy("seq").limit(20).select("seq")


# --- limits, unions --------------------------------------------------------------------------------------------------


@query(f"{WITH} SELECT seq, source FROM p QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq) <= 10")
def per_board_limit(spark, d):
    return D.cap_per_key(postings(spark, d).select("seq", "source"), ["source"], [F.col("seq")], 10)


@query(f"{WITH} SELECT seq FROM p ORDER BY seq LIMIT 50")
def source_limit(spark, d):
    return postings(spark, d).orderBy("seq").limit(50).select("seq")


@query(f"{WITH}, k AS (SELECT seq, title FROM p QUALIFY row_number() OVER (PARTITION BY title ORDER BY seq) <= 4) SELECT seq, title FROM k ORDER BY seq LIMIT 40")
def per_query_share(spark, d):
    share = D.per_query_share(50, 12)
    return D.cap_per_key(postings(spark, d).select("seq", "title"), ["title"], [F.col("seq")], share).orderBy("seq").limit(40)


@query(f"{WITH} SELECT seq, board, row_number() OVER (PARTITION BY board ORDER BY seq) <= 40 AS early FROM p")
def union_collect(spark, d):
    """What all sources of a run gave, each with its own columns, as one relation."""
    p = postings(spark, d).select("seq", "board")
    parts = {b: p.where(F.col("board") == b) for b in R.SOURCE_ORDER}
    early = D.cap_per_key(p, ["board"], [F.col("seq")], 40).select(F.col("seq").alias("_s"))
    return C.union_sources(parts).join(early, F.col("seq") == F.col("_s"), "left").select("seq", "board", F.col("_s").isNotNull().alias("early"))


# --- dedup -----------------------------------------------------------------------------------------------------------


@query(f"{WITH} SELECT seq, title, company FROM p QUALIFY row_number() OVER (PARTITION BY lower(company), lower(title) ORDER BY seq) = 1")
def dedup_company_title(spark, d):
    return P.market(postings(spark, d).select("seq", "title", "company"))


@query("SELECT min(page_id) AS page_id, url FROM pages WHERE trim(url) <> '' GROUP BY url")
def seen_url_dedup(spark, d):
    p = _table(spark, d, "pages").select("page_id", "url").where(strip(F.col("url")) != "")
    return D.first_per_key(p, [F.col("url")], [F.col("page_id")])


@query(f"{WITH} SELECT min(seq) AS seq, city_region FROM p WHERE city_region <> '' GROUP BY city_region")
def dedup_by_first_column(spark, d):
    return D.first_per_key(postings(spark, d).select("seq", "city_region").where("city_region <> ''"), [F.col("city_region")], [F.col("seq")])


@query(f"{WITH} SELECT seq, {sql_list(('northwind labs', 'northwind labs', 'northwind labs', 'contoso gmb h', 'contoso', 'fabrikam', 'tailspin', 'fabrikam', 'wingtip toys'))}[((seq // 3) % 9 + 1)::INT] AS company, CASE seq % 12 WHEN 3 THEN 'product analyst' WHEN 4 THEN 'bi and data analyst' ELSE lower(title) END AS title, {sql_list(('france ile paris', '', 'berlin germany', '', '', 'kyiv ukraine', 'usa'))}[(seq % 7 + 1)::INT] AS places FROM p")
def grouping_keys(spark, d):
    c = F.col
    return postings(spark, d).select("seq", M.normalize_company(c("company")).alias("company"), M.normalize_title(c("title")).alias("title"), joined(M.location_tokens(c("city_region"), c("country")), " ").alias("places"))


@query(f"{WITH}, t AS (SELECT DISTINCT country, city_region FROM p), k AS (SELECT city_region, {sql_list(())[:0]}CASE city_region WHEN 'Paris, Ile-de-France, France' THEN 'france' WHEN 'Berlin, Germany' THEN 'germany' WHEN 'Kyiv, Ukraine' THEN 'ukraine' WHEN 'Remote - USA' THEN 'usa' ELSE '' END AS place, city_region = '' AND country = '' AS blank FROM t) SELECT a.city_region AS a, b.city_region AS b, NOT ((a.blank AND b.place <> '') OR (b.blank AND a.place <> '')) AND (a.place = '' OR b.place = '' OR a.place = b.place) AS compatible FROM k a JOIN k b ON a.city_region < b.city_region")
def locations_compatible(spark, d):
    """Every pair of places, and whether one posting may have both."""
    c = F.col
    t = postings(spark, d).select("country", "city_region").distinct().select("city_region", M.location_tokens(c("city_region"), c("country")).alias("t"), ((c("city_region") == "") & (c("country") == "")).alias("blank"))
    a, b = t.select(c("city_region").alias("a"), c("t").alias("at"), c("blank").alias("ab")), t.select(c("city_region").alias("b"), c("t").alias("bt"), c("blank").alias("bb"))
    # a row for each pair by definition; no broadcast is forced, so that very many places are dealt out in blocks
    return a.join(b, c("a") < c("b")).select("a", "b", M.locations_compatible(c("at"), c("bt"), c("ab"), c("bb")).alias("compatible"))


def _openings(spark, d):
    """Postings whose titles are the first words of their texts, which copies share or nearly share."""
    words = F.regexp_extract_all(F.col("full_text"), F.lit(r"(\S+)"), F.lit(1))
    return postings(spark, d).withColumn("title", F.array_join(F.slice(words, 1, 10), " "))


@query()
def fuzzy_same_posting(spark, d):
    """Profiles of the postings that are the same job, by their smallest job_id, later and earlier."""
    return N.same_postings(_openings(spark, d))


@query()
def duplicate_groups(spark, d):
    return G.duplicate_groups(postings(spark, d))


_GROUPED = f"{WITH}, g AS (SELECT *, CASE WHEN seq % 4 = 0 THEN '' ELSE 'g' || (seq // 8)::VARCHAR END AS duplicate_group FROM p)"


def _grouped(spark, d):
    n = F.col("seq")
    return postings(spark, d).withColumn("duplicate_group", F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("g"), F.floor(n / 8).cast("string"))))


@query(_GROUPED + """, a AS (SELECT duplicate_group AS g, min(decision) AS lo, max(decision) AS hi, arg_min(main_reason, job_id) AS r, arg_min(source, job_id) AS s, min(job_id) AS j FROM g WHERE duplicate_group <> '' AND decision <> '' GROUP BY 1)
SELECT seq, CASE WHEN g.decision = '' AND a.lo = a.hi THEN a.lo ELSE g.decision END AS decision, CASE WHEN g.decision = '' AND a.lo = a.hi THEN a.r ELSE g.main_reason END AS main_reason,
CASE WHEN g.decision = '' AND a.lo = a.hi THEN 'Оценка перенесена с копии ' || a.s || ' (' || a.j || '): та же вакансия под другой ссылкой.' ELSE '' END AS review_notes FROM g LEFT JOIN a ON g.duplicate_group = a.g""")
def inherit_group_decisions(spark, d):
    return D.inherit_decisions(_grouped(spark, d), ["decision", "main_reason"]).select("seq", "decision", "main_reason", "review_notes")


@query(_GROUPED + " SELECT count(DISTINCT duplicate_group)::BIGINT AS n_groups, count(*)::BIGINT AS n_rows FROM g WHERE duplicate_group <> ''")
def group_stats(spark, d):
    return G.group_stats(_grouped(spark, d))


# --- upsert ----------------------------------------------------------------------------------------------------------


def _sides(spark, d):
    n = F.col("seq")
    base = postings(spark, d).select("seq", F.col("job_id").alias("key"), "job_id", "title", "company", "full_text", "date_collected", "date_published", "availability_status", F.lit("kept").alias("status"))
    old = base.where("seq % 5 <> 0").withColumn("role_family", F.lit("Risk"))
    new = base.where("seq % 3 = 0").withColumn("title", F.when(n % 6 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title"))).withColumn("availability_status", F.lit("active")).withColumn("date_collected", F.lit("2026-03-01")).withColumn("role_family", F.lit(""))
    return old, new


@query(f"""{WITH} SELECT job_id AS key, CASE WHEN seq % 3 = 0 AND seq % 6 = 0 THEN title || '!' ELSE title END AS title,
CASE WHEN seq % 5 = 0 THEN 'new' WHEN seq % 3 <> 0 THEN 'kept' WHEN seq % 6 = 0 OR availability_status = 'unknown' THEN 'updated' ELSE 'existing' END AS status,
CASE WHEN seq % 3 <> 0 THEN availability_status WHEN seq % 5 <> 0 AND availability_status = 'closed' THEN 'closed' ELSE 'active' END AS availability_status,
CASE WHEN seq % 3 <> 0 THEN date_collected WHEN seq % 5 = 0 THEN '2026-03-01' ELSE least(date_collected, '2026-03-01') END AS date_collected,
CASE WHEN seq % 5 = 0 THEN '' ELSE 'Risk' END AS role_family FROM p WHERE seq % 5 <> 0 OR seq % 3 = 0""")
def merge_records(spark, d):
    old, new = _sides(spark, d)
    return D.merge(old, new).select("key", "title", "status", "availability_status", "date_collected", "role_family")


@query(f"{WITH} SELECT CASE WHEN seq % 5 = 0 THEN 'new' WHEN seq % 3 <> 0 THEN 'kept' WHEN seq % 6 = 0 OR availability_status = 'unknown' THEN 'updated' ELSE 'existing' END AS status, count(*)::BIGINT AS n FROM p WHERE seq % 5 <> 0 OR seq % 3 = 0 GROUP BY 1")
def merge_counts(spark, d):
    return D.merge(*_sides(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# --- aggregates and reports ------------------------------------------------------------------------------------------


_UNNEST = f"{WITH}, s AS (SELECT seq, title, unnest(list_distinct(list_filter(string_split(required_skills || '; ' || preferred_skills, '; '), lambda x: x NOT IN ('', 'Crypto', 'Blockchain')))) AS skill FROM p WHERE {_NEAR})"
_STATUS = f"CASE WHEN skill IN ({', '.join(q(s) for s in R.KNOWN_SKILLS)}) THEN 'known' ELSE 'gap' END"


@query(f"{_UNNEST} SELECT skill, count(*)::BIGINT AS demand, {_STATUS} AS status FROM s GROUP BY skill")
def skill_demand(spark, d):
    return P.skill_demand(postings(spark, d))


@query(f"{_UNNEST}, t AS (SELECT skill, title, min(seq) AS seq FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY seq) AS rn FROM t) SELECT skill, string_agg(title, ' | ' ORDER BY rn) AS examples FROM r WHERE rn <= 3 GROUP BY skill")
def skill_examples(spark, d):
    return P.skill_examples(postings(spark, d))


_BUCKETS = "list_filter([" + ", ".join(f"CASE WHEN {any_sql('lower(main_reason)', w)} THEN {q(n)} END" for n, w in R.REASONS.items()) + "], lambda x: x IS NOT NULL)"
_HITS = f"{WITH}, h AS (SELECT seq, main_reason, unnest({_BUCKETS}) AS bucket FROM p WHERE {_REJ}), n AS (SELECT count(*) AS total FROM p WHERE {_REJ})"


@query(f"""{_HITS}, c AS (SELECT bucket, count(*) AS postings FROM h GROUP BY 1), e AS (SELECT bucket, main_reason, min(seq) AS seq FROM h WHERE main_reason <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY seq) AS rn FROM e),
x AS (SELECT bucket, string_agg(main_reason, ' | ' ORDER BY rn) AS examples FROM r WHERE rn <= 3 GROUP BY 1)
SELECT bucket, postings::BIGINT AS postings, total::BIGINT AS total_rejected, round_even(100.0::DOUBLE * postings / greatest(total, 1), 1)::DOUBLE AS share_pct, bucket IN ({', '.join(q(s) for s in R.STRUCTURAL)}) AS structural, coalesce(examples, '') AS examples FROM c LEFT JOIN x USING (bucket), n""")
def rejection_buckets(spark, d):
    return P.rejection_buckets(postings(spark, d))


@query(f"{_HITS} SELECT bucket, count(*)::BIGINT AS postings FROM h WHERE bucket NOT IN ({', '.join(q(s) for s in R.STRUCTURAL)}) GROUP BY 1")
def learnable_split(spark, d):
    return P.rejection_buckets(postings(spark, d)).where("NOT structural").select("bucket", "postings")


_MARKET = f"{WITH}, m AS (SELECT *, {FT} AS t FROM p QUALIFY row_number() OVER (PARTITION BY lower(company), lower(title) ORDER BY seq) = 1)"
_ROWS = ", ".join(f"({q(n)}, {q('m' + str(i))})" for i, (n, _) in enumerate(R.SKILLS))
_DEMAND = f"{_MARKET}, dm AS (" + " UNION ALL ".join(f"SELECT {q(n)} AS skill, (count(*) FILTER (WHERE {has('t', p)}))::BIGINT AS market, (count(*) FILTER (WHERE {has('t', M.cert_near(p))}))::BIGINT AS certs, count(*)::BIGINT AS market_total FROM m" for n, p in R.SKILLS) + ")"


@query(f"{_DEMAND} SELECT * FROM dm")
def market_demand(spark, d):
    return P.market_demand(postings(spark, d))


_PHRASES = [(c, p) for c, ps in R.QUERIES.items() for p in ps]


@query(f"""{WITH}, t AS (SELECT seq, ' ' || array_to_string(regexp_extract_all({FT}, '[\\p{{L}}\\p{{N}}_]+'), ' ') || ' ' AS t FROM p),
k AS (SELECT unnest([{', '.join(f"{{'category': {q(c)}, 'phrase': {q(p.lower().replace('-', ' '))}}}" for c, p in _PHRASES)}], recursive := true))
SELECT category, count(DISTINCT seq)::BIGINT AS postings FROM t JOIN k ON contains(t, ' ' || phrase || ' ') GROUP BY 1""")
def phrase_demand(spark, d):
    """Postings that name a search phrase of each category: one join with the dictionary of phrases."""
    known = spark.createDataFrame([(c, p.lower()) for c, p in _PHRASES], "term string, phrase string")
    hits = phrase_hits(postings(spark, d).select("seq", T().alias("t")), "seq", known)
    return hits.groupBy(F.col("term").alias("category")).agg(F.count(F.lit(1)).alias("postings"))


@query(f"{_DEMAND} SELECT skill, certs FROM dm WHERE certs > 0")
def cert_mentions(spark, d):
    return P.market_demand(postings(spark, d)).where("certs > 0").select("skill", "certs")


@query(f"""{_DEMAND}, s AS (SELECT seq, unnest(list_distinct(list_filter(string_split(required_skills || '; ' || preferred_skills, '; '), lambda x: x NOT IN ('', 'Crypto', 'Blockchain')))) AS skill FROM p WHERE {_NEAR}),
n AS (SELECT skill, count(*)::BIGINT AS near_fit FROM s WHERE {_STATUS} = 'gap' GROUP BY 1),
j AS (SELECT n.skill, near_fit, coalesce(market, 0)::BIGINT AS market, coalesce(market / nullif(market_total, 0), 0)::DOUBLE AS share, coalesce(certs, 0)::BIGINT AS certs FROM n LEFT JOIN dm USING (skill))
SELECT skill, near_fit, market, share, certs, CASE WHEN near_fit < 2 THEN 'low priority' WHEN share >= 0.1 THEN CASE WHEN skill IN ('R', 'Machine Learning') THEN 'verify first' ELSE 'learn' END WHEN share >= 0.03 THEN 'optional' ELSE 'low priority' END AS action,
CASE WHEN certs >= 3 THEN 'certificate mentioned in ' || certs || ' postings: worth considering' WHEN certs > 0 THEN 'certificate mentioned in ' || certs || ' posting(s): not a market signal, learn the skill instead' ELSE 'no certificate asked: learn the skill, skip the exam' END AS advice FROM j""")
def recommendations(spark, d):
    p = postings(spark, d)
    return P.recommendations(p, p).select("skill", "near_fit", "market", "share", "certs", "action", "advice")


@query(f"""SELECT skill, rpad(upper(action), 13, ' ') || ' ' || skill || ': near-fit ' || near_fit || ', all postings ' || market || ' (' || round_even(100 * share, 0)::INT || '%); ' || advice
|| CASE WHEN skill IN ({', '.join(q(x) for x in R.LOW_CONFIDENCE)}) THEN ' [pattern matches short or generic tokens, market count is inflated]' ELSE '' END AS line FROM ({SQL['recommendations']})""")
def format_recommendation(spark, d):
    p = postings(spark, d)
    return P.recommendations(p, p).orderBy(F.desc("near_fit"), F.desc("market"), "skill").select("skill", "line")


_TERMS = [(n, p, "certificate") for n, p in R.CERTIFICATES] + [(n, p, "tool") for n, p in R.TOOLS]


def _term_sql(name: str, pattern: str) -> str:
    if name == "Excel":
        return f"(regexp_matches(w, '(?i){re2_word('excel')}') AND NOT regexp_matches(w, {q('(?i)' + R.EXCEL_VERB.replace(chr(92) + 'b', ''))}))"
    return has("w", pattern if name in R.CASE_SENSITIVE else "(?i)" + pattern)


def re2_word(w: str) -> str:
    return rf"(?:^|[^\p{{L}}\p{{N}}_]){w}(?:[^\p{{L}}\p{{N}}_]|$)"


_PLACE = "CASE WHEN work_format = 'Remote' THEN 'remote' WHEN lower(country) IN ('france', 'germany', 'ukraine') THEN 'europe' ELSE 'other' END"


@query(f"{_MARKET}, w AS (SELECT title || chr(10) || full_text AS w, seniority, {_PLACE} AS place FROM m) " + " UNION ALL ".join(
    f"SELECT {q(n)} AS term, {q(g)} AS grp, count(*)::BIGINT AS postings, (count(*) FILTER (WHERE seniority = 'Junior'))::BIGINT AS junior, (count(*) FILTER (WHERE place = 'remote'))::BIGINT AS remote, (count(*) FILTER (WHERE place = 'europe'))::BIGINT AS europe FROM w WHERE {_term_sql(n, p)}" for n, p, g in _TERMS))
def cert_terms(spark, d):
    return P.cert_report(postings(spark, d)).select("term", "grp", "postings", "junior", "remote", "europe")


#: Sentences added to the postings by seq % 6: terms with words of need and of preference at many distances and on both sides.
ASKS = (
    "Must know SQL. Nice to have: PL-300.", "PL-300 preferred, but not required; ideally with a dbt certification.", "We use GA4 certification data daily.", "A bonus: " + "x " * 80 + "Tableau Desktop Specialist\nneeded",
    "Mandatory!\nMicrosoft Certified people, certified in Power BI, would be a plus", "GitHub Foundations, an asset. Essential: IBM Data Analyst; desirable: CompTIA Data+",
)


def _asking(spark, d):
    ask = F.element_at(F.array(*[F.lit(x) for x in ASKS]), (F.col("seq") % len(ASKS) + 1).cast("int"))
    p = postings(spark, d)
    return p.withColumn("full_text", F.concat(ask, F.lit("\n"), "full_text")).withColumn("company", F.concat("company", (F.col("seq") % 50).cast("string")))


def _plain(name: str, pattern: str) -> str:
    """A term for RE2 where its place is asked for: no look-around, boundaries of ASCII words."""
    return ("" if name in R.CASE_SENSITIVE else "(?i)") + (r"\bexcel\b" if name == "Excel" else pattern)


_HITS = f"""WITH b AS ({VIEW}), a AS (SELECT * REPLACE ({sql_list(ASKS)}[(seq % {len(ASKS)} + 1)::INT] || chr(10) || full_text AS full_text, company || (seq % 50)::VARCHAR AS company) FROM b),
m AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY lower(company), lower(title) ORDER BY seq) = 1), w AS (SELECT seq, title || chr(10) || full_text AS w, seniority, {_PLACE} AS place FROM m),
h AS (""" + " UNION ALL ".join(f"SELECT seq, seniority, place, {q(n)} AS term, {q(g)} AS grp, w, regexp_extract(w, {q('(?s)^(.*?)(?:' + _plain(n, p) + ')')}, 1) AS pre, {q('^(?:' + _plain(n, p) + ')')} AS pat FROM w WHERE {_term_sql(n, p)}" for n, p, g in _TERMS) + f"""),
k AS (SELECT *, regexp_extract(substr(w, length(pre) + 1), pat, 0) AS m FROM (SELECT * FROM h)),
c AS (SELECT *, right(pre, 150) AS l, left(substr(w, length(pre) + length(m) + 1), 150) AS r FROM k),
x AS (SELECT *, CASE WHEN length(pre) > 150 AND regexp_matches(substr(pre, length(pre) - 150, 1), '[\\p{{L}}\\p{{N}}_]') THEN 'x' ELSE ' ' END || l || m || r AS t, 2 * (length(l) + 1) + length(m) AS z FROM c),
s AS (SELECT *, {{marks_r}} AS sr, {{marks_p}} AS sp FROM x),
d AS (SELECT *, {{far_r}} AS dr, {{far_p}} AS dp FROM s),
hits AS (SELECT seq, term, grp, seniority, place, CASE WHEN dr IS NULL AND dp IS NULL THEN 'mentioned' WHEN dp IS NULL OR dr <= dp THEN 'required' ELSE 'preferred' END AS status,
 trim(regexp_replace(string_split(right(l, 80), chr(10))[-1] || m || string_split(left(r, 80), chr(10))[1], '\\s+', ' ', 'g')) AS quote FROM d)"""
for _k, _p in (("r", R.REQUIRED_NEAR), ("p", R.PREFERRED_NEAR)):
    _HITS = _HITS.replace(f"{{marks_{_k}}}", f"string_split(replace(regexp_replace(t, {q('(?i)(' + _p + ')')}, chr(1) || '\\1' || chr(2), 'g'), chr(2), chr(1)), chr(1))")
    _HITS = _HITS.replace(f"{{far_{_k}}}", f"list_min(list_transform(range(2, len(s{_k}) + 1, 2), lambda i: abs(2 * length(array_to_string(s{_k}[1:i - 1], '')) + length(s{_k}[i]) - z)))")


@query(f"{_HITS} SELECT seq, term, status FROM hits WHERE grp = 'certificate'")
def classify_context(spark, d):
    """What the word of need or preference nearest to a certificate says."""
    return P.term_hits(_asking(spark, d)).where("grp = 'certificate'").select("seq", "term", "status")


@query(f"{_HITS} SELECT seq, term, quote FROM hits")
def quote_around(spark, d):
    return P.term_hits(_asking(spark, d)).select("seq", "term", "quote")


_COUNTED = ", ".join(f"(count(*) FILTER (WHERE {c}))::BIGINT AS {n}" for n, c in (
    ("junior", "seniority = 'Junior'"), ("middle", "seniority = 'Mid-level'"), ("senior_lead_manager", "seniority IN ('Senior', 'Lead', 'Manager')"), ("level_unknown", "seniority = 'Unknown'"),
    ("europe", "place = 'europe'"), ("remote", "place = 'remote'"), ("other_location", "place = 'other'"), ("req", "status = 'required'"), ("pref", "status = 'preferred'"), ("alone", "status = 'mentioned'"),
))


@query(f"""{_HITS}, n AS (SELECT count(*) AS total FROM m), t AS (SELECT unnest([{', '.join(f"{{'term': {q(n)}, 'grp': {q(g)}}}" for n, _, g in _TERMS)}], recursive := true)),
g AS (SELECT term, count(*)::BIGINT AS postings, {_COUNTED} FROM hits GROUP BY term)
SELECT t.term, t.grp, coalesce(postings, 0)::BIGINT AS postings, round_even(100.0::DOUBLE * coalesce(postings, 0) / total, 1)::DOUBLE AS pct_of_all,
{', '.join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ('junior', 'middle', 'senior_lead_manager', 'level_unknown', 'europe', 'remote', 'other_location'))},
{', '.join(f"CASE WHEN t.grp = 'certificate' THEN coalesce({c}, 0)::VARCHAR ELSE '' END AS {o}" for c, o in (('req', 'cert_required'), ('pref', 'cert_preferred'), ('alone', 'cert_mentioned_only')))}
FROM t LEFT JOIN g USING (term), n""")
def cert_report(spark, d):
    return P.cert_report(_asking(spark, d))


@query(f"SELECT term, postings FROM ({SQL['cert_terms']}) ORDER BY postings DESC, term LIMIT 10")
def cert_top10(spark, d):
    return P.cert_report(postings(spark, d)).select("term", "postings").orderBy(F.desc("postings"), "term").limit(10)


@query(f"{_MARKET} SELECT CASE seniority WHEN 'Junior' THEN 'junior' WHEN 'Mid-level' THEN 'middle' WHEN 'Unknown' THEN 'unknown' ELSE 'senior' END AS level, {_PLACE} AS place, count(*)::BIGINT AS n FROM m GROUP BY ALL")
def level_location_totals(spark, d):
    m = P.market(postings(spark, d))
    return m.groupBy(M.level_bucket(F.col("seniority")).alias("level"), M.location_bucket(F.col("work_format"), F.col("country")).alias("place")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_HITS} SELECT term, seq, quote FROM hits QUALIFY row_number() OVER (PARTITION BY term ORDER BY md5('1:' || quote), seq) <= 3")
def quote_samples(spark, d):
    """Three quotes of each term, chosen by a hash."""
    return P.quote_samples(P.term_hits(_asking(spark, d)))


@query(f"{_MARKET} SELECT count(*) >= 50 AS ok, '' AS missing, count(*)::BIGINT AS postings FROM m")
def cert_guards(spark, d):
    return P.cert_guards(postings(spark, d))


@query(f"{WITH} SELECT availability_status, count(*)::BIGINT AS n FROM p GROUP BY 1")
def availability_counts(spark, d):
    return postings(spark, d).groupBy("availability_status").agg(F.count(F.lit(1)).alias("n"))


# --- joins, apply list, application log ------------------------------------------------------------------------------


@query(f"{WITH} SELECT seq, 'r' || title AS title, company FROM p WHERE decision <> ''")
def join_review_master(spark, d):
    p = postings(spark, d)
    return P.join_review_master(p.where("decision <> ''").select("seq", "job_id", F.concat(F.lit("r"), "title").alias("title")), p.select("job_id", "title", "company")).select("seq", "title", "company")


@query(f"{WITH} SELECT seq, CASE WHEN decision <> '' THEN main_reason ELSE '' END AS main_reason FROM p")
def join_manual_inputs(spark, d):
    p = postings(spark, d)
    return P.join_manual_inputs(p, p.where("decision <> ''").select("job_id", "main_reason"), ["main_reason"]).select("seq", "main_reason")


def _log(spark, d):
    """Log rows: by id, or typed in by hand with a URL of another form."""
    n = F.col("seq")
    status = F.element_at(F.array(*[F.lit(x) for x in ("sent", "draft", "rejected", "", "approved")]), (n % 5 + 1).cast("int"))
    return postings(spark, d).where("seq % 7 = 0").select(
        F.col("seq").alias("row"), F.when(n % 14 == 0, F.col("job_id")).otherwise("").alias("job_id"), F.concat(F.lit("https://example.com/jobs/x"), n.cast("string"), F.lit("?utm_medium=a")).alias("url"), status.alias("status"),
        F.when(n % 3 == 0, "2026-10-01").otherwise("").alias("date_sent"), F.lit("").alias("response"), F.concat(F.lit("n"), n.cast("string")).alias("notes"), F.lit("").alias("date_added"), F.lit("T").alias("title"), F.lit("C").alias("company"),
    )


_LOG = f"{WITH}, e AS (SELECT seq, ['sent', 'draft', 'rejected', '', 'approved'][(seq % 5 + 1)::INT] AS status, CASE WHEN seq % 3 = 0 THEN '2026-10-01' ELSE '' END AS date_sent, CASE WHEN seq % 14 = 0 THEN job_id ELSE 'url:https://example.com/jobs/x' || seq::VARCHAR END AS key FROM p WHERE seq % 7 = 0)"


@query(f"{_LOG} SELECT CASE WHEN seq % 14 <> 0 AND seq % 21 = 0 THEN 'j' || lpad(seq::VARCHAR, 8, '0') ELSE key END AS key, status FROM e")
def resolve_url_keys(spark, d):
    n = F.col("seq")
    records = postings(spark, d).where("seq % 21 = 0").select("seq", "job_id", F.concat(F.lit("https://EXAMPLE.com/jobs/x"), n.cast("string"), F.lit("/")).alias("url"))
    return P.resolve_keys(_log(spark, d), records, F.col("row")).select("key", "status")


def _drafts(spark, d):
    n = F.col("seq")
    return postings(spark, d).where("seq % 28 = 0 OR seq % 11 = 0").select("job_id", F.when(n % 2 == 0, "ready").otherwise("").alias("review_verdict"), (n % 3 == 0).alias("pdf_ready"))


@query(f"""{_LOG}, r AS (SELECT * FROM p WHERE seq % 2 = 0), dr AS (SELECT seq, job_id FROM p WHERE seq % 28 = 0 OR seq % 11 = 0),
j AS (SELECT dr.seq AS ds, coalesce(dr.job_id, e.key) AS id, e.status, e.date_sent, dr.job_id IS NOT NULL AS drafted FROM dr FULL JOIN e ON dr.job_id = e.key),
o AS (SELECT j.id, drafted, CASE WHEN drafted THEN coalesce(nullif(j.status, ''), 'draft') ELSE coalesce(nullif(j.status, ''), 'sent') END AS st, coalesce(j.date_sent, '') AS date_sent, r.title AS rt, r.date_collected AS dc FROM j LEFT JOIN r ON j.id = r.job_id)
SELECT CASE WHEN starts_with(id, 'url:') THEN '' ELSE id END AS job_id, CASE WHEN rt IS NOT NULL THEN rt WHEN drafted THEN '' ELSE 'T' END AS title, st AS status, date_sent,
CASE WHEN date_sent <> '' AND dc IS NOT NULL THEN date_diff('day', dc::DATE, date_sent::DATE)::VARCHAR ELSE '' END AS days_from_found FROM o WHERE drafted OR st <> 'draft'""")
def build_applications(spark, d):
    records = postings(spark, d).where("seq % 2 = 0")
    existing = P.resolve_keys(_log(spark, d), records.where("false"), F.col("row"))
    return P.build_applications(_drafts(spark, d), records, existing, TODAY).select("job_id", "title", "status", "date_sent", "days_from_found")


@query(f"{_LOG}, m AS (SELECT job_id, seq FROM p WHERE seq % 17 = 0) SELECT coalesce(e.key, m.job_id) AS key, CASE WHEN e.key IS NULL THEN 'sent' WHEN m.job_id IS NOT NULL AND e.status IN ('', 'draft', 'approved') THEN 'sent' ELSE e.status END AS status, CASE WHEN e.key IS NULL THEN '{TODAY}' WHEN m.job_id IS NOT NULL AND e.status IN ('', 'draft', 'approved') THEN coalesce(nullif(e.date_sent, ''), '{TODAY}') ELSE e.date_sent END AS date_sent FROM e FULL JOIN m ON e.key = m.job_id")
def apply_applied_marks(spark, d):
    existing = _log(spark, d).withColumn("key", I.app_key(F.col("job_id"), F.col("url")))
    return P.apply_marks(existing, postings(spark, d).select("job_id", "applied"), TODAY).select("key", "status", "date_sent")


_APPS = "a AS (SELECT job_id FROM p WHERE seq % 26 = 0)"


@query(f"{WITH}, {_APPS} SELECT seq, applied <> '' OR job_id IN (SELECT job_id FROM a) OR seq % 100 = 7 AS handled FROM p")
def handled_semi(spark, d):
    p = postings(spark, d)
    apps = p.where("seq % 26 = 0").select("job_id", F.lit("").alias("url"), F.lit("sent").alias("status")).unionByName(
        p.where("seq = 7").select(F.lit("").alias("job_id"), F.lit("https://example.com/jobs/7").alias("url"), F.lit("rejected").alias("status"))
    )
    return P.handled(p, apps).select("seq", "handled")


@query(_GROUPED.replace("'g' || (seq // 8)", "'g' || (seq // 3)").replace("seq % 4 = 0", "seq % 3 = 9") + f""", {_APPS}, h AS (SELECT *, applied <> '' OR job_id IN (SELECT job_id FROM a) AS handled FROM g), dg AS (SELECT DISTINCT duplicate_group FROM h WHERE handled),
k AS (SELECT * FROM h WHERE {_NEAR} AND availability_status = 'active' AND NOT handled AND duplicate_group NOT IN (SELECT duplicate_group FROM dg))
SELECT seq, decision, board AS source, coalesce((SELECT string_agg(DISTINCT o.board, ', ' ORDER BY o.board) FROM g o WHERE o.duplicate_group = k.duplicate_group AND o.seq <> k.seq), '') AS also_on FROM k
QUALIFY row_number() OVER (PARTITION BY duplicate_group ORDER BY decision <> {q(R.YES)}, list_position({sql_list(R.SOURCE_ORDER)}, board), job_id) = 1""")
def active_near_fit(spark, d):
    p = postings(spark, d)
    rows = p.withColumn("duplicate_group", F.concat(F.lit("g"), F.floor(F.col("seq") / 3).cast("string"))).withColumn("source", F.col("board"))
    apps = p.where("seq % 26 = 0").select("job_id", F.lit("").alias("url"), F.lit("sent").alias("status"))
    return P.near_fit_list(rows, apps).select("seq", "decision", "source", "also_on")


@query(f"{WITH} SELECT job_id FROM p WHERE seq % 3 = 0 INTERSECT SELECT job_id FROM p WHERE seq % 5 = 0")
def skills_set_ops(spark, d):
    p = postings(spark, d)
    return p.where("seq % 3 = 0").select("job_id").intersect(p.where("seq % 5 = 0").select("job_id"))


# --- the collection pass ---------------------------------------------------------------------------------------------


@query(f"""WITH q AS ({SQL['first_matching_query']}), o AS ({SQL['is_overqualified']}), f AS ({SQL['requires_french']}), g AS ({SQL['requires_german']}), x AS ({SQL['posting_predicates']}), {WITH.removeprefix('WITH ')}
SELECT p.seq, p.source, p.title, p.company, q.query AS search_query, CASE {' '.join(f"WHEN q.query IN ({', '.join(q(x) for x in xs)}) THEN {q(n)}" for n, xs in R.QUERIES.items())} END AS job_category,
lower(p.source) || '|url|https://example.com/jobs/' || (p.seq % 100) AS key
FROM p JOIN q USING (seq) JOIN o USING (seq) JOIN f USING (seq) JOIN g USING (seq) JOIN x USING (seq) WHERE NOT (o.over OR f.needed OR g.needed OR x.low OR x.onsite)
QUALIFY row_number() OVER (PARTITION BY lower(p.source), p.seq % 100 ORDER BY p.seq) = 1""")
def collect_pass(spark, d):
    """Filters, label, dedup per source and over all, in one plan."""
    c = F.col
    p = postings(spark, d).withColumn("m", M.first_matching_query(c("title"))).where("m IS NOT NULL")
    bad = M.is_overqualified(c("title"), c("full_text")) | M.requires_french(c("title"), c("full_text")) | M.requires_german(c("title"), c("full_text")) | M.is_low_quality(c("title"), c("full_text")) | M.onsite_in_disallowed(c("work_format"), c("country"))
    kept = p.where(~bad).select("seq", "source", "title", "company", c("m.query").alias("search_query"), c("m.category").alias("job_category"), I.dedup_key(c("source"), c("url"), c("company"), c("title"), c("city_region")).alias("key"))
    return D.first_per_key(kept, [c("key")], [c("seq")])



