"""Queries over sources, sheets, sinks and streams: payloads are made of the posting view, and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions.html import clean_text as html_text
from ..functions.text import fold
from ..operators.store import fresh_dir
from ..sources import feeds as S
from ..sources import tables as T
from ..sources import workbooks as W
from ..streaming.buckets import read_table
from ..streaming.upsert import event_counts, landed_stream
from .queries import Query
from .view import WITH, postings

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_folder = fresh_dir


def _short(spark, d):
    return postings(spark, d).withColumn("body", F.concat(F.lit("Fully remote. "), F.col("company")))


def _payload(df, value, *more):
    return df.select("seq", F.to_json(value).alias("payload"), *more)


def _struct(**cols):
    return F.struct(*[c.alias(n) for n, c in cols.items()])




def _n():
    return F.col("seq").cast("string")


@query(f"{WITH} SELECT seq, title, company, city_region, 'Remote' AS work_format, 'https://x.example/' || seq AS url, '2026-09-01' AS date_published, 'ATS: Greenhouse; board: b' || (seq % 3) AS note FROM p")
def src_greenhouse(spark, d):
    job = _struct(title=F.col("title"), content=F.concat(F.lit("<p>"), F.replace("body", F.lit("&"), F.lit("&amp;")), F.lit("</p>")), absolute_url=F.concat(F.lit("https://x.example/"), _n()), updated_at=F.lit("2026-09-01"), location=_struct(name=F.col("city_region")))
    pages = _payload(_short(spark, d), _struct(jobs=F.array(job)), "company", F.concat(F.lit("b"), (F.col("seq") % 3).cast("string")).alias("slug"))
    return S.greenhouse(pages, ("seq",)).select("seq", "title", "company", "city_region", "work_format", "url", "date_published", "note")


@query(f"{WITH} SELECT seq, title, CASE seq % 3 WHEN 0 THEN 'Hybrid' WHEN 1 THEN 'On-site' ELSE 'Remote' END AS work_format, 'Full-time' AS contract_type, 'Intro' || chr(10) || chr(10) || 'Duties' || chr(10) || 'Fully remote. ' || company AS full_text, '2026-01-01T00:00:00+00:00' AS date_published FROM p")
def src_lever(spark, d):
    n = F.col("seq")
    job = _struct(
        text=F.col("title"), hostedUrl=F.concat(F.lit("https://l.example/"), _n()), descriptionPlain=F.lit("Intro"), lists=F.array(_struct(text=F.lit("Duties"), content=F.col("body")), _struct(text=F.lit("Empty"), content=F.lit(""))),
        categories=_struct(location=F.col("city_region"), commitment=F.lit("Full-time")), workplaceType=F.when(n % 3 == 0, "hybrid").when(n % 3 == 1, "onsite").otherwise("unspecified"), createdAt=F.lit(1767225600000),
    )
    return S.lever(_payload(_short(spark, d), F.array(job), "company", F.lit("b").alias("slug")), ("seq",)).select("seq", "title", "work_format", "contract_type", "full_text", "date_published")


@query(f"{WITH} SELECT seq, title, CASE WHEN seq % 2 = 0 THEN 'Paris, France' ELSE 'Berlin' END AS city_region, CASE WHEN seq % 2 = 0 THEN 'Hybrid' ELSE 'Remote' END AS work_format FROM p WHERE contains(lower(title), 'data')")
def src_bamboohr(spark, d):
    n, p = F.col("seq"), _short(spark, d)
    entry = _struct(id=_n(), jobOpeningName=F.col("title"), location=_struct(city=F.lit("Berlin")), locationType=F.lit("1"))
    lists = _payload(p, _struct(result=F.array(entry)), "company", F.lit("b").alias("slug"))
    opening = _struct(location=_struct(city=F.lit("Paris"), addressCountry=F.lit("France")), locationType=F.lit("2"), description=F.col("body"), jobOpeningName=F.lit(""))
    details = p.where(n % 2 == 0).select(F.lit("b").alias("slug"), _n().alias("id"), F.to_json(_struct(result=_struct(jobOpening=opening))).alias("payload"))
    return S.bamboohr(lists, details, lambda t: fold(t).contains("data"), ("seq",)).select("seq", "title", "city_region", "work_format")


@query(f"""{WITH} SELECT DISTINCT company, ['lever', 'greenhouse', 'bamboohr'][(seq % 4 + 1)::INT] AS ats, 'b' || (seq % 45)::VARCHAR AS slug, CASE WHEN seq % 3 = 0 THEN 'h.example' ELSE 'api.lever.co' END AS host FROM p
WHERE seq % 4 <> 3 AND seq % 7 <> 0 AND seq % 5 <> 0""")
def ats_board_validate(spark, d):
    """Boards as typed in: blanks around, cases mixed; those without company or slug, or of another system, go."""
    n = F.col("seq")
    ats = F.element_at(F.array(*[F.lit(x) for x in (" Lever", "GreenHouse ", "bamboohr", "workday")]), (n % 4 + 1).cast("int"))
    slug = F.when(n % 7 == 0, F.when(n % 2 == 0, "  ")).otherwise(F.concat(F.lit(" b"), (n % 45).cast("string")))
    typed = postings(spark, d).select(F.when(n % 5 == 0, "").otherwise(F.concat(F.lit(" "), "company")).alias("company"), ats.alias("ats"), slug.alias("slug"), F.when(n % 3 == 0, "h.example").otherwise(" ").alias("host"))
    return S.boards(typed.distinct()).distinct()


@query(f"{WITH} SELECT seq, title, CASE WHEN seq % 2 = 0 THEN '1000-' || (2000 + seq) || ' USD' ELSE '' END AS salary, CASE WHEN city_region = 'Paris, Ile-de-France, France' THEN 'France' WHEN city_region = 'Berlin, Germany' THEN 'Germany' WHEN city_region = 'Europe' THEN 'Europe' WHEN city_region = 'Kyiv, Ukraine' THEN 'Ukraine' WHEN city_region = 'Remote - USA' THEN 'USA' ELSE '' END AS country FROM p")
def src_remoteok(spark, d):
    n = F.col("seq")
    job = _struct(position=F.col("title"), company=F.col("company"), location=F.col("city_region"), description=F.col("body"), url=_n(), salary_min=F.when(n % 2 == 0, 1000).otherwise(0), salary_max=F.when(n % 2 == 0, 2000 + n).otherwise(0))
    legal = _struct(position=F.lit(None).cast("string"), company=F.lit("legal"), location=F.lit(""), description=F.lit(""), url=F.lit(""), salary_min=F.lit(0), salary_max=F.lit(0).cast("long"))
    return S.remoteok(_payload(_short(spark, d), F.array(legal, job)), ("seq",)).select("seq", "title", "salary", "country")


@query(f"{WITH} SELECT seq, title, company, '50000 EUR/year' AS salary, 'Remote' AS work_format FROM p")
def src_jobicy(spark, d):
    job = _struct(url=_n(), jobTitle=F.col("title"), companyName=F.col("company"), jobGeo=F.lit("Europe"), jobDescription=F.col("body"), salaryMin=F.lit(50000), salaryMax=F.lit(50000), salaryCurrency=F.lit("EUR"), salaryPeriod=F.lit("Yearly"))
    return S.jobicy(_payload(_short(spark, d), _struct(jobs=F.array(job))), ("seq",)).select("seq", "title", "company", "salary", "work_format")


@query(f"{WITH} SELECT seq, CASE seq % 3 WHEN 0 THEN 'Worldwide' WHEN 1 THEN 'Peru' ELSE 'A, B, C, D, E, F (+2 more)' END AS city_region, CASE WHEN seq % 3 = 1 THEN 'Peru' ELSE '' END AS country, '2026-01-01T00:00:00+00:00' AS date_published, seq < 30 AS more FROM p")
def src_himalayas(spark, d):
    n = F.col("seq")
    places = F.when(n % 3 == 0, F.array().cast("array<string>")).when(n % 3 == 1, F.array(F.lit("Peru"))).otherwise(F.array(*[F.lit(x) for x in "ABCDEFGH"]))
    job = _struct(title=F.col("title"), companyName=F.col("company"), guid=_n(), description=F.col("body"), pubDate=F.lit(1767225600), locationRestrictions=places)
    pages = _payload(_short(spark, d), _struct(jobs=F.array(job), totalCount=F.when(n < 30, 21).otherwise(20)))
    more = pages.select(F.col("seq").alias("_n"), S.has_more_pages(F.col("payload"), F.lit(1)).alias("more"))
    return S.himalayas(pages, ("seq",)).join(more, F.col("seq") == F.col("_n")).select("seq", "city_region", "country", "date_published", "more")


def _rss(*tags):
    """An RSS document of one item; tags: (name, Column)."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    parts = [F.concat(F.lit(f"<{n}>"), esc(c), F.lit(f"</{n}>")) for n, c in tags]
    return F.concat(F.lit("<rss><channel><title>feed</title><item>"), *parts, F.lit("</item></channel></rss>")).alias("payload")


@query(f"""{WITH} SELECT seq, title, CASE WHEN seq % 2 = 0 THEN 'Page & Co' ELSE 'Bold Co' END AS company, 'Remote' AS work_format,
CASE WHEN seq % 2 <> 0 THEN '' WHEN seq % 4 = 0 THEN 'Ukraine or India' ELSE 'Countries of Europe or Ukraine' END AS city_region, seq % 4 = 0 AS barred FROM p WHERE seq % 3 <> 0""")
def src_djinni(spark, d):
    """Feeds of one item each, with detail pages for every second: a logo's link before the name's, an office before the candidates' countries."""
    n, p = F.col("seq"), _short(spark, d)
    link = F.concat(F.lit("https://dj.example/"), _n())
    feed = p.select("seq", _rss(("title", F.col("title")), ("link", link), ("description", F.lit("<p><strong>Bold Co</strong> віддалено</p>")), ("category", F.when(n % 3 == 0, "Support").otherwise("data analyst")), ("category", F.lit("Other"))))
    where = F.when(n % 4 == 0, "Ukraine <b>or</b> India").otherwise("Countries of Europe or Ukraine")
    page = F.concat(
        F.lit('<a class="logo" href="/jobs/company-x/"> <img></a><a class="c" href="https://dj.example/jobs/company-x/">Page &amp; Co</a><ul><li><span class="location-text">Ukraine (Kyiv)</span></li>'),
        F.lit('<li><div class="font-size-extra-small">who</div><span class="bold location-text">'), where, F.lit("</span></li></ul>"),
    )
    details = p.where(n % 2 == 0).select(link.alias("link"), page.alias("html"))
    found = S.djinni(feed, "Data Analyst", details, ("seq",))
    return found.select("seq", "title", "company", "work_format", "city_region", M.candidates_only_disallowed(F.col("city_region")).alias("barred"))


@query(f"{WITH} SELECT seq // 20 AS feed, count(*)::BIGINT AS items, 'none of ' || count(*) || ' items is of category Data Analyst: the feed ignores its filter' AS message FROM p GROUP BY 1 HAVING bool_and(title <> 'Data Analyst' OR (seq // 20) % 3 = 0)")
def djinni_feed_errors(spark, d):
    """Feeds of twenty items: some hold their category, others ignore it."""
    kind = F.when((F.col("feed") % 3 == 0), "Support").otherwise(F.col("title"))
    esc = F.replace(F.col("title"), F.lit("&"), F.lit("&amp;"))
    item = F.concat(F.lit("<item><title>"), esc, F.lit("</title><link>l</link><category>"), F.replace(kind, F.lit("&"), F.lit("&amp;")), F.lit("</category></item>"))
    rows = postings(spark, d).withColumn("feed", F.floor(F.col("seq") / 20)).select("feed", "seq", item.alias("item"))
    feeds = rows.groupBy("feed").agg(F.array_sort(F.collect_list(F.struct("seq", "item"))).alias("items"))  # twenty items each
    payload = F.concat(F.lit("<rss><channel><title>feed</title>"), F.array_join(F.transform("items", lambda i: i["item"]), ""), F.lit("</channel></rss>"))
    return S.feed_errors(feeds.select("feed", payload.alias("payload")), "Data Analyst", ("feed",))


@query(f"{WITH} SELECT seq, title, 'Acme, 2-Inc' AS company, CASE WHEN seq % 2 = 0 THEN '$2000–3000/month' ELSE '' END AS salary, CASE seq % 3 WHEN 0 THEN 'Ukraine' WHEN 1 THEN 'Poland' ELSE '' END AS country, CASE seq % 3 WHEN 2 THEN 'Remote' ELSE 'On-site' END AS work_format FROM p WHERE contains(lower(title), 'analy')")
def src_dou(spark, d):
    n = F.col("seq")
    place = F.when(n % 3 == 0, "Київ").when(n % 3 == 1, "Варшава (Польща)").otherwise("віддалено")
    title = F.concat(F.col("title"), F.lit(" в Acme, 2-Inc, "), F.when(n % 2 == 0, "$2000–3000, ").otherwise(""), place)
    feed = _short(spark, d).select("seq", _rss(("title", title), ("link", F.concat(F.lit("https://dou.example/"), _n(), F.lit("?utm_source=jobsrss"))), ("description", F.col("body")), ("pubDate", F.lit("Fri, 02 Oct 2026 15:31:05"))))
    return S.dou(feed, ("seq",)).select("seq", "title", "company", "salary", "country", "work_format")


@query(f"{WITH} SELECT seq, title, company, CASE WHEN city_region = '' THEN 'USA' ELSE city_region END AS city_region, 'https://w.example/' || seq AS url FROM p")
def src_wwr(spark, d):
    feed = _short(spark, d).select("seq", _rss(("title", F.concat("company", F.lit(": "), "title")), ("link", F.concat(F.lit("https://w.example/"), _n())), ("description", F.col("body")), ("region", F.col("city_region")), ("country", F.lit("USA"))))
    return S.weworkremotely(feed, ("seq",)).select("seq", "title", "company", "city_region", "url")


def _page(spark, d):
    job = F.to_json(_struct(title=F.col("title"), description=F.lit("<p>Hybrid</p>"), datePosted=F.lit("2026-09-01"), hiringOrganization=_struct(name=F.col("company")), jobLocation=F.array(_struct(address=_struct(addressLocality=F.lit("Paris"), addressCountry=F.lit("France")))), baseSalary=_struct(currency=F.lit("EUR"), value=_struct(minValue=F.lit("10"), maxValue=F.lit("20"), unitText=F.lit("HOUR")))))
    job = F.regexp_replace(job, r"^\{", '{"@type":"JobPosting",')
    ld = F.when(F.col("seq") % 2 == 0, F.concat(F.lit('<script type="application/ld+json">'), job, F.lit("</script>"))).otherwise("")
    return _short(spark, d).select("seq", F.concat(F.lit("https://li.example/"), _n()).alias("url"), F.concat(F.lit("<html><title>"), F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit(" | Tag Co | LinkedIn</title>"), ld, F.lit('<body><div class="description">Fully remote</div></body></html>')).alias("html"))


@query(f"{WITH} SELECT seq, title, CASE WHEN seq % 2 = 0 THEN company ELSE 'Tag Co' END AS company, CASE WHEN seq % 2 = 0 THEN 'Paris, France' ELSE '' END AS city_region, CASE WHEN seq % 2 = 0 THEN '10-20 EUR/hour' ELSE '' END AS salary, CASE WHEN seq % 2 = 0 THEN 'Hybrid' ELSE 'Remote' END AS work_format FROM p")
def src_linkedin(spark, d):
    return S.linkedin_pages(_page(spark, d), ("seq",)).select("seq", "title", "company", "city_region", "salary", "work_format")


@query(f"{WITH} SELECT seq, title, '2026-09-01' AS date_published FROM p WHERE seq % 2 = 0")
def src_wttj(spark, d):
    return S.wttj_pages(_page(spark, d), ("seq",)).where("date_published <> ''").select("seq", "title", "date_published")


@query(f"""{WITH} SELECT seq, title, company, CASE WHEN seq % 3 = 0 THEN city_region WHEN seq % 3 = 1 THEN 'Oslo, Norway' ELSE '' END AS city_region, CASE seq % 4 WHEN 0 THEN '2026-10-30' WHEN 1 THEN '2026-10-25' ELSE 'recently' END AS date_published,
CASE WHEN seq % 2 = 0 THEN '80 000 - 95 000 EUR per year' ELSE '' END AS salary, 'About the job' || chr(10) || 'SQL' AS head FROM p""")
def linkedin_elements(spark, d):
    """Pages without structured data: headings, links, a place as an element or in the text, pay in the text, days ago; another job beside it stays out."""
    n, c = F.col("seq"), F.col
    esc = lambda x: F.replace(x, F.lit("&"), F.lit("&amp;"))
    told = F.when(n % 3 == 1, "<p>Location: Oslo, Norway</p>").otherwise("")
    ago = F.when(n % 4 == 0, "2 days ago").when(n % 4 == 1, "1 week ago").otherwise("recently")
    page = F.concat(
        F.lit("<html><head><title>Other | Nobody | LinkedIn</title></head><body><h1> </h1><h1>"), esc(c("title")), F.lit('</h1><a href="https://x.example/company/x/"><img></a><a href="/company/x/">'), esc(c("company")), F.lit("</a>"),
        F.when(n % 3 == 0, F.concat(F.lit('<span class="a topcard__flavor--bullet">'), c("city_region"), F.lit("</span>"))).otherwise(""), F.lit('<div id="JobDetails_AboutTheJob_7">About the job<div><p>SQL</p>'), told,
        F.when(n % 2 == 0, "<p>Salary: 80 000 - 95 000 EUR per year</p>").otherwise(""), F.lit('</div></div><div id="JobDetailsSimilarJobsSlot_1">German speaking, 10 EUR</div><time>'), ago, F.lit("</time></body></html>"),
    )
    found = S.linkedin_pages(postings(spark, d).select("seq", _n().alias("url"), page.alias("html")), ("seq",), F.lit("2026-11-01 12:00:00").cast("timestamp"))
    return found.select("seq", "title", "company", "city_region", "date_published", "salary", F.substring_index("full_text", "\n", 2).alias("head"))


@query(f"{WITH} SELECT seq, CASE WHEN seq % 2 = 0 THEN 'Data ' || title ELSE title END AS title, company, CASE WHEN seq % 2 = 0 THEN 'Lyon, France / Nice, France' ELSE 'Lille, France' END AS city_region, 'France' AS country, CASE WHEN seq % 3 = 0 THEN 'Remote' ELSE 'Hybrid' END AS work_format FROM p")
def wttj_elements(spark, d):
    """Structured data for what it tells, the page's elements for the rest; the format of work stands anywhere on the page."""
    n, c = F.col("seq"), F.col
    spot = lambda x: _struct(address=_struct(addressLocality=F.lit(x), addressCountry=F.lit("France")))
    job = F.regexp_replace(F.to_json(_struct(title=F.concat(F.lit("Data "), c("title")), jobLocation=F.array(spot("Lyon"), spot("Nice"), spot("Lyon")))), r"^\{", '{"@type":"JobPosting",')
    esc = lambda x: F.replace(x, F.lit("&"), F.lit("&amp;"))
    page = F.concat(
        F.lit("<html><body>"), F.when(n % 2 == 0, F.concat(F.lit('<script type="application/ld+json">'), job, F.lit("</script>"))).otherwise(""), F.lit("<h1>"), esc(c("title")), F.lit('</h1><p data-testid="job-company-name">'), esc(c("company")),
        F.lit('</p><ul><li data-testid="job-location">Lille, France</li></ul><footer>'), F.when(n % 3 == 0, "Fully remote").otherwise("Hybrid"), F.lit("</footer></body></html>"),
    )
    return S.wttj_pages(postings(spark, d).select("seq", _n().alias("url"), page.alias("html")), ("seq",)).select("seq", "title", "company", "city_region", "country", "work_format")


@query(f"{WITH} SELECT seq, title, 'Ukraine' AS country, title || chr(10) || 'Body ' || company AS full_text FROM p")
def src_work_ua(spark, d):
    esc = lambda c: F.replace(F.col(c), F.lit("&"), F.lit("&amp;"))
    pages = postings(spark, d).select("seq", _n().alias("url"), F.concat(F.lit("<h1>"), esc("title"), F.lit("</h1><p>Body "), esc("company"), F.lit("</p><div>Similar jobs</div><p>Other</p>")).alias("html"))
    return S.detail_pages(pages, "Work.ua", ("Similar jobs",), ("seq",)).select("seq", "title", "country", "full_text")


@query(f"{WITH} SELECT seq, title AS name, 'https://c.example/' || seq AS page, '' AS note FROM p")
def src_notion_table(spark, d):
    cell = lambda t, h: _struct(text=t, href=h)
    rows = postings(spark, d).select("seq", F.array(*[F.lit(x) for x in ("Name", "Page", "Note")]).alias("headers"), F.array(cell(F.col("title"), F.lit("")), cell(F.lit("c.ex…"), F.concat(F.lit("https://c.example/"), _n()))).alias("cells"))
    return S.table_rows(rows).select("seq", F.col("row.Name").alias("name"), F.col("row.Page").alias("page"), F.col("row.Note").alias("note"))


@query()
def clean_text(spark, d):
    """Text of whole pages."""
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", html_text(F.col("html")).alias("text"))


# --- sheets, drafts, sinks -------------------------------------------------------------------------------------------


@query(f"{WITH} SELECT seq::VARCHAR AS seq, title, company, full_text FROM p")
def scan_csv(spark, d):
    """Written as CSV and read back as text."""
    folder = _folder(spark, "csv")
    T.write_csv(postings(spark, d).select(_n().alias("seq"), "title", "company", "full_text"), folder)
    return T.read_csv(spark, folder, ["seq", "title", "company", "full_text"])


@query(f"{WITH} SELECT seq::VARCHAR AS seq, title, full_text, decision FROM p")
def scan_xlsx(spark, d):
    """Whole postings as a folder of workbooks, read back as text."""
    book = _folder(spark, "books")
    W.write_workbooks(postings(spark, d).select("seq", "title", "full_text", "decision"), book, "Jobs", [F.col("seq")], 400)
    return W.read_workbooks(spark, book, ["seq", "title", "full_text", "decision"])


@query(f"{WITH} SELECT seq, decision FROM p WHERE decision <> ''")
def replace_sheet(spark, d):
    """A book is a folder of tables as well; replacing one sheet keeps the others."""
    book, p = _folder(spark, "book"), postings(spark, d).select("seq", "decision")
    T.write_sheet(p.limit(1), book, "Jobs")
    T.write_sheet(p, book, "raw_jobs")
    T.write_sheet(p.where("decision <> ''"), book, "Jobs")
    return T.read_sheet(spark, book)


@query(f"{WITH} SELECT 'j' || (seq % 50) AS job_id, arg_max(decision, seq) AS decision FROM p WHERE seq % 50 <> 0 GROUP BY 1")
def scan_manual_review(spark, d):
    """Several files, read in as many tasks as there are: the last row of an id counts, by the order of the scan."""
    n, book = F.col("seq"), _folder(spark, "book")
    rows = postings(spark, d).select("seq", F.when(n % 50 == 0, F.when(n % 100 == 0, "nan").otherwise(" ")).otherwise(F.concat(F.lit("j"), (n % 50).cast("string"))).alias("job_id"), "decision")
    T.write_sheet(rows.repartitionByRange(7, "seq").sortWithinPartitions("seq").drop("seq"), book, "manual_review")
    return T.manual_review(T.read_sheet(spark, book, ("manual_review",), order="row"), "row").select("job_id", "decision")


_TYPED = f"{WITH}, e AS (SELECT seq, CASE WHEN seq % 5 = 0 THEN '' WHEN seq % 2 = 0 THEN 'j' || (seq % 60)::VARCHAR ELSE '' END AS id, CASE WHEN seq % 5 = 0 THEN '' ELSE 'https://example.com/jobs/x' || (seq % 40)::VARCHAR END AS url, ['sent', 'draft', 'rejected', '', 'approved'][(seq % 5 + 1)::INT] AS status FROM p)"


@query(f"{_TYPED} SELECT CASE WHEN id <> '' THEN id ELSE 'url:' || url END AS key, arg_max(status, seq) AS status, arg_max('n' || seq, seq) AS notes FROM e WHERE id <> '' OR url <> '' GROUP BY 1")
def scan_applications(spark, d):
    """The log as CSV files, typed by hand with URLs of several forms: keyed, and the last row over all files counts."""
    n, folder = F.col("seq"), _folder(spark, "log")
    url = F.when(n % 5 == 0, " ").otherwise(F.concat(F.lit("https://Example.com/jobs/x"), (n % 40).cast("string"), F.when(n % 3 == 0, "/?utm_medium=a").otherwise("")))
    status = F.element_at(F.array(*[F.lit(x) for x in ("sent", "draft", "rejected", "", "approved")]), (n % 5 + 1).cast("int"))
    rows = postings(spark, d).select("seq", F.when((n % 5 != 0) & (n % 2 == 0), F.concat(F.lit("j"), (n % 60).cast("string"))).otherwise("").alias("job_id"), url.alias("url"), status.alias("status"), F.concat(F.lit("n"), n.cast("string")).alias("notes"))
    T.write_csv(rows.repartitionByRange(7, "seq").sortWithinPartitions("seq").drop("seq"), folder)
    return T.applications(T.read_csv(spark, folder, ["job_id", "url", "status", "notes"], order="row"), "row").select("key", "status", "notes")


@query(f"{WITH} SELECT seq, CASE seq % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'needs_revision' ELSE '' END AS verdict, 'Pitch ' || title AS pitch, 'one; two' AS bullets, seq % 3 < 2 AS reviewed FROM p")
def draft_content(spark, d):
    n = F.col("seq")
    review = F.when(n % 3 == 0, f"\n---\n\n{T.REVIEW_MARK}\n\n✅ Одобрено").when(n % 3 == 1, f"\n---\n\n{T.REVIEW_MARK}\n\n⚠️ Нужна правка").otherwise("")
    md = F.concat(F.lit("# T\n\n> Pitch "), F.col("title"), F.lit("\n\n## Адаптированные пункты для CV\n\n- one\n- two\n\n---\n"), review)
    s = postings(spark, d).select("seq", md.alias("md"))
    return s.select("seq", T.verdict(F.col("md")).alias("verdict"), T.draft_content(F.col("md")).alias("c"), T.has_review(F.col("md")).alias("reviewed")).select("seq", "verdict", "c.pitch", "c.bullets", "reviewed")


@query(f"{WITH} SELECT seq, company || ' · a.b@x.example · linkedin.com/in/' || seq AS contact FROM p")
def contact_line(spark, d):
    cv = F.concat(F.col("company"), F.lit(" — Resume\n"), F.col("company"), F.lit("\nmail a.b@x.example, linkedin.com/in/"), _n())
    return postings(spark, d).select("seq", T.contact_line(cv).alias("contact"))


@query(f"{WITH}, l AS (SELECT source, count(*)::BIGINT AS found FROM p GROUP BY 1) SELECT source, found, 2::BIGINT AS runs FROM l")
def sink_run_log(spark, d):
    """Appended twice, read back."""
    folder = _folder(spark, "log")
    stats = postings(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("found"))
    for run in ("a", "b"):
        T.append_run_log(stats.withColumn("run", F.lit(run)), folder)
    return spark.read.schema("source string, found long, run string").json(folder).groupBy("source", "found").agg(F.countDistinct("run").alias("runs"))


# --- streams ---------------------------------------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def stream_event_counts(spark, d):
    return event_counts(spark, f"{d}/events*.parquet", _folder(spark, "stream")).select("day", "event_type", "n")


@query(f"{WITH} SELECT 'https://r.example/' || seq AS url, title, CASE seq % 3 WHEN 1 THEN 'existing' ELSE 'new' END AS status FROM p")
def stream_landed_feeds(spark, d):
    """Two feeds that overlap land one after the other and stream into one table in buckets: what both hold is met again, not doubled."""
    n, base = F.col("seq"), _folder(spark, "landed")
    job = _struct(position=F.col("title"), company=F.col("company"), url=F.concat(F.lit("https://r.example/"), _n()))
    payloads = postings(spark, d).select("seq", F.to_json(F.array(job)).alias("value"))
    for feed in (0, 1):
        payloads.where(n % 3 != 2 * (1 - feed)).select("value").write.mode("append").text(f"{base}/in")
        landed_stream(spark, "remoteok", f"{base}/in", f"{base}/table", f"{base}/rejects", f"{base}/state", wholetext=False, buckets=16).awaitTermination()
    return read_table(spark, f"{base}/table").select("url", "title", "status")


@query(f"{WITH} SELECT seq, CASE seq % 4 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'empty' WHEN 2 THEN 'not a list of postings' END AS reason FROM p WHERE seq % 4 <> 3")
def malformed_payloads(spark, d):
    """What a feed source can't read goes to a table of its own with the reason."""
    n = F.col("seq")
    payload = F.when(n % 4 == 0, F.concat(F.lit('[{"position": '), "title")).when(n % 4 == 1, " ").when(n % 4 == 2, F.to_json(_struct(position=F.col("title")))).otherwise(F.to_json(F.array(_struct(position=F.col("title")))))
    return S.malformed(postings(spark, d).select(n.alias("path"), payload.alias("payload")), "remoteok").withColumnRenamed("path", "seq")
