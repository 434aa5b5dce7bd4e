"""Landed payloads to postings: one function for each source, payload column in, canonical columns out.

JSON and XML are parsed with explicit schemas (a malformed payload gives no rows), exploded and projected; all of it stays in the JVM
but html_to_text where a description may hold tags.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions.html import chosen_texts, clean_text, without_upsell
from ..functions.text import first_nonblank, fold, squeeze, strip, text

CANONICAL = ("source", "title", "company", "city_region", "country", "work_format", "contract_type", "salary", "url", "date_published", "full_text", "note")
#: What sources call their periods and places.
PERIODS = {"yearly": "/year", "annual": "/year", "year": "/year", "monthly": "/month", "month": "/month", "weekly": "/week", "daily": "/day", "hourly": "/hour", "hour": "/hour"}
REMOTE, ABROAD, UKRAINE = "віддалено", "за кордоном", "Україна"
DOU_COUNTRIES = {
    "Польща": "Poland", "Португалія": "Portugal", "Німеччина": "Germany", "Іспанія": "Spain", "Кіпр": "Cyprus", "Болгарія": "Bulgaria", "Чехія": "Czechia", "Румунія": "Romania", "Естонія": "Estonia", "Литва": "Lithuania",
    "Латвія": "Latvia", "Нідерланди": "Netherlands", "Великобританія": "United Kingdom", "США": "USA", "ОАЕ": "UAE", "Грузія": "Georgia", "Молдова": "Moldova", "Словаччина": "Slovakia", "Угорщина": "Hungary", "Франція": "France",
    "Італія": "Italy", "Австрія": "Austria", "Ізраїль": "Israel", "Канада": "Canada", "Швейцарія": "Switzerland", "Мальта": "Malta", "Сербія": "Serbia", "Хорватія": "Croatia",
}
PLACES_SHOWN = 6


def canonical(df: DataFrame, source: str, keep: tuple[str, ...] = (), **cols: Column) -> DataFrame:
    out = {"source": F.lit(source)} | cols
    return df.select(*keep, *[text(out.get(c, F.lit(""))).alias(c) for c in CANONICAL])


def _array(payload: str, schema: str) -> Column:
    """A payload that must be an array: from_json alone would take an object for an array of one."""
    return F.from_json(F.when(F.ltrim(F.col(payload)).startswith("["), F.col(payload)), schema)


def _country(place: Column) -> Column:
    named = M.infer_country(place)
    return F.when(named != "", named).when(place.contains(","), F.trim(F.substring_index(place, ",", -1))).otherwise("")


def _amount(low: Column, high: Column) -> Column:
    a, b = F.when(low != 0, low), F.when(high != 0, high)
    show = lambda c: c.cast("long").cast("string")
    return F.when(a.isNotNull() & b.isNotNull() & (a != b), F.concat(show(a), F.lit("-"), show(b))).otherwise(F.coalesce(show(a), show(b), F.lit("")))


def _salary(low: Column, high: Column, currency: Column, period: Column) -> Column:
    amount, per = _amount(low, high), F.lit("")
    for k, v in PERIODS.items():
        per = F.when(fold(period) == k, v).otherwise(per)
    return F.when(amount == "", "").when(text(currency) != "", F.concat(amount, F.lit(" "), currency, per)).otherwise(F.concat(amount, per))


def greenhouse(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Board payloads {jobs: [...]} with columns payload, company, slug."""
    schema = "jobs ARRAY<STRUCT<title STRING, content STRING, absolute_url STRING, first_published STRING, updated_at STRING, location STRUCT<name STRING>>>"
    j = df.select(*keep, "company", "slug", F.explode(F.from_json("payload", schema)["jobs"]).alias("j")).where(F.col("j").isNotNull()).withColumn("body", clean_text(F.col("j.content")))
    place = strip(F.col("j.location.name"))
    return canonical(
        j, "Company Careers", keep, title=strip(F.col("j.title")), company=F.col("company"), city_region=place, country=_country(place), work_format=M.infer_work_format(F.concat(place, F.lit("\n"), F.col("body"))),
        salary=M.extract_salary(F.lit(""), F.col("body")), url=strip(F.col("j.absolute_url")), date_published=first_nonblank(F.col("j.first_published"), F.col("j.updated_at")), full_text=F.col("body"), note=F.concat(F.lit("ATS: Greenhouse; board: "), F.col("slug")),
    )


def lever(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Board payloads [...]: the body is spread over a description, sections and an addition; the stated workplace counts before the text."""
    schema = "ARRAY<STRUCT<text STRING, hostedUrl STRING, applyUrl STRING, descriptionPlain STRING, description STRING, additionalPlain STRING, additional STRING, lists ARRAY<STRUCT<text STRING, content STRING>>, categories STRUCT<location STRING, commitment STRING>, workplaceType STRING, country STRING, createdAt BIGINT>>"
    j = df.select(*keep, "company", "slug", F.explode(_array("payload", schema)).alias("j")).where(F.col("j").isNotNull())
    sections = F.transform(F.filter(F.coalesce(F.col("j.lists"), F.array()), lambda x: text(x["content"]) != ""), lambda x: F.when(text(x["text"]) != "", F.concat(x["text"], F.lit("\n"), x["content"])).otherwise(x["content"]))
    parts = F.concat(F.array(first_nonblank(F.col("j.descriptionPlain"), F.col("j.description"))), sections, F.array(first_nonblank(F.col("j.additionalPlain"), F.col("j.additional"))))
    j = j.withColumn("body", clean_text(F.array_join(F.filter(parts, lambda x: text(x) != ""), "\n\n")))
    place, kind = strip(F.col("j.categories.location")), fold(strip(F.col("j.workplaceType")))
    form = F.when(kind == "remote", "Remote").when(kind == "hybrid", "Hybrid").when(kind == "onsite", "On-site").otherwise(M.infer_work_format(F.concat(place, F.lit("\n"), F.col("body"))))
    day = F.date_format(F.timestamp_millis(F.col("j.createdAt")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return canonical(
        j, "Company Careers", keep, title=strip(F.col("j.text")), company=F.col("company"), city_region=place, country=first_nonblank(F.col("j.country"), _country(place)), work_format=form, contract_type=strip(F.col("j.categories.commitment")),
        salary=M.extract_salary(F.lit(""), F.col("body")), url=first_nonblank(F.col("j.hostedUrl"), F.col("j.applyUrl")), date_published=day, full_text=F.col("body"), note=F.concat(F.lit("ATS: Lever; board: "), F.col("slug")),
    )


def bamboohr(lists: DataFrame, details: DataFrame, wanted: Callable[[Column], Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """List entries whose title is wanted, with their details (slug, id, payload); a detail's field counts unless blank."""
    item = "id STRING, jobOpeningName STRING, employmentStatusLabel STRING, location STRUCT<city STRING, state STRING, addressCountry STRING>, atsLocation STRUCT<country STRING, state STRING, city STRING>, locationType STRING, datePosted STRING, description STRING, compensation STRING, jobOpeningShareUrl STRING"
    j = lists.select(*keep, "company", "slug", F.explode(F.from_json("payload", f"result ARRAY<STRUCT<{item}>>")["result"]).alias("j")).where(wanted(F.col("j.jobOpeningName")))
    d = details.select(F.col("slug").alias("_s"), F.col("id").alias("_i"), F.from_json("payload", f"result STRUCT<jobOpening STRUCT<{item}>>")["result"]["jobOpening"].alias("o"))
    j = j.join(d, (F.col("slug") == F.col("_s")) & (F.col("j.id") == F.col("_i")), "left")
    f = lambda c: first_nonblank(F.col(f"o.{c}"), F.col(f"j.{c}"))
    j = j.withColumn("body", clean_text(f("description")))
    part = lambda a, b: first_nonblank(F.col(f"o.location.{a}"), F.col(f"j.location.{a}"), F.col(f"o.atsLocation.{b}"), F.col(f"j.atsLocation.{b}"))
    country = part("addressCountry", "country")
    place = F.array_join(F.array_distinct(F.filter(F.array(part("city", "city"), part("state", "state"), country), lambda x: x != "")), ", ")
    kind = f("locationType")
    return canonical(
        j, "Company Careers", keep, title=f("jobOpeningName"), company=F.col("company"), city_region=place, country=F.when(country != "", country).otherwise(_country(place)),
        work_format=F.when(kind == "1", "Remote").when(kind == "2", "Hybrid").otherwise(M.infer_work_format(F.concat(place, F.lit("\n"), F.col("body")))), contract_type=f("employmentStatusLabel"),
        salary=F.when(f("compensation") != "", f("compensation")).otherwise(M.extract_salary(F.lit(""), F.col("body"))), url=F.coalesce(F.nullif(f("jobOpeningShareUrl"), F.lit("")), F.concat(F.lit("https://"), F.col("slug"), F.lit(".bamboohr.com/careers/"), F.col("j.id"))),
        date_published=f("datePosted"), full_text=F.col("body"), note=F.concat(F.lit("ATS: BambooHR; board: "), F.col("slug")),
    )


def boards(config: DataFrame) -> DataFrame:
    """Boards with a company, a slug and a supported ATS; the usual host where none is given."""
    ats = fold(strip(F.col("ats")))
    return config.where((strip(F.col("company")) != "") & (strip(F.col("slug")) != "") & ats.isin("greenhouse", "lever", "bamboohr")).select(
        strip(F.col("company")).alias("company"), ats.alias("ats"), strip(F.col("slug")).alias("slug"), F.coalesce(F.nullif(strip(F.col("host")), F.lit("")), F.lit("api.lever.co")).alias("host")
    )


def remoteok(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    schema = "ARRAY<STRUCT<position STRING, company STRING, location STRING, description STRING, url STRING, apply_url STRING, date STRING, salary_min BIGINT, salary_max BIGINT>>"
    j = df.select(*keep, F.explode(_array("payload", schema)).alias("j")).where(text(F.col("j.position")) != "").withColumn("body", clean_text(F.col("j.description")))
    amount, place = _amount(F.col("j.salary_min"), F.col("j.salary_max")), strip(F.col("j.location"))
    return canonical(
        j, "RemoteOK", keep, title=strip(F.col("j.position")), company=strip(F.col("j.company")), city_region=place, country=M.infer_country(place), work_format=F.lit("Remote"),
        salary=F.when(amount != "", F.concat(amount, F.lit(" USD"))).otherwise(M.extract_salary(F.lit(""), F.col("body"))), url=first_nonblank(F.col("j.url"), F.col("j.apply_url")), date_published=F.col("j.date"), full_text=F.col("body"), note=F.lit("RemoteOK public API"),
    )


def jobicy(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    schema = "jobs ARRAY<STRUCT<url STRING, jobTitle STRING, companyName STRING, jobGeo STRING, jobDescription STRING, pubDate STRING, salaryMin BIGINT, salaryMax BIGINT, salaryCurrency STRING, salaryPeriod STRING>>"
    j = df.select(*keep, F.explode(F.from_json("payload", schema)["jobs"]).alias("j")).where(text(F.col("j.jobTitle")) != "")
    place = strip(F.col("j.jobGeo"))
    return canonical(
        j, "Jobicy", keep, title=strip(F.col("j.jobTitle")), company=strip(F.col("j.companyName")), city_region=place, country=M.infer_country(place), work_format=F.lit("Remote"),
        salary=_salary(F.col("j.salaryMin"), F.col("j.salaryMax"), F.col("j.salaryCurrency"), F.col("j.salaryPeriod")), url=strip(F.col("j.url")), date_published=F.col("j.pubDate"), full_text=clean_text(F.col("j.jobDescription")), note=F.lit("Jobicy public API"),
    )


def himalayas(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    schema = "jobs ARRAY<STRUCT<title STRING, companyName STRING, guid STRING, applicationLink STRING, description STRING, pubDate BIGINT, locationRestrictions ARRAY<STRING>, employmentType STRING, minSalary BIGINT, maxSalary BIGINT, currency STRING, salaryPeriod STRING>>"
    j = df.select(*keep, F.explode(F.from_json("payload", schema)["jobs"]).alias("j")).where(text(F.col("j.title")) != "")
    places = F.filter(F.transform(F.coalesce(F.col("j.locationRestrictions"), F.array()), strip), lambda x: x != "")
    n, shown = F.size(places), F.array_join(F.slice(places, 1, PLACES_SHOWN), ", ")
    place = F.when(n == 0, "Worldwide").when(n == 1, F.get(places, F.lit(0))).when(n > PLACES_SHOWN, F.concat(shown, F.lit(" (+"), (n - PLACES_SHOWN).cast("string"), F.lit(" more)"))).otherwise(shown)
    return canonical(
        j, "Himalayas", keep, title=strip(F.col("j.title")), company=strip(F.col("j.companyName")), city_region=place, country=F.when(n == 1, F.get(places, F.lit(0))).otherwise(""), work_format=F.lit("Remote"), contract_type=F.col("j.employmentType"),
        salary=_salary(F.col("j.minSalary"), F.col("j.maxSalary"), F.col("j.currency"), F.col("j.salaryPeriod")), url=first_nonblank(F.col("j.guid"), F.col("j.applicationLink")),
        date_published=F.date_format(F.timestamp_seconds(F.col("j.pubDate")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), full_text=clean_text(F.col("j.description")), note=F.lit("Himalayas public API"),
    )


def has_more_pages(payload: Column, page: Column, page_size: int = 20) -> Column:
    got = F.from_json(payload, "jobs ARRAY<STRUCT<title STRING>>, totalCount BIGINT")
    return F.when(got["totalCount"].isNotNull(), page * page_size < got["totalCount"]).otherwise(F.coalesce(F.size(got["jobs"]), F.lit(0)) >= page_size)


_ITEM_TYPE = "title:string,link:string,description:string,pubDate:string,region:string,country:string,type:string,category:array<string>"
_ITEM = "title STRING, link STRING, description STRING, pubDate STRING, region STRING, country STRING, type STRING, category ARRAY<STRING>"


def rss_items(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep.., i: the items of RSS payloads; a malformed document has none."""
    got = F.from_xml("payload", f"channel STRUCT<item ARRAY<STRUCT<{_ITEM}>>>")
    return df.select(*keep, F.explode(got["channel"]["item"]).alias("i"))


def _in_category(keyword: str) -> Column:
    return F.exists(F.coalesce(F.col("i.category"), F.array()), lambda c: fold(strip(c)) == keyword.strip().lower())


def djinni_company(html: Column) -> Column:
    """The first link to a company's page that shows a name; logos link there without one."""
    shown = F.regexp_extract_all(text(html), F.lit(r'(?is)<a\s[^>]*href="[^"]*/jobs/company[^"]*"[^>]*>([^<]*)</a>'), F.lit(1))
    return squeeze(clean_text(F.get(F.filter(shown, lambda x: F.regexp_replace(x, "&nbsp;|&#160;", " ").rlike(r"(?U)\S")), F.lit(0))))


def djinni_countries(html: Column) -> Column:
    """Where candidates may be: of the list entries that name a place, the first with a caption; the office stands in one without."""
    entries = F.regexp_extract_all(text(html), F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1))
    span, caption = r'(?is)<span[^>]*class="(?:[^"]*\s)?location-text(?:\s[^"]*)?"[^>]*>(.*?)</span>', r'(?is)<div[^>]*class="(?:[^"]*\s)?font-size-extra-small(?:\s[^"]*)?"'
    entry = F.get(F.filter(entries, lambda e: e.rlike(span) & e.rlike(caption)), F.lit(0))
    return squeeze(clean_text(F.regexp_replace(F.regexp_extract(entry, span, 1), r"<[^>]*>", " ")))


def djinni(df: DataFrame, keyword: str, details: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Items of the category that was asked for; a feed (one payload) with items but none of the category gives none, and an error
    (feed_errors). Company and candidates' countries (city_region) come from detail pages (link, html) where there are any; without a page
    the company is the first bold text, and there are no countries."""
    i = rss_items(df, keep).where(_in_category(keyword) & (strip(F.col("i.link")) != ""))
    i = i.withColumn("body", clean_text(F.col("i.description"))).withColumn("strong", clean_text(F.regexp_extract(text(F.col("i.description")), r"<strong>([^<]{2,80})</strong>", 1)))
    link = strip(F.col("i.link"))
    company, place = F.col("strong"), F.lit("")
    if details is not None:
        pages = details.select(strip(F.col("link")).alias("_l"), djinni_company(F.col("html")).alias("_c"), djinni_countries(F.col("html")).alias("_p")).groupBy("_l").agg(F.max("_c").alias("_c"), F.max("_p").alias("_p"))
        i = i.join(pages, link == F.col("_l"), "left")
        company, place = first_nonblank(F.col("_c"), F.col("strong")), text(F.col("_p"))
    return canonical(
        i, "Djinni", keep, title=clean_text(F.col("i.title")), company=company, city_region=place, country=F.lit("Ukraine"), work_format=M.infer_work_format(F.col("body")), salary=M.extract_salary(F.lit(""), F.col("body")), url=link,
        date_published=strip(F.col("i.pubDate")), full_text=F.col("body"),
    )


def feed_errors(df: DataFrame, keyword: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each feed that has items but none of the category: it ignores its filter. keep.., items, message."""
    got = F.coalesce(F.from_xml("payload", f"channel STRUCT<item ARRAY<STRUCT<{_ITEM}>>>")["channel"]["item"], F.array().cast(f"array<struct<{_ITEM_TYPE}>>"))
    hit = lambda i: F.exists(F.coalesce(i["category"], F.array()), lambda c: fold(strip(c)) == keyword.strip().lower())
    feeds = df.select(*keep, got.alias("got")).where((F.size("got") > 0) & ~F.exists("got", hit))
    return feeds.select(*keep, F.size("got").cast("long").alias("items"), F.format_string(f"none of %d items is of category {keyword.strip()}: the feed ignores its filter", F.size("got")).alias("message"))


def malformed(df: DataFrame, source: str) -> DataFrame:
    """(payload, path) -> path, reason of the payloads that a feed source can't read: not of its format, or without its list."""
    blank = strip(F.col("payload")) == ""
    if source in ("djinni", "dou", "weworkremotely"):
        reason = F.when(F.from_xml("payload", "channel STRUCT<title STRING, item ARRAY<STRUCT<title STRING>>>")["channel"].isNull(), "not an RSS document")
    elif source in ("lever", "remoteok"):
        reason = F.when(F.try_parse_json("payload").isNull(), "not JSON").when(~F.ltrim("payload").startswith("["), "not a list of postings")
    elif source in ("greenhouse", "jobicy", "himalayas"):
        reason = F.when(F.try_parse_json("payload").isNull(), "not JSON").when(F.from_json("payload", "jobs ARRAY<STRING>")["jobs"].isNull(), "no list of postings")
    else:
        raise ValueError(f"{source} has no payloads of its own to be checked")
    return df.select("path", F.when(F.col("payload").isNull() | blank, "empty").otherwise(reason).alias("reason")).where("reason IS NOT NULL")


_MONEY = r"(?iU)^(?:\$|€|£)?\s?\d[\d\s]*(?:[–-]\s?\d[\d\s]*)?\s?(?:\$|€|£|грн|USD|EUR)?$"


def dou_title(c: Column) -> Column:
    """Struct (title, company, salary, places) of "Title в Company[, salary][, place...]", split at the last " в "."""
    parts = F.regexp_extract(c, r"(?s)^(.*) в (.*)$", 2)
    tokens = F.filter(F.transform(F.split(parts, ","), strip), lambda x: x != "")
    money = lambda x: x.rlike(_MONEY)
    place = lambda x: x.isin(REMOTE, ABROAD, UKRAINE) | (x.rlike(r"^\p{Lu}") & ~x.rlike(r"\d") & (F.size(F.split(x, r"\s+")) <= 4))
    rest = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    first = F.array_position(F.transform(rest, lambda x: money(x) | place(x)), F.lit(True)).cast("int")
    owners = F.concat(F.slice(tokens, 1, 1), F.when(first == 0, rest).otherwise(F.slice(rest, 1, F.greatest(first - 1, F.lit(0)))))
    after = F.when(first == 0, F.array().cast("array<string>")).otherwise(F.slice(rest, F.greatest(first, F.lit(1)), F.size(rest)))
    salary = F.coalesce(F.get(F.filter(after, money), F.lit(0)), F.lit(""))
    at = F.array_position(F.transform(after, money), F.lit(True)).cast("int")
    places = F.filter(after, lambda x, i: i != at - 1)
    has = c.contains(" в ")
    return F.struct(
        F.when(has, strip(F.regexp_extract(c, r"(?s)^(.*) в (.*)$", 1))).otherwise(c).alias("title"), F.when(has, F.array_join(owners, ", ")).otherwise("").alias("company"),
        F.when(has, salary).otherwise("").alias("salary"), F.when(has, places).otherwise(F.array().cast("array<string>")).alias("places"),
    )


def _dou_country(places: Column) -> Column:
    named = F.filter(places, lambda x: ~x.isin(REMOTE, ABROAD))
    land = lambda x: strip(F.regexp_extract(x, r"^[^()]+?\s*\(([^()]+)\)$", 1))
    abroad = lambda x: (land(x) != "") & ~land(x).endswith("обл.")
    names = F.create_map(*[F.lit(v) for kv in DOU_COUNTRIES.items() for v in kv])
    first = land(F.get(named, F.lit(0)))
    return F.when(F.size(named) == 0, "").when(F.exists(named, lambda x: ~abroad(x)), "Ukraine").otherwise(F.coalesce(names[first], first))


def dou(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    i = rss_items(df, keep).withColumn("raw", clean_text(F.col("i.title"))).withColumn("t", dou_title(F.col("raw"))).where(F.col("t.title").rlike("(?iu)analy|аналіт|аналит"))
    places = F.col("t.places")
    form = F.when(F.array_contains(places, REMOTE), "Remote").when(F.exists(places, lambda x: ~x.isin(ABROAD, UKRAINE)), "On-site").otherwise("Unknown")
    return canonical(
        i, "DOU", keep, title=F.col("t.title"), company=F.col("t.company"), city_region=F.array_join(places, ", "), country=_dou_country(places), work_format=form, salary=F.when(F.col("t.salary") != "", F.concat("t.salary", F.lit("/month"))).otherwise(""),
        url=F.regexp_replace(strip(F.col("i.link")), r"[?#].*$", ""), date_published=strip(F.col("i.pubDate")), full_text=clean_text(F.col("i.description")), note=F.lit("DOU RSS"),
    )


def weworkremotely(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    i = rss_items(df, keep).withColumn("body", clean_text(F.col("i.description"))).withColumn("t", clean_text(F.col("i.title")))
    t = F.col("t")
    return canonical(
        i, "We Work Remotely", keep, title=F.when(t.contains(": "), strip(F.regexp_extract(t, r"(?s)^.*?: (.*)$", 1))).otherwise(strip(t)), company=strip(F.regexp_extract(t, r"(?s)^(.*?): ", 1)),
        city_region=first_nonblank(F.col("i.region"), F.col("i.country")), country=strip(F.col("i.country")), work_format=F.lit("Remote"), contract_type=strip(F.col("i.type")), salary=M.extract_salary(F.lit(""), F.col("body")),
        url=strip(F.col("i.link")), date_published=strip(F.col("i.pubDate")), full_text=F.col("body"), note=F.lit("We Work Remotely RSS"),
    )


_POSTING = "`@type` STRING, title STRING, description STRING, datePosted STRING, employmentType STRING, jobLocationType STRING, hiringOrganization STRUCT<name STRING>, jobLocation ARRAY<STRUCT<address STRUCT<addressLocality STRING, addressRegion STRING, addressCountry STRING>>>, baseSalary STRUCT<currency STRING, value STRUCT<minValue STRING, maxValue STRING, unitText STRING>>"


def json_ld(html: Column) -> Column:
    """The first JobPosting among a page's ld+json scripts, each an object or a list; a single place counts as a list of one."""
    scripts = F.regexp_extract_all(text(html), F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    several = lambda s: F.regexp_replace(s, r'("jobLocation"\s*:\s*)(\{(?:[^{}]|\{[^{}]*\})*\})', "$1[$2]")
    parsed = F.flatten(F.transform(scripts, lambda s: F.coalesce(F.from_json(F.when(F.trim(several(s)).startswith("["), several(s)).otherwise(F.concat(F.lit("["), several(s), F.lit("]"))), f"ARRAY<STRUCT<{_POSTING}>>"), F.array().cast(f"array<struct<{_POSTING.replace(' STRUCT<', ': STRUCT<').replace(' ARRAY<', ': ARRAY<').replace(' STRING', ': STRING')}>>"))))
    return F.get(F.filter(parsed, lambda p: p["@type"] == "JobPosting"), F.lit(0))


#: Where pages without structured data show their fields, first choice first.
LINKEDIN_FIELDS = {
    "title": ("h1", "[class=top-card-layout__title]", "[class=jobs-unified-top-card__job-title]"), "company": ("a[href*=/company/]", "[class=topcard__org-name-link]"),
    "place": ("[class=topcard__flavor--bullet]", "[class=job-details-jobs-unified-top-card__tertiary-description-container]"), "posted": ("time", "[class=posted-time-ago__text]"),
    "body": ("[id^=JobDetails_AboutTheJob_]", "[class=jobs-description-content__text]", "[class=show-more-less-html__markup]", "div[class*=description]"), "tag": ("title",),
}
WTTJ_FIELDS = {
    "title": ("h1", "[data-testid=job-title]"), "company": ("[data-testid=job-company-name]", "a[href*=/companies/]"), "place": ("[data-testid=job-location]",), "body": ("body",), "tag": ("title",),
}


def _structured(df: DataFrame, fields: dict, keep: tuple[str, ...]) -> DataFrame:
    """keep.., url, j (structured data, or null), e (texts of the page's elements), told (pay), places (of structured data), lands."""
    p = df.select(*keep, "url", json_ld(F.col("html")).alias("j"), chosen_texts(F.col("html"), fields).alias("e"))
    none = "array<struct<address: struct<addressLocality: string, addressRegion: string, addressCountry: string>>>"
    address = lambda x: F.array_join(F.array_distinct(F.filter(F.array(*[strip(x["address"][c]) for c in ("addressLocality", "addressRegion", "addressCountry")]), lambda v: v != "")), ", ")
    spots = F.coalesce("j.jobLocation", F.array().cast(none))
    some = lambda f: F.array_join(F.array_distinct(F.filter(F.transform(spots, f), lambda v: v != "")), " / ")
    pay = "j.baseSalary.value."
    told = M.salary_structured(F.col(pay + "minValue"), F.col(pay + "maxValue"), F.col("j.baseSalary.currency"), F.col(pay + "unitText"))
    return p.select("*", told.alias("told"), some(address).alias("places"), some(lambda x: strip(x["address"]["addressCountry"])).alias("lands"))


def linkedin_pages(df: DataFrame, keep: tuple[str, ...] = (), now: Column | None = None) -> DataFrame:
    """Pages (url, html): structured data alone where there is any, else the page's elements, and its title for what these lack. A place that
    neither tells may stand in the text; "2 days ago" becomes a day, counted from now."""
    c, has = F.col, F.col("j").isNotNull()
    p = _structured(df, LINKEDIN_FIELDS, keep).withColumn("body", without_upsell(F.when(has, clean_text(c("j.description"))).otherwise(c("e.body"))))
    p = p.withColumn("t", M.title_tag(c("e.tag"))).withColumn("place", first_nonblank(F.when(has, c("places")).otherwise(squeeze(c("e.place"))), M.location_from_text(c("body"))))
    form = F.when(c("j.jobLocationType") == "TELECOMMUTE", "Remote").otherwise(M.infer_work_format(F.when(has, F.concat("place", F.lit("\n"), "body")).otherwise(c("body"))))
    own = lambda data, *shown: F.when(has, strip(c(data))).otherwise(first_nonblank(*shown))
    return canonical(
        p, "LinkedIn", keep, title=own("j.title", squeeze(c("e.title")), c("t.title")), company=own("j.hiringOrganization.name", squeeze(c("e.company")), c("t.company")), city_region=c("place"), country=_country(c("place")), work_format=form,
        contract_type=c("j.employmentType"), salary=M.extract_salary(F.when(has, c("told")).otherwise(""), c("body")), url=c("url"), date_published=F.when(has, c("j.datePosted")).otherwise(M.relative_date(squeeze(c("e.posted")), F.current_timestamp() if now is None else now)), full_text=c("body"),
    )


def wttj_pages(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pages (url, html): each field from structured data, else from the page's elements; the format of work is read from the whole page."""
    c = F.col
    p = _structured(df, WTTJ_FIELDS, keep).withColumn("place", first_nonblank(c("places"), squeeze(c("e.place"))))
    land = first_nonblank(c("lands"), F.when(c("place").contains(","), strip(F.substring_index("place", ",", -1))))
    return canonical(
        p, "Welcome to the Jungle", keep, title=first_nonblank(strip(c("j.title")), squeeze(c("e.title"))), company=first_nonblank(strip(c("j.hiringOrganization.name")), squeeze(c("e.company"))), city_region=c("place"), country=land,
        work_format=M.infer_work_format(c("e.body")), contract_type=c("j.employmentType"), salary=M.extract_salary(c("told"), c("e.body")), url=c("url"), date_published=c("j.datePosted"), full_text=first_nonblank(clean_text(c("j.description")), c("e.body")),
    )


def detail_pages(df: DataFrame, source: str, cut: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """Pages (url, html) of boards without structured data: heading, and all text up to what names other postings."""
    p = df.select(*keep, "url", clean_text(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)).alias("h1"), M.cut_at(clean_text(F.col("html")), cut).alias("body") if cut else clean_text(F.col("html")).alias("body"))
    return canonical(p, source, keep, title=F.col("h1"), country=F.lit("Ukraine"), work_format=M.infer_work_format(F.col("body")), salary=M.extract_salary(F.lit(""), F.col("body")), url=F.col("url"), full_text=F.col("body"))


def table_rows(df: DataFrame) -> DataFrame:
    """(headers array, cells array of (text, href)) -> row map: a link counts before its text; missing cells are blank."""
    value = lambda i: F.coalesce(F.nullif(F.get("cells", i)["href"], F.lit("")), F.get("cells", i)["text"], F.lit(""))
    return df.select("*", F.map_from_arrays("headers", F.transform(F.sequence(F.lit(0), F.size("headers") - 1), value)).alias("row"))


#: name -> function over landed payloads.
REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "greenhouse": greenhouse, "lever": lever, "bamboohr": bamboohr, "remoteok": remoteok, "jobicy": jobicy, "himalayas": himalayas, "djinni": djinni, "dou": dou, "weworkremotely": weworkremotely,
    "linkedin": linkedin_pages, "wttj": wttj_pages, "work_ua": lambda df, **k: detail_pages(df, "Work.ua", **k), "robota_ua": lambda df, **k: detail_pages(df, "Robota.ua", **k),
}


def landed(spark: SparkSession, path: str) -> DataFrame:
    """One row for each landed file: payload, path."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("path"))
