"""Scalar functions over a posting: terms, money, places, dates, classes. All are Column to Column and stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .text import any_of, fold, found, holds, joined, let, phrase, split_list, squeeze, strip, text, word_list

NUMBER = r"(?<![\d.,])(\d+(?:[.,]\d+)?)"
_YEARS_EXP = rf"(?!\d+-year\b){NUMBER}\s*(?:\+|or\s+more|to|[-–—])?\s*(\d+(?:[.,]\d+)?)?\s*\+?\s*(?:years?|ans?|ann[io]|años)\b"
_YEARS_EXP_UK_RU = rf"{NUMBER}\s*(?:[-–—]\s*(\d+(?:[.,]\d+)?))?\s*х?\+?\s*(?:рок(?:и|ів|у)?|рік|лет|года?)"
_YEARS_FLOOR = rf"{NUMBER}\s*(?:[-–—]|to)\s*(\d+(?:[.,]\d+)?)\s*years?|{NUMBER}\+?\s*(?:or\s+more\s+)?years?"
_FLOOR_WORDS = r"experience|expérience|expertise|background|track record"
_AGE_BEFORE = r"(?:\b(?:over|past|last|nearly|almost)|\bmore\s+than|вже|уже|понад|более)\s*$"
_AGE_AFTER = r"^\W*(?:ago\b|on\s+the\s+market|на\s+ринку|на\s+рынке)"
#: What must stand after a digit for any of the patterns above to match; most texts fail here.
_MAYBE_YEARS = r"\p{Nd}[^\p{L}]*(?:or[^\p{L}]+more[^\p{L}]*|to[^\p{L}]*|х[^\p{L}]*)?(?:year|an|año|рок|рік|лет|год)"
_STILL_EXPERIENCE = r"^\s*(?:of\s+)?(?:\w+\s+){0,2}?(?:experience|expérience|досвід|опыт)"


def folded_text(title: Column, body: Column) -> Column:
    return fold(F.concat(text(title), F.lit("\n"), text(body)))


# --- terms and levels ------------------------------------------------------------------------------------------------


def infer_work_format(c: Column) -> Column:
    return let(
        fold(c),
        lambda t: F.when(holds(t, R.HYBRID), "Hybrid")
        .when(holds(t, R.REMOTE_FIRST) & holds(t, R.IN_PERSON), "Hybrid")
        .when(holds(t, R.REMOTE), "Remote")
        .when(holds(t, R.ONSITE) | holds(t, R.AT_OFFICE), "On-site")
        .otherwise("Unknown"),
    )


def _first(cases, otherwise: str) -> Column:
    """CASE over (value, condition)."""
    out = F
    for value, condition in cases:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def classify_role(folded: Column) -> Column:
    return let(folded, lambda t: _first([(family, any_of(t, words)) for family, words in R.ROLES], "Other"))


def _with_context(t: Column, pattern: str, before: int, after: int, groups: int) -> Column:
    """Array of (before, match groups.., after) for every match of a pattern that starts with a digit, in order."""
    around = rf"(?Us)(?=\d)(?<=(^.{{0,{before - 1}}}|.{{{before}}}))(?:{pattern})(?=(.{{0,{after}}}))"
    parts = [F.regexp_extract_all(t, F.lit(around), F.lit(i)).alias(n) for i, n in [(1, "before"), *[(i + 2, f"g{i}") for i in range(groups)], (groups + 2, "after")]]
    return F.arrays_zip(*parts)


def _number(c: Column) -> Column:
    return F.coalesce(F.replace(c, F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))


def _company_age(m: Column) -> Column:
    return ~found(m["after"], _STILL_EXPERIENCE) & (found(F.right(m["before"], F.lit(30)), _AGE_BEFORE) | found(m["after"], _AGE_AFTER))


def experience_years(folded: Column) -> Column:
    """Struct (low, high) of the first plausible requirement of years, as text with a dot; blanks without one."""

    def first(t: Column, pattern: str) -> Column:
        hits = F.filter(_with_context(t, pattern, 30, 40, 2), lambda m: (_number(m["g0"]) <= R.MOST_YEARS) & (_number(m["g1"]) <= R.MOST_YEARS) & ~_company_age(m))
        return F.get(hits, F.lit(0))

    dot = lambda c: F.coalesce(F.replace(c, F.lit(","), F.lit(".")), F.lit(""))
    hit = let(folded, lambda t: F.when(t.rlike(_MAYBE_YEARS), F.coalesce(first(t, _YEARS_EXP), first(t, _YEARS_EXP_UK_RU))))
    return let(hit, lambda h: F.struct(dot(h["g0"]).alias("low"), F.coalesce(F.nullif(dot(h["g1"]), F.lit("")), dot(h["g0"])).alias("high")))


def max_years(folded: Column) -> Column:
    """The highest floor of experience mentioned with a word of experience within 40 characters."""

    def floors(t: Column) -> Column:
        hits = F.filter(
            _with_context(t, _YEARS_FLOOR, 40, 40, 3),
            lambda m: (found(F.concat(m["before"], m["g0"], m["g1"], m["g2"], F.lit(" "), m["after"]), _FLOOR_WORDS)) & ~_company_age(m),
        )
        return F.array_max(F.filter(F.transform(hits, lambda m: _number(F.coalesce(F.nullif(m["g0"], F.lit("")), m["g2"]))), lambda x: x <= R.MOST_YEARS))

    return F.coalesce(let(folded, lambda t: F.when(t.contains("year") & t.rlike(_MAYBE_YEARS), floors(t))), F.lit(0.0))


def classify_seniority(title: Column, body: Column, low_years: Column) -> Column:
    years = _number(low_years)
    by_title = let(fold(title), lambda t: _first([(level, found(t, pattern)) for level, pattern in R.TITLE_LEVELS], ""))
    by_text = let(
        fold(body),
        lambda b: F.when(holds(b, R.TEXT_JUNIOR), "Junior")
        .when((years >= 5) | holds(b, R.TEXT_SENIOR), "Senior")
        .when((years >= 3) | holds(b, R.TEXT_MIDDLE), "Mid-level")
        .otherwise("Unknown"),
    )
    return F.coalesce(F.nullif(by_title, F.lit("")), by_text)


def skills(folded: Column, rules=R.SKILLS) -> Column:
    """Names of the skills a text holds, in the order of the rules: one projection, one scan."""
    return let(folded, lambda t: F.filter(F.array(*[F.when(holds(t, p), F.lit(n)) for n, p in rules]), lambda x: x.isNotNull()))


def required_preferred(folded: Column, rules=R.SKILLS) -> Column:
    """Struct (required, preferred): a skill before the first word of preference is required."""

    def part(t: Column, at: Column) -> Column:
        return F.struct(F.when(at > 0, F.substr(t, F.lit(1), at - 1)).otherwise(t).alias("head"), F.when(at > 0, F.substr(t, at)).otherwise(F.lit("")).alias("tail"))

    def place(t: Column, s: Column, pattern: str) -> Column:
        return F.when(holds(t, pattern), F.when(holds(s["head"], pattern), 1).when(holds(s["tail"], pattern), 2))

    def placed(t: Column, s: Column) -> Column:
        return F.array(*[F.struct(place(t, s, p).alias("at"), F.lit(n).alias("skill")) for n, p in rules])

    def names(hits: Column, at: int) -> Column:
        return F.transform(F.filter(hits, lambda x: x["at"] == at), lambda x: x["skill"])

    cut = lambda t: F.regexp_instr(t, F.lit("(?U)" + R.PREFERRED))
    hits = let(folded, lambda t: let(let(cut(t), lambda at: part(t, at)), lambda s: placed(t, s)))
    return let(hits, lambda h: F.struct(names(h, 1).alias("required"), names(h, 2).alias("preferred")))


def analyze(title: Column, body: Column, city_region: Column, country: Column, salary: Column) -> Column:
    """Struct of the twelve analysis columns; the text is folded once, and every rule reads that."""

    def columns(r: Column) -> Column:
        split, years, place = r["split"], r["years"], r["place"]
        return F.struct(
            r["role"].alias("role_family"), r["role"].alias("role_subcategory"), classify_seniority(title, body, years["low"]).alias("seniority"), years["low"].alias("years_experience_min"),
            years["high"].alias("years_experience_max"), joined(r["skills"]).alias("skills_all"), joined(split["required"]).alias("required_skills"), joined(split["preferred"]).alias("preferred_skills"),
            place["city"].alias("city"), place["region"].alias("region"), salary_usd(salary).alias("salary_usd_equivalent"), F.lit(R.ANALYSIS_NOTE).alias("analysis_note"),
        )

    def parts(t: Column) -> Column:
        return F.struct(
            classify_role(t).alias("role"), experience_years(t).alias("years"), skills(t).alias("skills"), required_preferred(t).alias("split"), split_city_region(city_region, country).alias("place")
        )

    return let(let(folded_text(title, body), parts), columns)


def personal_fit(decision: Column, reason: Column) -> Column:
    d, r = strip(decision), strip(reason)
    return F.when(d == "", "").when((d == R.YES) | (r == ""), d).otherwise(F.concat(d, F.lit(" — "), r))


# --- money -----------------------------------------------------------------------------------------------------------

_SEP = "[    .,]"
_AMOUNT = rf"(?<!\d)(?:\d{{1,3}}(?:{_SEP}\d{{3}})+|\d{{2,}})(?:[,.]\d{{1,2}})?"
_CURRENCY = r"(?:€|EUR|USD|\$|GBP|£|грн\.?|₴|UAH)"
_UNIT = r"(?:/\s*|\s+per\s+|\s+par\s+)(?:hour|heure|year|an|month|mois|day|jour|week|semaine)s?"
SALARY_PATTERNS = (
    rf"{_AMOUNT}(?:(?:\s*[-–—−]\s*|\s+(?:до|to)\s+){_AMOUNT})?\s*{_CURRENCY}(?:\s*{_UNIT})?",
    rf"{_CURRENCY}\s*{_AMOUNT}(?:\s*[-–—−]\s*{_CURRENCY}?\s*{_AMOUNT})?(?:\s*{_UNIT})?",
)


def extract_salary(structured: Column, body: Column) -> Column:
    """What the source states, else the first amount before a currency, else the first one after."""
    hits = [F.nullif(squeeze(F.regexp_extract(text(body), "(?iuU)" + p, 0)), F.lit("")) for p in SALARY_PATTERNS]
    return F.coalesce(F.nullif(strip(structured), F.lit("")), *hits, F.lit(""))


def salary_structured(low: Column, high: Column, currency: Column, unit: Column) -> Column:
    """low-high CUR/unit from the parts of a payload."""
    a, b, cur, u = text(low), text(high), strip(currency), fold(strip(unit))
    amount = F.when((a != "") & (b != "") & (a != b), F.concat(a, F.lit("-"), b)).otherwise(F.when(a != "", a).otherwise(b))
    value = F.trim(F.concat(amount, F.lit(" "), cur))
    return F.when(amount == "", "").when(u != "", F.concat(value, F.lit("/"), u)).otherwise(value)


def salary_amount(token: Column) -> Column:
    """A number whose last separator is decimal if one or two digits follow."""
    compact = F.regexp_replace(token, r"(?U)\s", "")
    decimals = F.regexp_extract(compact, r"[.,](\d{1,2})$", 1)
    whole = F.regexp_replace(F.when(decimals != "", F.regexp_replace(compact, r"[.,]\d{1,2}$", "")).otherwise(compact), "[.,]", "")
    return F.concat(whole, F.when(decimals != "", F.concat(F.lit("."), decimals)).otherwise(F.lit(""))).try_cast("double")


def salary_usd(salary: Column) -> Column:
    t = strip(salary)
    key = F.regexp_replace(F.upper(F.regexp_extract(t, r"(?iu)€|£|₴|\$|USD|EUR|GBP|UAH|ГРН\.?", 0)), r"\.+$", "")
    rate = F.lit(None).cast("double")
    for k, r in R.FX.items():
        if r != 1.0:
            rate = F.when(key == k, F.lit(r)).otherwise(rate)
    tokens = F.regexp_extract_all(t, F.lit(r"(?U)(\d[\d.,\s]*\d|\d)"), F.lit(1))
    usd = F.transform(F.filter(F.transform(tokens, salary_amount), lambda a: a.isNotNull()), lambda a: a * rate)
    least = F.array_min(usd)
    step = F.when(least >= 1000, 100.0).when(least >= 100, 10.0).otherwise(1.0)
    rounded = F.transform(usd, lambda a: F.rint(a / step) * step)
    show = lambda c: F.format_number(c, 0)
    low, high = F.array_min(rounded), F.array_max(rounded)
    value = F.when(low != high, F.concat(show(low), F.lit("-"), show(high))).otherwise(show(low))
    return F.when(rate.isNull() | (F.size(usd) == 0), "").otherwise(F.concat(F.lit("≈"), value, F.lit(" USD")))


# --- places ----------------------------------------------------------------------------------------------------------


def split_city_region(place: Column, country: Column) -> Column:
    """Struct (city, region): parts between commas, the last one dropped if it is the country."""
    parts = split_list(place, ",")
    n = F.size(parts)
    drop = (n > 0) & (strip(country) != "") & (fold(F.get(parts, n - 1)) == fold(strip(country)))
    kept = F.when(drop, F.slice(parts, 1, F.greatest(n - 1, F.lit(0)))).otherwise(parts)
    rest = F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0)))
    return F.struct(F.coalesce(F.get(kept, F.lit(0)), F.lit("")).alias("city"), joined(rest, ", ").alias("region"))


def infer_country(place: Column) -> Column:
    v = strip(place)
    named = F.filter(F.array(*[F.when(found(v, "(?iu)" + phrase(k)), F.lit(k)) for k in R.COUNTRIES]), lambda x: x.isNotNull())
    cities = F.array_distinct(F.filter(F.array(*[F.when(found(v, "(?iu)" + phrase(k)), F.lit(c)) for k, c in R.CITIES]), lambda x: x.isNotNull()))
    return F.when(F.size(named) > 0, joined(named, " / ")).otherwise(joined(cities, " / "))


def location_from_text(body: Column) -> Column:
    return strip(F.regexp_extract(text(body), r"(?imU)^.{0,5}location\s*:\s*(.+)$", 1))


def location_join(*parts: Column) -> Column:
    return joined(F.array_distinct(F.filter(F.array(*[strip(p) for p in parts]), lambda x: x != "")), " / ")


# --- dates -----------------------------------------------------------------------------------------------------------


def parse_date(c: Column) -> Column:
    """The first ISO day in a text (an invalid one is null for good), else the day of a mail date."""
    t = strip(c)
    iso = F.regexp_extract(t, r"\d{4}-\d{2}-\d{2}", 0)
    mail = F.regexp_extract(t, r"(\d{1,2} [A-Z][a-z]{2} \d{4})", 1)
    return F.when(iso != "", F.try_to_date(iso, "yyyy-MM-dd")).when(mail != "", F.try_to_date(mail, "d MMM yyyy"))


def date_text(c: Column) -> Column:
    t = strip(c)
    return F.when(t.isin("", "NaT", "nan"), "").otherwise(F.regexp_replace(t, " 00:00:00$", ""))


def mark_date(c: Column, today: Column) -> Column:
    """The day that a mark stands for: ISO, or day.month.year, else today."""
    t = date_text(c)
    dotted = F.when(t.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.try_to_date(t, "d.M.yyyy"))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).otherwise(F.coalesce(F.date_format(dotted, "yyyy-MM-dd"), today.cast("string")))


def relative_date(c: Column, reference: Column) -> Column:
    """"3 days ago" in a text becomes the day it means, counted from a timestamp; a month has 30 days."""
    t = text(c)
    pattern = r"(?i)(\d+)\s+(second|minute|hour|day|week|month)s?\s+ago"
    n, unit = F.regexp_extract(t, pattern, 1), F.lower(F.regexp_extract(t, pattern, 2))
    seconds = F.when(unit == "second", 1).when(unit == "minute", 60).when(unit == "hour", 3600).when(unit == "day", 86400).when(unit == "week", 604800).otherwise(2592000)
    day = F.date_format(F.timestamp_seconds(F.unix_timestamp(reference) - n.try_cast("long") * seconds), "yyyy-MM-dd")
    at = F.regexp_instr(t, F.lit(pattern))
    tail = F.substr(t, at + F.length(F.regexp_extract(t, pattern, 0)))
    return F.when(n == "", t).otherwise(F.trim(F.concat(F.substr(t, F.lit(1), at - 1), day, tail)))


def days_between(later: Column, earlier: Column) -> Column:
    """Days as text, blank if a date is unknown."""
    return F.coalesce(F.datediff(later, earlier).cast("string"), F.lit(""))


# --- classes for reports ---------------------------------------------------------------------------------------------


def level_bucket(seniority: Column) -> Column:
    out = F.lit("unknown")
    for name, bucket in reversed(R.LEVELS):
        out = F.when(seniority == name, bucket).otherwise(out)
    return out


def location_bucket(work_format: Column, country: Column) -> Column:
    return F.when(work_format == "Remote", "remote").when(F.lower(strip(country)).isin(*R.EUROPE), "europe").otherwise("other")


def availability(status: Column, body: Column, closed_banners: tuple[str, ...] = R.CLOSED_BANNERS) -> Column:
    """closed for 404, 410 or a banner; active for a page that isn't blank; else unknown."""
    closed = F.coalesce(status.isin(404, 410), F.lit(False)) | let(fold(body), lambda t: any_of(t, closed_banners))
    return F.when(closed, "closed").when((status >= 200) & (status < 400) & (strip(body) != ""), "active").otherwise("unknown")


def _site_availability(url: Column, body: Column, wall: Column, closed_banners: tuple[str, ...], posting_path: str) -> Column:
    """A wall says nothing; then banners; only a posting's own address with a text on it is active."""
    closed = let(fold(body), lambda t: any_of(t, closed_banners))
    return F.when(wall, "unknown").when(closed, "closed").when(fold(url).contains(posting_path) & (strip(body) != ""), "active").otherwise("unknown")


def linkedin_availability(url: Column, body: Column) -> Column:
    wall = let(fold(url), lambda u: any_of(u, R.LINKEDIN_WALL_URLS)) | let(fold(body), lambda t: any_of(t, R.LINKEDIN_WALL_TEXTS))
    return _site_availability(url, body, wall, R.LINKEDIN_CLOSED, "/jobs/view/")


def wttj_availability(url: Column, body: Column) -> Column:
    return _site_availability(url, body, let(fold(url), lambda u: any_of(u, R.WTTJ_WALL_URLS)), R.WTTJ_CLOSED, "/jobs/")


def keep_known_closed(before: Column, now: Column) -> Column:
    return F.when((now == "unknown") & (before == "closed"), "closed").otherwise(now)


def ats_board(note: Column) -> Column:
    """Struct (ats, slug) from a note like "ATS: Greenhouse; board: acme"; null for any other note."""
    pattern = r"(?i)ATS:\s*(Greenhouse|Lever|BambooHR);\s*board:\s*([^;]+)"
    ats = F.lower(F.regexp_extract(text(note), pattern, 1))
    return F.when(ats != "", F.struct(ats.alias("ats"), strip(F.regexp_extract(text(note), pattern, 2)).alias("slug")))


def company_slug(url: Column) -> Column:
    return F.regexp_extract(text(url), r"/companies/([^/?#]+)", 1)


def title_tag(c: Column) -> Column:
    """Struct (title, company) of a page title "T | C | Board"."""
    parts = F.filter(F.transform(F.split(text(c), r"\|"), strip), lambda x: (x != "") & (F.lower(x) != "linkedin"))
    return F.struct(F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("title"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("company"))


def cut_at(c: Column, markers: tuple[str, ...]) -> Column:
    """Text up to the first of the markers that it holds."""
    spots = F.array_min(F.filter(F.array(*[F.instr(c, m) for m in markers]), lambda i: i > 0))
    return F.when(spots.isNull(), c).otherwise(F.regexp_replace(F.substr(c, F.lit(1), spots - 1), r"(?U)\s+$", ""))


def llm_answer(c: Column) -> Column:
    """Struct (fit_score text, reasoning, verdict) of a JSON answer, fences stripped, score kept in 0..100."""
    bare = F.regexp_replace(F.trim(text(c)), r"^```(?:json)?\s*|\s*```$", "")
    got = F.from_json(bare, "fit_score DOUBLE, reasoning STRING, verdict STRING")
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.rint(got["fit_score"]).cast("int")))
    return F.struct(F.coalesce(score.cast("string"), F.lit("")).alias("fit_score"), F.coalesce(got["reasoning"], F.lit("")).alias("fit_reasoning"), F.coalesce(got["verdict"], F.lit("needs_revision")).alias("verdict"))


# --- prompts ---------------------------------------------------------------------------------------------------------


def _posting(title: Column, company: Column, place: Column | None, country: Column | None, work_format: Column | None, seniority: Column | None, body: Column) -> Column:
    parts = [F.lit("Title: "), text(title), F.lit("\nCompany: "), text(company)]
    if place is not None:
        parts += [F.lit("\nLocation: "), text(place), F.lit(" ("), text(country), F.lit(")\nWork format: "), text(work_format)]
    if seniority is not None:
        parts += [F.lit("\nSeniority (rule-based guess, may be wrong): "), text(seniority)]
    return F.concat(*parts, F.lit("\nDescription:\n"), F.left(text(body), F.lit(R.DESCRIPTION_CHARS)))


def _prompt(cv: Column, posting: Column, *more: Column) -> Column:
    return F.concat(F.lit("CANDIDATE CV:\n"), text(cv), F.lit("\n\n---\n\nJOB POSTING:\n"), posting, *more)


def fit_score_prompt(cv: Column, title: Column, company: Column, place: Column, country: Column, work_format: Column, seniority: Column, body: Column) -> Column:
    return _prompt(cv, _posting(title, company, place, country, work_format, seniority, body))


def cv_draft_prompt(cv: Column, title: Column, company: Column, place: Column, country: Column, work_format: Column, body: Column) -> Column:
    return _prompt(cv, _posting(title, company, place, country, work_format, None, body))


def review_prompt(cv: Column, title: Column, company: Column, body: Column, draft: Column) -> Column:
    return _prompt(cv, _posting(title, company, None, None, None, None, body), F.lit("\n\n---\n\nDRAFT TO REVIEW:\n"), text(draft))


# --- filters ---------------------------------------------------------------------------------------------------------


def _query(query: str, category: str = "") -> Column:
    """A phrase as data: what a title must hold, or else the words that must each stand there alone."""
    q = re.sub(r"\s+", " ", query).strip().lower()
    latin = F.array(*[F.lit(w) for w in dict.fromkeys(re.findall(r"[a-z0-9]+", q))]).cast("array<string>")
    return F.struct(F.lit(query).alias("query"), F.lit(category).alias("category"), F.lit(q).alias("phrase"), latin.alias("words"))


def _matching(title: Column, queries: Column) -> Column:
    """Those of an array of queries that match a title, in their order. The title is folded and cut into words once."""
    ready = let(fold(squeeze(title)), lambda t: F.struct(t.alias("text"), word_list(t).alias("words")))

    def hit(t: Column, x: Column) -> Column:
        every = (F.size(x["words"]) > 0) & (F.size(F.array_except(x["words"], t["words"])) == 0)
        return (t["text"] != "") & (x["phrase"] != "") & (t["text"].contains(x["phrase"]) | every)

    return let(ready, lambda t: F.filter(queries, lambda x: hit(t, x)))


def query_matches(query: str, title: Column) -> Column:
    """The phrase is in the title, or each of its Latin words stands there alone."""
    return F.size(_matching(title, F.array(_query(query)))) > 0


def matches_any_query(title: Column, queries) -> Column:
    return F.size(_matching(title, F.array(*[_query(q) for q in queries]))) > 0


def category_matches(title: Column, category: Column, search_query: Column, queries: dict[str, tuple[str, ...]] = R.QUERIES) -> Column:
    """Whether a title matches any phrase of the record's own category; a category without phrases falls back on the phrase it was searched by."""
    phrase_of = lambda c: F.trim(F.regexp_replace(fold(c), r"(?U)\s+", " "))
    searched = F.struct(
        text(search_query).alias("query"), text(category).alias("category"), phrase_of(search_query).alias("phrase"),
        F.array_distinct(F.regexp_extract_all(phrase_of(search_query), F.lit("([a-z0-9]+)"), F.lit(1))).alias("words"),
    )
    known = F.array(*[_query(q, name) for name, phrases in queries.items() for q in phrases])
    own = F.filter(known, lambda x: x["category"] == text(category))
    return F.size(_matching(title, F.when(F.size(own) > 0, own).otherwise(F.array(searched)))) > 0


def first_matching_query(title: Column, queries: dict[str, tuple[str, ...]] = R.QUERIES) -> Column:
    """Struct (query, category) of the first configured phrase that matches, null if none does. The catalogue is an
    array of constants: 49 rows of configuration need no join."""
    found_one = F.get(_matching(title, F.array(*[_query(q, category) for category, phrases in queries.items() for q in phrases])), F.lit(0))
    return let(found_one, lambda x: F.when(x.isNotNull(), F.struct(x["query"].alias("query"), x["category"].alias("category"))))


def is_overqualified(title: Column, body: Column) -> Column:
    marked = let(fold(title), lambda t: F.exists(F.array(*[found(t, phrase(m)) for m in R.TITLE_MARKERS]), lambda x: x))
    return marked | let(fold(body), lambda b: any_of(b, R.TEXT_MARKERS) | (max_years(b) >= R.MIN_YEARS))


def _language(title: Column, body: Column, phrases, words) -> Column:
    """A phrase says so, or enough of the words stand in the text alone (they are looked for only if enough are in it at all)."""

    def said(t: Column) -> Column:
        out = F.lit(False)
        for p in phrases:
            out = out | holds(t, phrase(p.replace("ß", "ss")))
        return out

    def enough(t: Column) -> Column:
        held = sum((t.contains(w).cast("int") for w in words), F.lit(0))
        return (held >= R.WORD_THRESHOLD) & (F.size(F.array_intersect(word_list(t), F.array(*[F.lit(w) for w in words]))) >= R.WORD_THRESHOLD)

    return let(folded_text(title, body), lambda t: said(t) | enough(t))


def requires_french(title: Column, body: Column) -> Column:
    return _language(title, body, R.FRENCH_PHRASES, R.FRENCH_WORDS)


def requires_german(title: Column, body: Column) -> Column:
    return _language(title, body, R.GERMAN_PHRASES, R.GERMAN_WORDS)


def disallowed_format(work_format: Column, formats: tuple[str, ...] = ()) -> Column:
    return fold(strip(work_format)).isin(*[f.lower() for f in formats]) if formats else F.lit(False)


def onsite_in_disallowed(work_format: Column, country: Column) -> Column:
    named = F.lit(False)
    for c in R.NO_OFFICE_COUNTRIES:
        named = named | found(fold(country), phrase(c))
    return fold(strip(work_format)).isin("hybrid", "on-site") & named


def candidates_only_disallowed(places: Column) -> Column:
    parts = F.filter(F.transform(F.split(fold(places), r"(?U),|\bor\b|\band\b"), strip), lambda x: x != "")
    return (F.size(parts) > 0) & F.forall(parts, lambda x: x.isin(*R.NO_OFFICE_COUNTRIES))


def is_low_quality(title: Column, body: Column) -> Column:
    return let(folded_text(title, body), lambda t: any_of(t, R.LOW_QUALITY))


def matches_context(c: Column) -> Column:
    return let(fold(c), lambda t: any_of(t, R.CONTEXT_TERMS))


def is_near_fit(decision: Column, filtered: Column) -> Column:
    return strip(decision).isin(R.YES, R.MAYBE) & (strip(filtered) != R.MARK)


def is_rejected(decision: Column, filtered: Column) -> Column:
    return (strip(decision) == R.NO) | (strip(filtered) == R.MARK)


# --- grouping keys ---------------------------------------------------------------------------------------------------


def normalize_company(c: Column) -> Column:
    """Without brackets, camel case parted, Latin words without legal forms (unless nothing else is left)."""
    t = F.regexp_replace(F.regexp_replace(text(c), r"\([^)]*\)", " "), "(?<=[a-z])(?=[A-Z])", " ")
    tokens = F.regexp_extract_all(fold(t), F.lit("([a-z0-9]+)"), F.lit(1))
    kept = F.filter(tokens, lambda x: ~x.isin(*R.LEGAL_SUFFIXES))
    return joined(F.when(F.size(kept) > 0, kept).otherwise(tokens), " ")


def normalize_title(c: Column) -> Column:
    tokens = F.regexp_extract_all(F.replace(fold(c), F.lit("&"), F.lit(" and ")), F.lit(r"(?U)([\w+#]+)"), F.lit(1))
    return joined(F.filter(tokens, lambda x: ~x.isin("remote", "hybrid")), " ")


def location_tokens(place: Column, country: Column) -> Column:
    tokens = F.regexp_extract_all(fold(F.concat(text(place), F.lit(" "), text(country))), F.lit(r"(?U)([^\W\d_]{3,})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda x: ~x.isin(*R.REGION_WORDS))))


def locations_compatible(a: Column, b: Column, a_blank: Column, b_blank: Column) -> Column:
    one_sided = (a_blank & (F.size(b) > 0)) | (b_blank & (F.size(a) > 0))
    return ~one_sided & ((F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b))


def reasons(c: Column) -> Column:
    return let(fold(c), lambda t: F.filter(F.array(*[F.when(any_of(t, words), F.lit(n)) for n, words in R.REASONS.items()]), lambda x: x.isNotNull()))


def cert_near(pattern: str) -> str:
    return rf"{R.CERT_WORD}[^\n]{{0,{R.CERT_SPAN}}}?(?:{pattern})|(?:{pattern})[^\n]{{0,{R.CERT_SPAN}}}?{R.CERT_WORD}"


