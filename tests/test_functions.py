"""Scalar functions on phrases that job postings use."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from jobloom.functions import ids as I
from jobloom.functions import metadata as M
from jobloom.functions.html import clean_text
from jobloom.functions import rules as R
from jobloom.functions.text import fold, needles


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items())) if values else spark.range(1)
    return frame.select(column.alias("x")).collect()[0]["x"]


def many(spark, column, cases):
    frame = spark.createDataFrame([(i, *(c if isinstance(c, tuple) else (c,))) for i, (c, _) in enumerate(cases)], "i int, a string" + ", b string" * isinstance(cases[0][0], tuple))
    got = {r["i"]: r["x"] for r in frame.select("i", column.alias("x")).collect()}
    return [got[i] for i in range(len(cases))]


def check(spark, column, cases):
    assert many(spark, column, cases) == [want for _, want in cases]


def test_url(spark):
    check(spark, I.normalize_url(F.col("a")), [
        ("HTTPS://Example.com/jobs/1/?utm_source=x&b=2&a=1#top", "https://example.com/jobs/1?a=1&b=2"), ("https://example.com", "https://example.com/"), ("https://example.com/?trk=1&Gclid=2", "https://example.com/"),
        ("  Not a URL ", "not a url"), ("", ""), (None, ""), ("https://e.com/a?x=&y=a%20b+c~*", "https://e.com/a?x=&y=a+b+c~%2A"), ("https://e.com/a?bad=%zz", "https://e.com/a?bad=%25zz"),
    ])


def test_identity(spark):
    key = I.dedup_key(F.lit("LinkedIn"), F.col("a"), F.lit("Acme  Inc"), F.lit("Data Analyst"), F.col("b"))
    check(spark, key, [(("https://e.com/1/?utm_medium=z", "x"), "linkedin|url|https://e.com/1"), (("", "Paris "), "linkedin|fallback|acme inc|data analyst|paris")])
    assert one(spark, I.source_slug(F.col("a")), a="Company Careers!") == "company_careers"
    assert one(spark, I.source_slug(F.col("a")), a="!!") == "job"
    assert one(spark, fold(F.col("a")), a="Straße") == "strasse"


def test_work_format(spark):
    check(spark, M.infer_work_format(F.col("a")), [
        ("Fully remote", "Remote"), ("Hybrid, 3 days a week in office", "Hybrid"), ("Remote-first with quarterly offsites", "Hybrid"), ("at our London office", "On-site"), ("at our home office", "Unknown"),
        ("Київ, офіс / гібрид", "Hybrid"), ("віддалено", "Remote"), ("в офісі", "On-site"), ("", "Unknown"), (None, "Unknown"),
    ])


def test_salary(spark):
    check(spark, M.extract_salary(F.lit(""), F.col("a")), [
        ("Pay: $80,000 - $95,000 per year", "$80,000 - $95,000 per year"), ("45 000 - 55 000 EUR", "45 000 - 55 000 EUR"), ("від 40 000 до 45 000 грн", "40 000 до 45 000 грн"), ("50 000−75 000 грн", "50 000−75 000 грн"), ("none", ""),
    ])
    check(spark, M.salary_usd(F.col("a")), [("30.000,00 €", "≈32,400 USD"), ("30 EUR/month", "≈32 USD"), ("900-1000 EUR", "≈970-1,080 USD"), ("$100", ""), ("50 000 грн", "≈1,200 USD"), ("", ""), ("100 CHF", "")])
    check(spark, M.salary_amount(F.col("a")), [("30,000.50", 30000.5), ("1.234", 1234.0), ("12,5", 12.5)])


def test_years(spark):
    years = lambda c: F.concat_ws("-", M.experience_years(fold(c))["low"], M.experience_years(fold(c))["high"])
    check(spark, years(F.col("a")), [
        ("3-5 years of experience", "3-5"), ("5+ years", "5-5"), ("for over 15 years. 2 years of experience", "2-2"), ("founded in 2017 and", "-"), ("150+ years of combined experience", "-"), ("1,5 роки досвіду", "1.5-1.5"),
        ("a 4-year degree", "-"), ("3 ans d'expérience", "3-3"), ("0–2 years", "0-2"), ("ми на ринку вже 13 років", "-"), ("over 5 years of experience", "5-5"),
    ])
    check(spark, M.max_years(fold(F.col("a"))), [("3-5 years of experience and 2 years experience", 3.0), ("founded 50 years ago", 0.0), ("4 years", 0.0)])


def test_seniority(spark):
    level = M.classify_seniority(F.col("a"), F.col("b"), M.experience_years(M.folded_text(F.col("a"), F.col("b")))["low"])
    check(spark, level, [
        (("Junior Analyst", "report to the manager"), "Junior"), (("Head of Data", ""), "Manager"), (("Analyst", "we're hiring a senior analyst"), "Senior"), (("Analyst", "6 years of experience"), "Senior"),
        (("Analyst", "3 years of experience"), "Mid-level"), (("Analyst", "senior stakeholders"), "Unknown"), (("Аналітик", "стажер"), "Junior"),
    ])


def test_skills(spark):
    text = fold(F.col("a"))
    joined = F.array_join(M.skills(text), "; ")
    check(spark, joined, [("SQL, Python and R.", "SQL; Python; R"), ("NoSQL", ""), ("PySpark, Power  BI", "Power BI; Spark"), ("rust", "")])
    parts = M.required_preferred(text)
    check(spark, F.concat_ws("|", F.array_join(parts["required"], ";"), F.array_join(parts["preferred"], ";")), [("SQL needed. Nice to have: Tableau, SQL", "SQL|Tableau"), ("Python a plus", "Python|")])


def test_places(spark):
    check(spark, M.infer_country(F.col("a")), [("Paris, France", "France"), ("London", "United Kingdom"), ("Remote - USA or Canada", "USA / Canada"), ("Ukraine/Poland", "Poland / Ukraine"), ("Nowhere", ""), ("", "")])
    split = M.split_city_region(F.col("a"), F.col("b"))
    check(spark, F.concat_ws("|", split["city"], split["region"]), [(("Paris, Ile-de-France, FR", "fr"), "Paris|Ile-de-France"), (("Kyiv", "Kyiv"), "|"), (("", ""), "|"), (("A, B, C", ""), "A|B, C")])
    check(spark, M.location_from_text(F.col("a")), [("x\n🌐 Location: Remote \ny", "Remote"), ("please see the location: x", "")])


def test_dates(spark):
    check(spark, M.parse_date(F.col("a")), [("2026-09-19T04:02:55+00:00", dt.date(2026, 9, 19)), ("Reposted 2026-10-03", dt.date(2026, 10, 3)), ("Fri, 02 Oct 2026 15:31:05", dt.date(2026, 10, 2)), ("2026-02-30", None), ("soon", None)])
    check(spark, M.relative_date(F.col("a"), F.lit("2026-10-06 12:00:00").cast("timestamp")), [("Reposted 3 days ago", "Reposted 2026-10-03"), ("1 month ago", "2026-09-06"), ("today", "today")])
    check(spark, M.mark_date(F.col("a"), F.lit("2026-11-01")), [("Да", "2026-11-01"), ("05.10.2026", "2026-10-05"), ("31.02.2026", "2026-11-01"), ("2026-09-30 00:00:00", "2026-09-30")])


def test_filters(spark):
    check(spark, M.is_overqualified(F.col("a"), F.col("b")), [(("Senior Analyst", ""), True), (("Analyst", "PhD"), True), (("Analyst", "3+ years of experience"), True), (("Analyst", "2 years of experience"), False), (("Leading", ""), False)])
    check(spark, M.requires_french(F.col("a"), F.col("b")), [(("Analyste H/F", ""), True), (("English/French", ""), False), (("", "vous rejoindre notre"), True), (("", "vous vous vous"), False)])
    check(spark, M.requires_german(F.col("a"), F.col("b")), [(("Analyst (m/w/d)", ""), True), (("", "fließend Deutsch"), True), (("", "und und"), False)])
    check(spark, M.onsite_in_disallowed(F.col("a"), F.col("b")), [(("Hybrid", "Ukraine (Kyiv)"), True), (("Remote", "Ukraine"), False), (("On-site", "Indiana"), False)])
    check(spark, M.candidates_only_disallowed(F.col("a")), [("Ukraine", True), ("Ukraine, India", True), ("Countries of Europe or Ukraine", False), ("", False)])
    check(spark, M.query_matches("Data Analyst", F.col("a")), [("Senior  data   analyst", True), ("Analyst, Data", True), ("Database Analyst", False), ("", False)])
    assert one(spark, M.query_matches("аналітик даних", F.col("a")), a="Старший аналітик даних") is True


def test_grouping_keys(spark):
    check(spark, M.normalize_company(F.col("a")), [("Cumberland (DRW)", "cumberland"), ("CollectlyInc", "collectly"), ("LLC", "llc"), ("", "")])
    check(spark, M.normalize_title(F.col("a")), [("BI & Data Analyst (Remote)", "bi and data analyst"), ("C++/C# Dev", "c++ c# dev")])
    check(spark, F.array_join(M.location_tokens(F.col("a"), F.col("b")), " "), [(("Remote - Kyiv", "Ukraine"), "kyiv ukraine"), (("Europe", ""), "")])


@pytest.mark.parametrize("raw, want", [(None, ""), ("a &amp; b", "a & b"), ("<p>One</p><ul><li>two  x</li></ul>", "One\ntwo x"), ("1 < 2", "1 < 2"), ("<script>x()</script><b>y</b>", "y")])
def test_html(spark, raw, want):
    assert one(spark, clean_text(F.col("a")), a=raw) == want


def test_availability(spark):
    a, b = F.col("a"), F.col("b")
    for m in R.CLOSED_BANNERS:
        check(spark, M.availability(F.lit(200), a), [(f"x {m.upper()} y", "closed")])
    check(spark, M.availability(F.lit(200), a), [("job is closed", "active"), ("no longer available", "active"), (" ", "unknown")])
    check(spark, M.availability(a.cast("int"), b), [(("404", "x"), "closed"), (("410", "x"), "closed"), (("500", "x"), "unknown"), (("302", "x"), "active"), ((None, "x"), "unknown"), ((None, "Page not found"), "closed")])
    view, wall = "https://www.linkedin.com/jobs/view/1", "https://www.linkedin.com/authwall?x"
    check(spark, M.linkedin_availability(a, b), [((view, "A job"), "active"), ((view, "No longer accepting applications"), "closed"), ((wall, "This job has expired"), "unknown"), ((view, "Join LinkedIn, this job has expired"), "unknown"), (("https://x.example", "A job"), "unknown"), ((view, " "), "unknown")])
    check(spark, M.wttj_availability(a, b), [(("https://w.example/jobs/1", "x"), "active"), (("https://w.example/jobs/1", "Cette offre a été pourvue"), "closed"), (("https://w.example/signin?jobs/1", "offre a été pourvue"), "unknown"), (("https://w.example/a", "x"), "unknown")])
    check(spark, F.to_json(M.ats_board(a)), [("ATS: Lever; board: a b ; x", '{"ats":"lever","slug":"a b"}'), ("ATS: Workday; board: a", None), ("ats: lever, board: a", None)])


@pytest.mark.parametrize("pattern", [p for _, p in R.SKILLS] + [R.HYBRID, R.ONSITE, R.REMOTE, R.TEXT_JUNIOR, R.TEXT_SENIOR, R.AT_OFFICE, R.IN_PERSON])
def test_needles_lose_nothing(pattern):
    """Whatever a pattern matches holds one of its literals."""
    import re

    words = needles(pattern)
    texts = ["power  bi", "3 days in office", "at our big office", "sql", "c++", "predictive models", "train an ml model", "optimise machine learning algorithm", "r programming", "2 jours au bureau", "entry level", "recent grads", "on-site", "full remote", "удалённо"]
    for name, p in R.SKILLS:
        texts.append(re.sub(r"\\b|\\s[*+]|[?()^$]|\[.*?\]", "", p.split("|")[0]))
    for t in texts:
        if words and re.search(pattern, t):
            assert any(w in t for w in words), (t, words)
