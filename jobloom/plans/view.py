"""A posting view over the test tables: the same rows in Spark and in DuckDB SQL. The tables have no job vocabulary of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R

TITLES = ("Data Analyst", "Senior Risk Analyst", "Junior Data Analyst", "Product Analyst (Remote)", "BI & Data Analyst", "Fraud Analyst", "Quant Researcher", "Business Analyst", "Analytics Engineer", "Data Engineer Manager", "Market Data Specialist", "Data Analyst")
COMPANIES = ("Northwind Labs, Inc.", "NorthwindLabsInc", "Northwind Labs (Holdings)", "Contoso GmbH", "Contoso", "Fabrikam LLC", "Tailspin", "Fabrikam", "Wingtip Toys Ltd")
PLACES = ("Paris, Ile-de-France, France", "Remote", "Berlin, Germany", "", "Europe", "Kyiv, Ukraine", "Remote - USA")
LANDS = ("France", "", "Germany", "", "", "Ukraine", "USA")
SNIPPETS = (
    "Required: SQL and Python. Nice to have: Tableau.", "5+ years of experience with Power BI. Fully remote.", "Hybrid role, 3 days a week in office. Salary: $80,000 - $95,000 per year", "We have been here for over 15 years. 2-4 years of experience.",
    "dbt and Snowflake must be known; Tableau certification is a plus.", "Strong Excel and machine learning. On-site.", "No experience needed, learn to trade.", "Statistics, A/B testing. Salary 45 000 - 55 000 EUR",
    "AML and fraud detection, crypto exchange.", "Looker, BigQuery, Airflow; German speaking required.",
)
SALARIES = ("", "45 000 - 55 000 EUR", "$80,000", "30.000,00 €", "50 000 грн", "£40,500-£45,250/year")
DATES = ("2026-09-19T04:02:55+00:00", "Fri, 02 Oct 2026 15:31:05", "Reposted 2026-10-03", "unknown", "2026-02-30", "")
FORMATS = ("Remote", "Hybrid", "On-site", "Unknown")
STATES = ("active", "active", "closed", "unknown")
REASONS = ("", "Senior role, 5+ years", "Нужен немецкий, German only", "Python coding test", "AML compliance", "офис, relocation", "скам", "Хорошо подходит")
REQUIRED = ("SQL; Python", "Power BI", "", "Excel; Statistics", "dbt; Snowflake", "Excel; Machine Learning", "Crypto; R", "Statistics; A/B testing", "Fraud Detection; Crypto", "Looker; BigQuery; Airflow")
PREFERRED = ("Tableau", "", "dbt; SQL", "R", "Tableau", "", "Looker")
SENIORITY = ("Junior", "Mid-level", "Senior", "Unknown", "Lead")
BOARDS = R.SOURCE_ORDER
TODAY = "2026-11-01"

_LISTS = {
    "title": (TITLES, "doc_id % 12"), "company": (COMPANIES, "(doc_id // 3) % 9"), "city_region": (PLACES, "doc_id % 7"), "country": (LANDS, "doc_id % 7"), "salary": (SALARIES, "doc_id % 6"), "date_published": (DATES, "(doc_id // 2) % 6"),
    "work_format": (FORMATS, "doc_id % 4"), "availability_status": (STATES, "(doc_id // 2) % 4"), "main_reason": (REASONS, "doc_id % 8"), "required_skills": (REQUIRED, "doc_id % 10"), "preferred_skills": (PREFERRED, "doc_id % 7"),
    "seniority": (SENIORITY, "doc_id % 5"), "board": (BOARDS, "doc_id % 7"),
}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def _pick(values, index: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.expr(f"cast({index.replace('//', 'div')} + 1 as int)"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posting for each document, reviewed where labels has its id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("l_id"), "quality", "toxic")
    base = docs.join(labels, F.col("doc_id") == F.col("l_id"), "left")
    decision = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), R.YES).when(F.col("quality") == 1, R.MAYBE).when(F.col("quality") == 0, R.NO).otherwise("")
    return base.select(
        F.col("doc_id").alias("seq"), F.concat(F.lit("j"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("job_id"), "source", "lang",
        *[_pick(v, i).alias(c) for c, (v, i) in _LISTS.items()],
        F.concat("text", F.lit("\n"), _pick(SNIPPETS, "doc_id % 10")).alias("full_text"),
        F.concat(F.lit("https://Example.com/jobs/"), (F.col("doc_id") % 100).cast("string"), F.lit("/?utm_source="), F.col("doc_id").cast("string")).alias("url"),
        decision.alias("decision"), F.when((F.col("quality") == 0) & (F.col("toxic") == 1), R.MARK).otherwise("").alias("should_be_filtered"),
        F.when(F.col("doc_id") % 17 == 0, R.MARK).otherwise("").alias("applied"), F.lit("").alias("review_notes"),
        F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 90).cast("int")), "yyyy-MM-dd").alias("date_collected"),
    )


#: The same rows: WITH p AS (VIEW).
VIEW = f"""SELECT d.doc_id AS seq, 'j' || lpad(d.doc_id::VARCHAR, 8, '0') AS job_id, d.source, d.lang,
{", ".join(f"{sql_list(v)}[({i.replace('doc_id', 'd.doc_id')} + 1)::INT] AS {c}" for c, (v, i) in _LISTS.items())},
d.text || chr(10) || {sql_list(SNIPPETS)}[(d.doc_id % 10 + 1)::INT] AS full_text,
'https://Example.com/jobs/' || (d.doc_id % 100)::VARCHAR || '/?utm_source=' || d.doc_id::VARCHAR AS url,
CASE WHEN l.quality = 1 AND l.toxic = 0 THEN {q(R.YES)} WHEN l.quality = 1 THEN {q(R.MAYBE)} WHEN l.quality = 0 THEN {q(R.NO)} ELSE '' END AS decision,
CASE WHEN l.quality = 0 AND l.toxic = 1 THEN {q(R.MARK)} ELSE '' END AS should_be_filtered,
CASE WHEN d.doc_id % 17 = 0 THEN {q(R.MARK)} ELSE '' END AS applied, '' AS review_notes,
strftime(DATE '2026-01-01' + (d.doc_id % 90)::INT, '%Y-%m-%d') AS date_collected
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
WITH = f"WITH p AS ({VIEW})"


def re2(pattern: str) -> str:
    """A pattern of this library for RE2, for tests of existence: word boundaries of any script, no look-ahead."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith(r"\b", i):
            nxt = pattern[i + 2 : i + 3]
            out += r"(?:^|[^\p{L}\p{N}_])" if nxt and (nxt.isalnum() or nxt in "([\\") else r"(?:[^\p{L}\p{N}_]|$)"
            i += 2
        elif pattern.startswith(r"\w", i):
            out += r"[\p{L}\p{N}_]"
            i += 2
        elif pattern[i] == "\\":
            out += pattern[i : i + 2]
            i += 2
        else:
            out += pattern[i]
            i += 1
    return out


def has(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {q(re2(pattern))})"


def any_sql(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def fold_sql(col: str) -> str:
    return f"replace(lower({col}), 'ß', 'ss')"
