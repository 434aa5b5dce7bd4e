"""Files and sheets: CSV as text, review and log tables, drafts, configuration, run log."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ids as I
from ..functions.text import strip, text


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True).option("lineSep", "\n").csv(path)


def scan_order() -> Column:
    """Where a scanned row stands, comparable over all files: file, then block, then row. Rows of a block are read in one task, in
    order, so the running id of the scan tells them apart; it is compared within one block only."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def read_csv(spark: SparkSession, path: str, columns: list[str], order: str | None = None) -> DataFrame:
    """All columns as text, so that "3" stays "3"; missing is the empty string; a byte order mark is no part of a name.
    order: name of a column that tells the input order of rows over all files (scan_order)."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    got = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("lineSep", "\n").option("enforceSchema", True).csv(path)
    return (got.select("*", scan_order().alias(order)) if order else got).na.fill("", columns)


def write_sheet(df: DataFrame, book: str, sheet: str) -> None:
    """A table for each sheet: replaces that one, keeps the others."""
    df.write.mode("overwrite").parquet(f"{book}/{sheet}")


def read_sheet(spark: SparkSession, book: str, sheets: tuple[str, ...] = ("jobs_master", "Jobs", "raw_jobs"), order: str | None = None) -> DataFrame:
    """The first of the sheets that the book has; order: as in read_csv."""
    for s in sheets:
        try:
            got = spark.read.parquet(f"{book}/{s}")
            return got.select("*", scan_order().alias(order)) if order else got
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    raise FileNotFoundError(f"{book}: none of {', '.join(sheets)}")


def manual_review(df: DataFrame, order: str = "seq") -> DataFrame:
    """Blank and "nan" ids go, missing cells are blank, the last row of an id counts."""
    cells = [strip(F.col(c)).alias(c) if c != order else F.col(c) for c in df.columns]
    rows = df.select(*cells).where(~F.lower("job_id").isin("", "nan"))
    return rows.groupBy("job_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "job_id"]), F.col(order)).alias("r")).select("job_id", "r.*")


def applications(df: DataFrame, order: str = "seq") -> DataFrame:
    """The application log by key (job_id, or the normalised URL of a row typed in by hand): rows without either go, missing cells are
    blank, the last row of a key counts."""
    cells = [strip(F.col(c)).alias(c) if c != order else F.col(c) for c in df.columns]
    rows = df.select(*cells).withColumn("key", I.app_key(F.col("job_id"), F.col("url"))).where("key IS NOT NULL")
    return rows.groupBy("key").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "key"]), F.col(order)).alias("r")).select("key", "r.*")


def drafts(spark: SparkSession, folder: str) -> DataFrame:
    """job_id, review_verdict, pdf_ready of the drafts (*.md) in a folder; a draft is ready if a .pdf stands beside it."""
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)\.\w+$", 1)
    md = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True).select(F.url_decode(name).alias("job_id"), "value")
    pdf = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select(F.regexp_extract("path", r"([^/]+)\.\w+$", 1).alias("pdf"))
    return md.join(pdf, F.col("job_id") == F.col("pdf"), "left").select("job_id", verdict(F.col("value")).alias("review_verdict"), F.col("pdf").isNotNull().alias("pdf_ready"))


def write_drafts(df: DataFrame, folder: str) -> None:
    """(job_id, md, pdf) -> a file job_id.md for each row, and a job_id.pdf of a header alone where pdf is true; ids are plain names."""

    def run(batches):
        import os

        import pandas as pd
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if ":/" in folder else "file://" + os.path.abspath(folder))
        system.create_dir(root, recursive=True)
        for b in batches:
            for job_id, md, pdf in zip(b["job_id"], b["md"], b["pdf"], strict=True):
                for name, body in (("md", md.encode()), *([("pdf", b"%PDF")] if pdf else [])):
                    with system.open_output_stream(f"{root}/{job_id}.{name}") as out:
                        out.write(body)
            yield pd.DataFrame({"n": [len(b)]})

    df.select("job_id", "md", "pdf").mapInPandas(run, "n long").agg(F.sum("n")).collect()


REVIEW_MARK = "## Ревью"


def has_review(c):
    return text(c).contains(REVIEW_MARK)


def verdict(c):
    return F.when(~has_review(c), "").when(c.contains("✅ Одобрено"), "approved").when(c.contains("⚠️ Нужна правка"), "needs_revision").otherwise("")


def without_review(c):
    return F.concat(F.regexp_replace(F.substring_index(text(c), "\n---\n\n" + REVIEW_MARK, 1), r"\s+$", ""), F.lit("\n"))


def draft_content(c):
    """Struct (pitch, bullets joined by "; ")."""
    section = F.regexp_extract(c, r"(?s)## Адаптированные пункты для CV\s*\n\n(.*?)\n\n---", 1)
    return F.struct(strip(F.regexp_extract(c, r"(?m)^> (.+)$", 1)).alias("pitch"), F.array_join(F.transform(F.regexp_extract_all(section, F.lit(r"(?m)^- (.+)$"), F.lit(1)), strip), "; ").alias("bullets"))


def contact_line(c):
    """Name, mail and profile out of a text whose first line may be a page title that extends the name."""
    lines = F.filter(F.transform(F.split(text(c), r"\r?\n"), strip), lambda x: x != "")
    first, second = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
    name = F.when((first != second) & F.startswith(F.lower(first), F.lower(second)), second).otherwise(first)
    parts = F.array(F.coalesce(name, F.lit("")), F.regexp_extract(c, r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+", 0), F.regexp_extract(c, r"linkedin\.com/in/\S+", 0))
    return F.array_join(F.filter(parts, lambda x: x != ""), " · ")


def yaml_config(spark: SparkSession, path: str) -> dict:
    """One YAML file, which must be a mapping, read by Spark (so from any store); a configuration is small enough for the driver."""
    import yaml

    found = [r["value"] for r in spark.read.text(path, wholetext=True).limit(2).collect()]
    if len(found) != 1:
        raise FileNotFoundError(f"{path}: one file is expected, {len(found)} found")
    got = yaml.safe_load(found[0].removeprefix("\ufeff")) or {}
    if not isinstance(got, dict):
        raise ValueError(f"{path}: a mapping is expected")
    return got


def query_catalogue(spark: SparkSession, categories: dict[str, list[str]]) -> DataFrame:
    rows = [(i, q, c) for i, (q, c) in enumerate((q, c) for c, qs in categories.items() for q in qs)]
    return spark.createDataFrame(rows, "ord int, query string, category string")


def append_run_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
