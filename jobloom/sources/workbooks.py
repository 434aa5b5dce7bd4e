"""Workbooks (.xlsx): zipped XML, read and written by tasks, a book at a time, with the standard library.

Spark reads the bytes of the books (so from any store) and deals them over tasks; each gives the rows of one of its sheets as text.
A book holds at most MOST_ROWS rows a sheet, which the format sets, so a table is written as a folder of books, one or more for each
task. Styles, formulas and charts are not kept; a cell with a formula gives the value that was saved with it.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Limits and names of the format.
MOST_ROWS = 1_048_575  # below the header
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
KINDS = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_NOT_XML = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def sheet_files(book: zipfile.ZipFile) -> dict[str, str]:
    """Names of a book's sheets, in order, and the parts that hold them."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{{{MAIN}}}sheet")
    part = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
    return {s.get("name"): part(targets[s.get(f"{{{LINK}}}id")]) for s in sheets}


def _column(reference: str) -> int:
    """The place of a cell: A1 is 0, AA1 is 26."""
    at = 0
    for letter in reference.rstrip("0123456789"):
        at = at * 26 + ord(letter) - 64
    return at - 1


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{{{MAIN}}}t"))


def sheet_rows(book: zipfile.ZipFile, part: str) -> Iterator[list[str]]:
    """The rows of a sheet as lists of texts, one after the other; missing cells are blank, rows left out are skipped."""
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = [_text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{{{MAIN}}}si")]
    with book.open(part) as source:
        for _, node in ElementTree.iterparse(source):
            if node.tag != f"{{{MAIN}}}row":
                continue
            row: list[str] = []
            for n, cell in enumerate(node.iter(f"{{{MAIN}}}c")):
                at = _column(cell.get("r")) if cell.get("r") else n
                row += [""] * (at - len(row) + 1)
                value, kind = cell.findtext(f"{{{MAIN}}}v") or "", cell.get("t")
                row[at] = shared[int(value)] if kind == "s" and value else _text(cell) if kind == "inlineStr" else {"1": "True", "0": "False"}.get(value, value) if kind == "b" else value
            node.clear()
            yield row


def read_workbooks(spark: SparkSession, path: str, columns: list[str], sheets: tuple[str, ...] = ("jobs_master", "Jobs", "raw_jobs"), order: str | None = None) -> DataFrame:
    """The named columns, as text, of the first of the sheets that each book has; columns that it lacks are blank. A book with none of them is an error.
    order: name of a column (file, row) that tells the input order over all books."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns] + [T.StructField("_file", T.StringType()), T.StructField("_row", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    known = sheet_files(book)
                    part = next((known[s] for s in sheets if s in known), None)
                    if part is None:
                        raise FileNotFoundError(f"{name}: none of {', '.join(sheets)}")
                    rows = sheet_rows(book, part)
                    header = next(rows, [])
                    at = [header.index(c) if c in header else -1 for c in columns]
                    held: list[list] = []
                    for n, row in enumerate(rows):
                        held.append([row[i] if 0 <= i < len(row) else "" for i in at] + [name, n])
                        if len(held) == 10_000:
                            yield pd.DataFrame(held, columns=schema.names)
                            held = []
                    yield pd.DataFrame(held, columns=schema.names)

    books = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    got = books.mapInPandas(run, schema)
    return got.select(*columns, *([F.struct(F.col("_file").alias("file"), F.col("_row").alias("row")).alias(order)] if order else []))


def _letters(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def book_bytes(sheet: str, header: list[str], rows: list[list[str]]) -> bytes:
    """A book of one sheet whose cells are all texts."""
    out = io.BytesIO()
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{KINDS}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{KINDS}.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{LINK}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN}" xmlns:r="{LINK}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{LINK}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as w:
            w.write(f'{head}<worksheet xmlns="{MAIN}"><sheetData>'.encode())
            for n, row in enumerate([header, *rows], 1):
                cells = "".join(f'<c r="{_letters(i)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(_NOT_XML.sub("", v), {chr(13): "&#13;"})}</t></is></c>' for i, v in enumerate(row) if v)
                w.write(f'<row r="{n}">{cells}</row>'.encode())
            w.write(b"</sheetData></worksheet>")
    return out.getvalue()


def write_workbooks(df: DataFrame, folder: str, sheet: str, order: list[Column], rows: int = 100_000) -> None:
    """All columns as text in books of at most so many rows, named in the order given: part-00000-0.xlsx and on. A task that runs again writes its
    books again under the same names. Characters that XML can't hold are left out."""
    if not 1 <= rows <= MOST_ROWS:
        raise ValueError(f"a sheet holds 1 to {MOST_ROWS} rows")
    names = df.columns
    texts = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names], F.struct(*order).alias("_order"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        from pyarrow import fs
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(folder if ":/" in folder else "file://" + os.path.abspath(folder))
        system.create_dir(root, recursive=True)
        part, made, held = TaskContext.get().partitionId(), 0, []

        def put() -> None:
            nonlocal made, held
            with system.open_output_stream(f"{root}/part-{part:05d}-{made}.xlsx") as out:
                out.write(book_bytes(sheet, names, held))
            made, held = made + 1, []

        for b in batches:
            for row in b[names].itertuples(index=False):
                held.append(list(row))
                if len(held) == rows:
                    put()
        if held:
            put()
        yield pd.DataFrame({"n": [made]})

    texts.repartitionByRange("_order").sortWithinPartitions("_order").select(*names).mapInPandas(run, "n long").agg(F.sum("n")).collect()
