"""Documents and workbooks as DataFrames. Files are listed and read by Spark's binaryFile source, so any store that
Spark reads will do; what cannot be read becomes a row with an error, never an exception or a gap."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saldora.sources import pdf

#: What a review reads; RTF (statutes) and texts are read by pages() as well.
READABLE = (".pdf", ".docx")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def can_read(path: Column) -> Column:
    return suffix(path).isin(*READABLE)


def binary_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def newest_by_year(files: DataFrame) -> DataFrame:
    """folder, newest, prior: the files with the highest and second highest year in their names."""
    rows = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), "path", F.regexp_extract("path", r"(20\d{2})[^/]*$", 1).alias("year")).where("year <> ''")
    by = rows.groupBy("folder").agg(F.sort_array(F.collect_list(F.struct("year", "path")), asc=False).alias("f"))
    return by.select("folder", F.get("f", 0)["path"].alias("newest"), F.get("f", 1)["path"].alias("prior"))


def table_line(cells: list[str]) -> str:
    """A row's cells with three blanks between; nothing if no cell has a letter or digit."""
    line = "   ".join(c.strip() for c in cells if c and c.strip())
    return line if any(ch.isalnum() for ch in line) else ""


def docx_pages(data: bytes, tables: bool = True) -> list[str]:
    """The body in order: runs of paragraphs are a page, every table is one of its own."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    text = lambda el: "".join(t.text or "" if t.tag == f"{_W}t" else "\n" if t.tag == f"{_W}br" else "\t" if t.tag == f"{_W}tab" else "" for t in el.iter())
    pages: list[str] = []
    held: list[str] = []
    for el in body:
        if el.tag == f"{_W}p":
            held.append(text(el))
        elif el.tag == f"{_W}tbl" and tables:
            if any(h.strip() for h in held):
                pages.append("\n".join(held))
            held = []
            lines = [table_line([text(c) for c in row.iter(f"{_W}tc")]) for row in el.iter(f"{_W}tr")]
            if lines := [x for x in lines if x]:
                pages.append("\n".join(lines))
    if any(h.strip() for h in held):
        pages.append("\n".join(held))
    return pages


def xlsx_cells(data: bytes) -> list[tuple[str, int, int, int, str]]:
    """(sheet, its place, row, column, value) of every cell with a value; rows and columns from 1."""
    book = zipfile.ZipFile(io.BytesIO(data))
    names = set(book.namelist())
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{_M}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for place, sheet in enumerate(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_M}sheet")):
        target = links[sheet.get(f"{_R}id")].lstrip("/")
        tree = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
        at = [0, 0]  # cells and rows without a reference follow those before
        for c in tree.iter():
            if c.tag == f"{_M}row":
                at = [int(c.get("r") or at[0] + 1), 0]
            if c.tag != f"{_M}c":
                continue
            if c.get("r"):
                letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                col = 0
                for ch in letters:
                    col = col * 26 + ord(ch) - 64
                at = [int(row), col]
            else:
                at[1] += 1
            v = c.find(f"{_M}v")
            value = "".join(t.text or "" for t in c.iter(f"{_M}t")) if c.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
            if value not in (None, ""):
                out.append((sheet.get("name"), place, *at, value))
    return out


def rtf_text(data: bytes) -> str:
    """Plain text of RTF: control words out, \\par to line breaks, escapes decoded."""
    s = data.decode("latin-1")
    s = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), s)
    s = re.sub(r"\\u(-?\d+)\??", lambda m: chr(int(m[1]) % 65536), s)
    s = re.sub(r"\{\\\*?\\?(?:fonttbl|colortbl|stylesheet|info)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", s)
    s = re.sub(r"\\par[d]?\b ?|\\line\b ?", "\n", s)
    return re.sub(r"\\[a-zA-Z]+-?\d* ?|[{}]", "", s).strip()


def other_pages(path: str, data: bytes, tables: bool = True) -> list[str]:
    """The pages of a file that is no PDF."""
    kind = path.lower().rsplit(".", 1)[-1]
    if kind == "docx":
        return docx_pages(data, tables)
    if kind == "rtf":
        return [rtf_text(data)]
    if kind == "txt":
        return data.decode("utf-8", "replace").split("\f")
    raise ValueError(f"cannot read .{kind}")


def runs(files: DataFrame, tables: bool = True) -> DataFrame:
    """pdf.RUNS of files (path, content): positioned runs of PDF files; pages of other files as runs without a place."""

    def read(batches):
        for batch in batches:
            for path, data in zip(batch.path, batch.content):
                rows = []
                try:
                    if path.lower().endswith(".pdf"):
                        rows = list(pdf.file_runs(path, bytes(data)))
                    else:
                        rows = [(path, k, 0, None, None, None, None, t, None) for k, t in enumerate(other_pages(path, bytes(data), tables), 1)]
                except Exception as e:  # any damage of a file is a row
                    rows = [(path, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in pdf.RUNS.split(", ")]).astype({"page": "Int32", "n": "Int32", **dict.fromkeys(("x", "y", "x_end", "size"), "float64")})

    return files.select("path", "content").mapInPandas(read, pdf.RUNS)


def pages(files: DataFrame, tables: bool = True) -> DataFrame:
    """doc_id (the path), page, text, error; a row with the error for a file, or a page, that cannot be read."""
    return pdf.page_texts(runs(files, tables))


def simple_pages(files: DataFrame, tables: bool = True) -> DataFrame:
    """pages() without PDF files, in one pass and so also over a stream."""

    def read(batches):
        for batch in batches:
            rows = []
            for path, data in zip(batch.path, batch.content):
                try:
                    rows += [(path, k, t, None) for k, t in enumerate(other_pages(path, bytes(data), tables), 1)]
                except Exception as e:
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "text", "error"]).astype({"page": "Int32"})

    return files.select("path", "content").mapInPandas(read, "doc_id string, page int, text string, error string")


def information(files: DataFrame) -> DataFrame:
    """path, pages, title, author, producer, error of PDF files."""

    def read(batches):
        for batch in batches:
            rows = []
            for path, data in zip(batch.path, batch.content):
                try:
                    file = pdf.File(bytes(data))
                    rows.append((path, len(file.pages()), *[file.info().get(k) for k in pdf.INFO], None))
                except Exception as e:
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "pages", "title", "author", "producer", "error"]).astype({"pages": "Int32"})

    return files.where(suffix(F.col("path")) == ".pdf").select("path", "content").mapInPandas(read, "path string, pages int, title string, author string, producer string, error string")


def cells(files: DataFrame) -> DataFrame:
    """schemas.CELLS and error of workbooks."""

    def read(batches):
        for pdf in batches:
            rows = []
            for path, data in zip(pdf.path, pdf.content):
                try:
                    rows += [(path, *c, None) for c in xlsx_cells(bytes(data))]
                except Exception as e:
                    rows.append((path, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "sheet", "sheet_ord", "row", "col", "value", "error"]).astype({c: "Int32" for c in ("sheet_ord", "row", "col")})

    return files.select("path", "content").mapInPandas(read, "path string, sheet string, sheet_ord int, row int, col int, value string, error string")


def skipped(read: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id, reason of the files that could not be read."""
    return read.where("error is not null").select(F.col(key).alias("doc_id"), F.col("error").alias("reason"))


def sidecars(spark: SparkSession, path: str, ending: str = ".texts.json") -> DataFrame:
    """path, size, texts of the files that lie beside a document and hold its recognised pages: {"size": …, "texts": […]}."""
    rows = spark.read.schema("size long, texts array<string>").option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{ending}").json(path)
    name = F.col("_metadata.file_path")
    return rows.select(F.left(name, F.length(name) - len(ending)).alias("path"), "size", "texts")


def cached_texts(files: DataFrame, cache: DataFrame, beside: DataFrame | None = None) -> DataFrame:
    """doc_id, page, text recognised before: from the file beside the document if it was made of a file of the same
    size, else from cache(key, texts) by length and content hash."""
    key = F.concat_ws("_", F.col("length"), F.left(F.sha2("content", 256), F.lit(20)))
    # Paths as Spark writes them for binary files and for files' metadata differ in their slashes.
    same = lambda p: F.regexp_replace(p, "^([a-z]+):/+", "$1:/")
    rows = files.select("path", "length", key.alias("key")).join(cache.select("key", F.col("texts").alias("kept")), "key", "left")
    if beside is not None:
        near = beside.select(same(F.col("path")).alias("at"), F.col("size").alias("length"), "texts")
        rows = rows.withColumn("at", same(F.col("path"))).join(near, ["at", "length"], "left")
    else:
        rows = rows.withColumn("texts", F.lit(None).cast("array<string>"))
    texts = F.coalesce("texts", "kept")
    return rows.select(F.col("path").alias("doc_id"), F.posexplode(texts).alias("n", "text")).select("doc_id", (F.col("n") + 1).alias("page"), "text")
