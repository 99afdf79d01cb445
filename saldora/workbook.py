"""Workbooks (.xlsx) as a data source that Spark writes to, in two phases.

    sheets({"all": rows, "overview": counts}).write.format("workbook").mode("overwrite").save("file:///out/report.xlsx")

Tasks write their rows as parts of sheets into a folder of their own beside the file, each attempt under a new name, and
tell only names and counts of rows. The commit puts the parts of the attempts that counted together, in order, as a
stream; no row is collected. An attempt that failed leaves a part that nobody names; commit and abort remove the folder.
A sheet of more rows than a workbook can hold goes on in further ones, "name (2)" and so on. The file must be in a store
that pyarrow knows.
"""

from __future__ import annotations

import itertools
import json
import re
import shutil
import zipfile
from dataclasses import dataclass
from uuid import uuid4
from xml.sax.saxutils import escape, quoteattr

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

#: Rows of a sheet at most, and of a part.
MOST_ROWS, PART_ROWS = 1_048_576, 50_000
CELL = "struct<s: string, n: double, f: string>"
SCHEMA = f"sheet_ord int, sheet string, row_ord long, cells array<{CELL}>"
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Characters that XML does not know.
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def cell(value: Column, kind: str) -> Column:
    """A value as a cell: numbers as numbers, everything else as text."""
    number = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
    shown = F.when(value, "yes").otherwise("no") if kind == "boolean" else value.cast("string")
    text = F.lit(None).cast("string") if number else F.when(value.isNotNull(), shown)
    return F.struct(text.alias("s"), (value.cast("double") if number else F.lit(None).cast("double")).alias("n"), F.lit(None).cast("string").alias("f"))


def formula(text: Column) -> Column:
    """A cell worked out by the reader's program; without the leading sign of equality."""
    return F.struct(F.lit(None).cast("string").alias("s"), F.lit(None).cast("double").alias("n"), text.alias("f"))


def rows_of(place: int, name: str, df: DataFrame, order: list | None = None) -> DataFrame:
    """SCHEMA of one sheet: a row of headings, then df's rows by `order` (else by all columns that can be ordered).

    Their numbers come from a range partition and the sizes of those before, not from one window over all rows."""
    spark = df.sparkSession
    cells = F.array(*[F.col(c) if t == CELL.replace(": ", ":").replace(", ", ",") else cell(F.col(c), t) for c, t in df.dtypes]).cast(f"array<{CELL}>")
    by = order or [F.col(c) for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))] or [F.lit(0)]
    head = spark.range(1).select(F.lit(place).alias("sheet_ord"), F.lit(name).alias("sheet"), F.lit(0).cast("long").alias("row_ord"), F.array(*[cell(F.lit(c), "string") for c in df.columns]).cast(f"array<{CELL}>").alias("cells"))
    sorted_ = df.select(cells.alias("cells"), *[c.alias(f"__k{i}") for i, c in enumerate(by)]).repartitionByRange(*[F.col(f"__k{i}") for i in range(len(by))]).sortWithinPartitions(*[f"__k{i}" for i in range(len(by))])
    # In order of partition and place in it: what is read from a range partition.
    body = sorted_.select(F.lit(place).alias("sheet_ord"), F.lit(name).alias("sheet"), (F.monotonically_increasing_id() + 1).alias("row_ord"), "cells")
    return head.unionByName(body)


def sheets(tables: dict[str, DataFrame], order: dict[str, list] | None = None) -> DataFrame:
    """All sheets as one table, dealt and sorted so that tasks write runs of rows that follow each other."""
    parts = [rows_of(i, name, df, (order or {}).get(name)) for i, (name, df) in enumerate(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.repartitionByRange("sheet_ord", "row_ord").sortWithinPartitions("sheet_ord", "row_ord")


def row_xml(cells) -> str:
    out = []
    for c in cells or []:
        if c["f"] is not None:
            out.append(f"<c><f>{escape(_BAD.sub('', c['f']))}</f></c>")
        elif c["n"] is not None and c["n"] == c["n"] and abs(c["n"]) != float("inf"):
            out.append(f"<c><v>{c['n']!r}</v></c>")
        elif c["s"] is not None:
            out.append(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_BAD.sub("", c["s"]))}</t></is></c>')
        else:
            out.append("<c/>")
    return f"<row>{''.join(out)}</row>"


@dataclass
class Written(D.WriterCommitMessage):
    """parts: (place of the sheet, its name, name of the part, rows), in the order written."""

    partition: int
    parts: list


class Writer(D.DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.choices = json.loads(options.get("choices", "{}"))
        self.staging = f"{self.path.rstrip('/')}.parts-{uuid4().hex}"

    def _at(self, path: str):
        return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")

    def write(self, iterator):
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = self._at(self.staging)
        store.create_dir(root)
        parts: list = []
        for (place, sheet), rows in itertools.groupby(iterator, key=lambda r: (r["sheet_ord"], r["sheet"])):
            while block := list(itertools.islice(rows, PART_ROWS)):
                name = f"{context.partitionId()}-{context.attemptNumber()}-{uuid4().hex}.xml"
                with store.open_output_stream(f"{root}/{name}") as out:
                    for r in block:
                        out.write(row_xml(r["cells"]).encode())
                parts.append((place, sheet, name, len(block)))
        return Written(context.partitionId(), parts)

    def commit(self, messages):
        store, root = self._at(self.staging)
        _, final = self._at(self.path)
        told = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        pages: list = []  # (name, parts)
        for (_, name), parts in itertools.groupby(sorted((p for m in told for p in m.parts), key=lambda p: p[0]), key=lambda p: p[:2]):
            rows, part_of, number = 0, [], 1
            for p in parts:
                if rows + p[3] > MOST_ROWS:
                    pages.append((name if number == 1 else f"{name} ({number})", part_of))
                    rows, part_of, number = 0, [], number + 1
                rows += p[3]
                part_of.append(p[2])
            pages.append((name if number == 1 else f"{name} ({number})", part_of))
        if not self.overwrite and store.get_file_info(final).type != fs.FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(self.path)
        with store.open_output_stream(f"{root}/whole") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            self._frame(book, [n for n, _ in pages])
            for k, (name, parts) in enumerate(pages, 1):
                with book.open(f"xl/worksheets/sheet{k}.xml", "w") as sheet:
                    sheet.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                    for p in parts:
                        with store.open_input_stream(f"{root}/{p}") as part:
                            shutil.copyfileobj(part, sheet, 2**20)
                    sheet.write(f"</sheetData>{self._choice(name)}</worksheet>".encode())
        store.move(f"{root}/whole", final)
        store.delete_dir(root)

    def _choice(self, sheet: str) -> str:
        """A list to choose from in a column of the sheet."""
        if sheet not in self.choices:
            return ""
        column, words = self.choices[sheet]
        said = escape('"' + ",".join(words) + '"')
        return f'<dataValidations count="1"><dataValidation type="list" allowBlank="1" sqref="{column}2:{column}{MOST_ROWS}"><formula1>{said}</formula1></dataValidation></dataValidations>'

    def _frame(self, book: zipfile.ZipFile, names: list[str]) -> None:
        part = "application/vnd.openxmlformats-officedocument.spreadsheetml."
        ids = range(1, len(names) + 1)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{part}worksheet+xml"/>' for k in ids)
        book.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{part}sheet.main+xml"/>{kinds}</Types>')
        book.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PKG}/relationships"><Relationship Id="r1" Type="{_DOC}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        links = "".join(f'<Relationship Id="r{k}" Type="{_DOC}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in ids)
        book.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PKG}/relationships">{links}</Relationships>')
        # Names of sheets have 31 characters at most and none of some signs.
        shown = [re.sub(r"[\[\]:*?/\\]", " ", n)[:31] for n in names]
        body = "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="r{k}"/>' for k, n in zip(ids, shown))
        book.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_DOC}"><sheets>{body}</sheets></workbook>')

    def abort(self, messages):
        store, root = self._at(self.staging)
        if store.get_file_info(root).type != fs.FileType.NotFound:
            store.delete_dir(root)


class Workbook(D.DataSource):
    @classmethod
    def name(cls):
        return "workbook"

    def schema(self):
        return SCHEMA

    def writer(self, schema, overwrite):
        return Writer(dict(self.options), overwrite)


def write(tables: dict[str, DataFrame], path: str, choices: dict | None = None, order: dict[str, list] | None = None) -> None:
    """The tables as sheets of a workbook, in order; choices: by sheet, a column letter and the words to choose from."""
    df = sheets(tables, order)
    df.sparkSession.dataSource.register(Workbook)
    writer = df.write.format("workbook").mode("overwrite")
    (writer.option("choices", json.dumps(choices)) if choices else writer).save(path)
