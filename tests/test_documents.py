"""PDF files, the page_runs data source, workbooks."""

import io
import os
import shutil
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from saldora import sinks, workbook
from saldora.sources import files, page_runs, pdf


def pdf_file(objects: dict[int, bytes], trailer: bytes = b"", packed: tuple = ()) -> bytes:
    """A file of numbered objects; those named in packed go into an object stream."""
    out = io.BytesIO()
    out.write(b"%PDF-1.5\n%\xe2\xe3\n")
    for n, body in objects.items():
        if n not in packed:
            out.write(b"%d 0 obj\n%s\nendobj\n" % (n, body))
    if packed:
        bodies = [objects[n] for n in packed]
        head, at = [], 0
        for n, b in zip(packed, bodies):
            head.append(b"%d %d" % (n, at))
            at += len(b) + 1
        head = b" ".join(head) + b" "
        data = zlib.compress(head + b" ".join(bodies))
        out.write(b"99 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(packed), len(head), len(data), data))
    out.write(b"trailer\n<< /Root 1 0 R %s >>\n%%%%EOF" % trailer)
    return out.getvalue()


def stream(data: bytes, flate: bool = True) -> bytes:
    data = zlib.compress(data) if flate else data
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode" if flate else b"", data)


def report(packed=(), flate=True) -> bytes:
    first = b"""BT /F1 10 Tf 1 0 0 1 50 700 Tm (Anhang) Tj 0 -14 Td (Verbindlichkeiten) Tj ET
        BT /F1 10 Tf 300 686 Td (1.234,56) Tj 60 0 Td (987,00) Tj ET
        q 1 0 0 1 50 0 cm BT /F1 10 Tf 0 650 Td [(R\\374ck) -20 (stellungen \\(Stand\\)) -2500 (5,00)] TJ T* ET Q
        BI /W 1 /H 1 ID \x00(Tj)\xff EI BT 14 TL /F1 10 Tf 50 600 Td (eins) Tj T* (zwei) ' ET"""
    second = b"BT /F2 12 Tf 72 720 Td <000100020003> Tj ET"
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <00d6> endbfchar 1 beginbfrange <0002> <0003> <0061> endbfrange"
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 3 /Resources << /Font << /F1 7 0 R /F2 8 0 R >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents [5 0 R] >>", 4: b"<< /Type /Pages /Parent 2 0 R /Kids [6 0 R 11 0 R] >>", 5: stream(first, flate),
        6: b"<< /Type /Page /Contents 9 0 R >>", 7: b"<< /Type /Font /Subtype /TrueType /FirstChar 32 /Widths [%s] /Encoding /WinAnsiEncoding >>" % b" ".join([b"500"] * 224),
        8: b"<< /Type /Font /Subtype /Type0 /ToUnicode 10 0 R >>", 9: stream(second, flate), 10: stream(cmap, flate), 11: b"<< /Type /Page >>",
        12: b"<< /Title (Bericht \\(2024\\)) /Author <feff00c4> >>"}
    return pdf_file(objects, b"/Info 12 0 R", packed)


WANT = {
    1: "Anhang\nVerbindlichkeiten 1.234,56 987,00\nRückstellungen (Stand) 5,00\neins\nzwei",
    2: "Öab", 3: ""}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("inbox")
    (at / "plain.pdf").write_bytes(report(flate=False))
    (at / "flate.PDF").write_bytes(report())
    (at / "packed.pdf").write_bytes(report(packed=(1, 2, 3, 4, 6, 7, 8, 11, 12)))
    (at / "cut.pdf").write_bytes(report()[:200])
    (at / "none.pdf").write_bytes(b"no pdf at all")
    (at / "locked.pdf").write_bytes(pdf_file({1: b"<< /Type /Catalog >>"}, b"/Encrypt 5 0 R"))
    (at / "a.txt").write_text("eins\fzwei")
    (at / "odd.bin").write_bytes(b"\x00")
    return str(at)


def test_pdf_pages_from_runs(spark, folder):
    got = files.pages(files.binary_files(spark, folder)).collect()
    by = {}
    for r in got:
        by.setdefault(os.path.basename(r.doc_id), {})[r.page] = r.text if r.error is None else "!"
    assert by["plain.pdf"] == by["flate.PDF"] == by["packed.pdf"] == WANT
    assert by["a.txt"] == {1: "eins", 2: "zwei"}
    assert all(by[n] == {None: "!"} for n in ("none.pdf", "locked.pdf", "odd.bin"))
    assert set(by["cut.pdf"].values()) == {"!"}
    info = {os.path.basename(r.path): r for r in files.information(files.binary_files(spark, folder)).collect()}
    assert (info["packed.pdf"].pages, info["plain.pdf"].title, info["plain.pdf"].author) == (3, "Bericht (2024)", "Ä")
    assert info["locked.pdf"].error is not None


def test_lines_of_a_page_do_not_depend_on_the_order_of_runs(spark):
    rows = [("d", 1, n, x, y, x + 10.0, 10.0, t, None) for n, (x, y, t) in enumerate([(60.0, 99.0, "b"), (10.0, 100.0, "a"), (10.0, 80.0, "c"), (20.5, 80.0, "d"), (10.0, 60.0, "  ")])]
    got = pdf.lines(spark.createDataFrame(rows, pdf.RUNS).repartition(3)).orderBy("line_no").collect()
    assert [r.text for r in got] == ["a b", "cd", ""]


def test_recognised_pages_take_over_where_a_document_has_hardly_any_text(spark):
    s = "doc_id string, page int, text string"
    own = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y" * 80), ("c", 1, "z")], s)
    seen = spark.createDataFrame([("a", 1, "recognised"), ("b", 1, "q" * 99), ("c", 1, "")], s)
    got = {(r.doc_id, r.page): r.text for r in pdf.better_text(own, seen).collect()}
    assert got == {("a", 1): "recognised", ("b", 1): "y" * 80, ("c", 1): "z"}


def test_page_runs_is_a_source(spark, folder):
    spark.dataSource.register(page_runs.PageRuns)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    runs = spark.read.format("page_runs").option("partitionBytes", 1000).load(folder)
    assert runs.rdd.getNumPartitions() > 3
    got = {(os.path.basename(r.doc_id), r.page): r.text for r in pdf.page_texts(runs).where("error is null").collect()}
    assert {p: got["packed.pdf", p] for p in (1, 2, 3)} == WANT and got["a.txt", 2] == "zwei"
    assert pdf.page_texts(runs).where("error is not null").count() == 4
    only = spark.read.format("page_runs").load(folder).where("suffix = '.txt' and bytes < 100")
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan page_runs" in plan and "= .txt" not in plan and "< 100" not in plan  # the source has taken both, no filter is left
    reader = page_runs.Reader({"path": folder})
    left = list(reader.pushFilters([page_runs.D.EqualTo(("suffix",), ".txt"), page_runs.D.EqualTo(("text",), "x")]))
    assert len(left) == 1 and [f.suffix for p in reader.partitions() for f in p.files] == [".txt"]
    assert {r.text for r in only.collect()} == {"eins", "zwei"}
    assert spark.read.format("page_runs").load(folder + "/nothing").count() == 0


def test_page_runs_stream_reads_new_files_once(spark, folder, tmp_path):
    spark.dataSource.register(page_runs.PageRuns)
    (tmp_path / "in").mkdir()
    shutil.copy(f"{folder}/a.txt", tmp_path / "in")
    out, seen = str(tmp_path / "out"), []

    def run():
        q = (spark.readStream.format("page_runs").option("filesPerBatch", 1).load(str(tmp_path / "in")).writeStream
             .foreachBatch(lambda df, _: seen.extend((os.path.basename(r.doc_id), r.page, r.text) for r in pdf.page_texts(df).collect()))
             .option("checkpointLocation", out).start())
        q.processAllAvailable()
        q.stop()

    run()
    assert sorted(seen) == [("a.txt", 1, "eins"), ("a.txt", 2, "zwei")]
    shutil.copy(f"{folder}/packed.pdf", tmp_path / "in")
    run()
    assert sorted(seen) == [("a.txt", 1, "eins"), ("a.txt", 2, "zwei"), *(("packed.pdf", p, t) for p, t in WANT.items())]


def read_back(spark, path):
    got = {}
    for c in files.cells(files.binary_files(spark, str(path))).collect():
        got.setdefault(c.sheet, {})[c.row, c.col] = c.value
    return got


def test_workbook_round_trip(spark, tmp_path):
    rows = spark.range(2500).select(F.col("id").alias("nr"), F.concat(F.lit("Posten <&> "), "id").alias("label"), (F.col("id") / 4).alias("value"), F.when(F.col("id") % 2 == 0, True).alias("flag")).repartition(7)
    done = rows.limit(1).select(workbook.formula(F.lit('IF(J2<>"",J2,M2)')).alias("final"))
    path = str(tmp_path / "r.xlsx")
    workbook.write({"all": rows, "a/b": done, "empty": rows.where("false")}, path, choices={"all": ["D", ["Ja", "Nein"]]}, order={"all": [F.col("nr")]})
    got = read_back(spark, path)
    assert got["all"][1, 2] == "label" and got["all"][2, 2] == "Posten <&> 0" and got["all"][2501, 1] == "2499.0"
    assert len({r for r, _ in got["all"]}) == 2501 and got["all"][6, 3] == "1.0" and (3, 4) not in got["all"]
    assert got["a b"] == {(1, 1): "final"} and got["empty"][1, 1] == "nr"
    book = zipfile.ZipFile(path)
    assert b"<f>IF(J2&lt;&gt;" in book.read("xl/worksheets/sheet2.xml") and b"dataValidation " in book.read("xl/worksheets/sheet1.xml")
    assert [p for p in os.listdir(tmp_path)] == ["r.xlsx"]


def test_workbook_goes_on_in_further_sheets(tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "MOST_ROWS", 100)
    monkeypatch.setattr(workbook, "PART_ROWS", 40)
    w = workbook.Writer({"path": str(tmp_path / "w.xlsx")}, True)
    store, root = w._at(w.staging)
    store.create_dir(root)
    parts = []
    for k in range(6):
        with store.open_output_stream(f"{root}/{k}") as out:
            out.write(b"<row/>" * 40)
        parts.append((0, "s", str(k), 40))
    with store.open_output_stream(f"{root}/lost") as out:  # of an attempt that failed
        out.write(b"<row/>" * 40)
    w.commit([workbook.Written(1, parts[3:]), None, workbook.Written(0, parts[:3])])
    book = zipfile.ZipFile(tmp_path / "w.xlsx")
    assert [book.read(f"xl/worksheets/sheet{k}.xml").count(b"<row/>") for k in (1, 2, 3)] == [80, 80, 80]
    assert not os.path.exists(w.staging) and b'name="s (3)"' in book.read("xl/workbook.xml")


def test_workbook_survives_a_task_that_fails(tmp_path):
    """Tasks fail at their first attempt and are run again, as on a cluster; the workbook has every row once."""
    import subprocess
    import sys

    code = f'''
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession, functions as F
from saldora import workbook
s = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").getOrCreate()
s.sparkContext.setLogLevel("OFF")
class Flaky(workbook.Writer):
    def write(self, iterator):
        from pyspark import TaskContext
        told = super().write(iterator)
        if TaskContext.get().attemptNumber() == 0:
            raise RuntimeError("lost after its parts were written")
        return told
class Book(workbook.Workbook):
    def writer(self, schema, overwrite):
        return Flaky(dict(self.options), overwrite)
s.dataSource.register(Book)
df = workbook.sheets({{"x": s.range(300).withColumn("t", F.lit("v"))}}, {{"x": [F.col("id")]}})
df.write.format("workbook").mode("overwrite").save({str(tmp_path / "f.xlsx")!r})
'''
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    cells = files.xlsx_cells((tmp_path / "f.xlsx").read_bytes())
    assert [float(v) for _, _, r, c, v in cells if c == 1 and r > 1] == [float(k) for k in range(300)]
    assert os.listdir(tmp_path) == ["f.xlsx"]


def test_existing_sheets_go_into_workbooks(spark, tmp_path):
    rows = spark.createDataFrame([("p", 1, "x", 2.0, 1.0, "DEVIATION")], "pair_id string, cur_ord long, label string, value_current double, value_prior double, status string")
    text = spark.createDataFrame([("p", "neu", "NEW")], "pair_id string, current string, status string")
    workbook.write(sinks.yoy_sheets(rows, text), str(tmp_path / "y.xlsx"))
    got = read_back(spark, tmp_path / "y.xlsx")
    assert set(got) == {"overview", "all", "deviations", "only_current", "only_prior", "text_new", "text_missing", "text_changed"}
    assert got["deviations"][2, 3] == "x" and got["text_new"][2, 2] == "neu"


def test_texts_recognised_before(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"12345")
    (tmp_path / "b.pdf").write_bytes(b"123")
    (tmp_path / "a.pdf.texts.json").write_text('{"size": 5, "texts": ["eins", "zwei"]}')
    (tmp_path / "b.pdf.texts.json").write_text('{"size": 9, "texts": ["alt"]}')
    f = files.binary_files(spark, str(tmp_path), "*.pdf")
    key = f.select(F.concat_ws("_", "length", F.left(F.sha2("content", 256), F.lit(20))).alias("key"), F.array(F.lit("aus dem Speicher")).alias("texts"))
    got = {(os.path.basename(r.doc_id), r.page): r.text for r in files.cached_texts(f, key, files.sidecars(spark, str(tmp_path))).collect()}
    assert got == {("a.pdf", 1): "eins", ("a.pdf", 2): "zwei", ("b.pdf", 1): "aus dem Speicher"}
