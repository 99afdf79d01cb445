"""Behaviour that the catalogue's literal documents do not cover."""

import io
import zipfile
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from saldora import schemas as S
from saldora import sinks
from saldora.functions import text as T
from saldora.operators import align, checklist, items, profiles, ranges, rules, vouch, yoy
from saldora.sources import checklists, files

ITEM = "pair_id string, item_ord long, label string, page int, current_values array<double>, prior_values array<double>, source_line string, double_row boolean"


def statement(spark, rows):
    return spark.createDataFrame([("p", k, label, 1, cur, pri, "", False) for k, (label, cur, pri) in enumerate(rows)], ITEM)


def statuses(df):
    return {r.label: r.status for r in df.collect()}


def test_item_without_opening_value_hides_its_partner(spark):
    got = yoy.compare(statement(spark, [("Sachanlagen im Bau", [5.0], [])]), statement(spark, [("Sachanlagen im Bau", [4.0], [])]))
    assert got.count() == 0


def test_real_loss_is_reported_once(spark):
    got = yoy.compare(statement(spark, [("Forderungen", [1.0], [2.0])]), statement(spark, [("Forderungen", [2.0], []), ("Wertpapiere", [9.0], [])]))
    assert statuses(got) == {"Forderungen": S.OK, "Wertpapiere": S.ONLY_PRIOR}


def test_text_suppresses_one_sided_rows(spark):
    pages = spark.createDataFrame([("p", 1, "… Wertpapiere des Umlaufs …")], "pair_id string, page int, text string")
    got = yoy.compare(statement(spark, []), statement(spark, [("Wertpapiere des Umlaufs", [9.0], []), ("Kurz", [1.0], [])]), yoy.packed_text(pages), None)
    assert statuses(got) == {"Kurz": S.ONLY_PRIOR}


def test_deviation_is_dropped_where_the_label_is_proven(spark):
    got = yoy.compare(statement(spark, [("Bauten", [1.0], [2.0]), ("Bauten", [1.0], [7.0])]), statement(spark, [("Bauten", [2.0], [])]))
    assert [r.status for r in got.collect()] == [S.OK]


@pytest.mark.parametrize("parts", [1, 7])
def test_items_do_not_depend_on_partitions(spark, parts):
    text = "EUR EUR\nErlöse Inland\n100,00 90,00\nLöhne und Gehälter 5,00 4,00\nvorjahr gesamt aufwand 3,00\nVorjahr 2,00\nVorjahr 1,00"
    pages = spark.createDataFrame([(f"d{k}", 1, text) for k in range(5)], S.PAGES).repartition(parts)
    got = items.extract_items(pages).where("doc_id = 'd3'").orderBy("item_ord").collect()
    assert [(r.label, r.current_values, r.prior_values) for r in got][:2] == [("Erlöse Inland", [100.0], [90.0]), ("Löhne und Gehälter", [5.0, 4.0], [3.0])]


def test_empty_and_null_pages(spark):
    pages = spark.createDataFrame([("a", 1, None), ("b", 1, "")], S.PAGES)
    assert items.extract_items(pages).count() == 0
    assert {r.doc_id: (r.empty, r.sparse) for r in ranges.text_yield(pages).collect()} == {"a": (True, False), "b": (True, False)}


def test_greedy_is_one_pass_over_sorted_edges(spark):
    edges = [(i, j, round(((i * 7 + j * 13) % 10) / 10, 1)) for i in range(8) for j in range(8)]
    used_i, used_j, want = set(), set(), set()
    for i, j, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            want.add((i, j))
    got = align.greedy(spark.createDataFrame([("p", *e) for e in edges], "pair_id string, i long, j long, r double"))
    assert {(r.i, r.j) for r in got.collect()} == want


def test_length_band_loses_no_pair(spark):
    keys = ["rueckstellungen" + "x" * k for k in range(0, 12)] + ["verbindlichkeiten" + "y" * k for k in range(3)]
    side = spark.createDataFrame([("p", k, x, 1.0, 1.0) for k, x in enumerate(keys)], "pair_id string, item_ord long, key string, opening double, closing double")
    got = {(r.cur_ord, r.pri_ord) for r in yoy.by_ratio(side, side.where("item_ord % 2 = 1")).collect()}
    for c, a in enumerate(keys):
        best = max(((SequenceMatcher(None, a, b).ratio(), -p) for p, b in enumerate(keys) if p % 2), default=None)
        if best[0] >= 0.95:
            assert (c, -best[1]) in got


def test_short_keys_meet_by_one_character(spark):
    keys = ["forderungen", "forderung", "forderungenx", "orderungen", "kd1234", "kd12345", "rueckstellungenfuerurlaube", "rueckstellungfuerurlaube", "rueckstellungenfuerurlauben"]
    side = spark.createDataFrame([("p", k, x, 1.0, 1.0) for k, x in enumerate(keys)], "pair_id string, item_ord long, key string, opening double, closing double")
    got = {(r.cur_ord, r.pri_ord): r.score for i in range(len(keys)) for r in yoy.by_ratio(side.where(f"item_ord <> {i}"), side.where(f"item_ord = {i}")).collect()}
    want = {(c, p): SequenceMatcher(None, a, b).ratio() for c, a in enumerate(keys) for p, b in enumerate(keys) if c != p and SequenceMatcher(None, a, b).ratio() >= 0.95}
    assert got == want and want


def test_paragraphs_without_a_common_word(spark):
    a = "konzernabschlusspruefer bestaetigte geschaeftsbericht vollinhaltlich"
    b = " ".join(w + "s" for w in a.split())
    one = lambda t: spark.createDataFrame([("p", 0, t, 1)], "pair_id string, par_ord long, text string, page int")
    assert [r.status for r in align.align(one(a), one(b)).collect()] == [S.SAME]


def test_many_glued_items_and_thousands(spark):
    line = " ".join(f"Posten{chr(97 + k)} {k + 1},00" for k in range(9))
    got = spark.createDataFrame([(line,)], "x string").select(T.unglue(F.col("x")).alias("p"), T.repair_numbers(F.lit("1234,567,89 und 1,234,567,89")).alias("r")).first()
    assert len(got.p) == 9 and got.r == "1234,567,89 und 1.234.567,89"


def docx(blocks):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = "".join(p(b) if isinstance(b, str) else "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in row) + "</w:tr>" for row in b) + "</w:tbl>" for b in blocks)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx_tables_are_pages_and_damage_is_a_row(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(["Anhang", "Text", [["Posten", "1,00"], ["€", ""]], "Ende"]))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "c.rtf").write_bytes(rb"{\rtf1 Z\'e4hler\par zwei}")
    read = files.pages(files.binary_files(spark, str(tmp_path)))
    got = {(r.doc_id[-6:], r.page): r.text for r in read.where("error is null").collect()}
    assert got == {("a.docx", 1): "Anhang\nText", ("a.docx", 2): "Posten   1,00", ("a.docx", 3): "Ende", ("/c.rtf", 1): "Zähler\nzwei"}
    assert files.skipped(read).count() == 1


def test_workbook_cells(spark, tmp_path):
    m = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{m}"><si><t>Gesamt</t></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{m}"><sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="AA2"><v>7</v></c></row></sheetData></worksheet>')
    got = files.cells(files.binary_files(spark, str(tmp_path))).collect()
    assert [(x.sheet, x.row, x.col, x.value) for x in got] == [("S", 2, 2, "Gesamt"), ("S", 2, 27, "7")]


def test_profile_needs_both_fields():
    assert checklist.require_profile(" GmbH ", "Mittel") == ("gmbh", "mittel")
    with pytest.raises(ValueError):
        checklist.require_profile("gmbh", None)


def test_profile_detection(spark):
    docs = [("a", "Die Muster GmbH ist eine kleine Kapitalgesellschaft"), ("b", "Muster AG mit Grundkapital und GmbH"), ("c", "nicht als kleine Kapitalgesellschaft"), ("d", "mittelgroße GmbH")]
    got = {r.doc_id: (r.legal_form, r.size_class) for r in checklist.detect_profile(spark.createDataFrame(docs, "doc_id string, text string")).collect()}
    assert got == {"a": ("gmbh", "klein"), "b": (None, None), "c": (None, None), "d": ("gmbh", "mittel")}


def test_answers_need_a_real_quote(spark):
    pars = spark.createDataFrame([("d", 0, "Die Wertpapiere sind zu Anschaffungskosten bewertet.")], "doc_id string, par_ord long, text string")
    found = spark.createDataFrame([("d", q, S.NOT_ASSESSABLE) for q in ("a", "b", "c")], "doc_id string, item_id string, status string")
    said = spark.createDataFrame([("d", "a", "ja", 0, "zu Anschaffungskosten bewertet", ""), ("d", "b", "ja", 0, "frei erfunden und lang genug", ""), ("d", "c", "ja", 9, "zu Anschaffungskosten bewertet", "")], "doc_id string, item_id string, verdict string, par_ord long, quote string, missing string")
    assert {r.item_id: r.status for r in checklist.confirm(found, said, pars).collect()} == {"a": S.COMPLIANT, "b": S.NOT_ASSESSABLE, "c": S.NOT_ASSESSABLE}


def test_sentences_keep_abbreviations(spark):
    df = spark.createDataFrame([("Die Rücklage nach § 5 Abs. Zwei ist gebildet. Der Betrag wurde bestätigt.",)], "t string")
    assert len(df.select(checklist.split_sentences(F.col("t")).alias("s")).first().s) == 2


def test_registry_reports_taken_keys():
    r = profiles.Registry()
    r.add(profiles.Profile("a", ("muster",)))
    r.add(profiles.Profile("b", ("Muster", "muster bau")))
    assert r.pick("Muster Bau GmbH").name == "b" and r.pick("sonst").name == "standard" and len(r.problems) == 1


def test_default_checklist_and_json_round_trip(spark, tmp_path):
    own = checklists.default_checklist(spark)
    (tmp_path / "c.json").write_text('{"name": "x", "items": [{"item_id": "1", "description": "q"}]}')
    got = checklists.from_json(spark, str(tmp_path / "c.json")).first()
    assert own.count() == 5 and got.item_id == "1" and got.keywords == [] and got.mandatory is True


def test_markdown_and_sheets(spark, tmp_path):
    rows = yoy.compare(statement(spark, [("Bauten", [1.0], [1234.5])]), statement(spark, [("Bauten", [2.0], [])]))
    assert "| Bauten | 1.234,50 | 2,00 |" in sinks.markdown(rows)
    sinks.write_sheets({"all": sinks.german_status(rows)}, str(tmp_path), "json")
    assert spark.read.json(str(tmp_path / "all")).first().status == "ABWEICHUNG"


def test_unbalanced_brackets_are_no_number(spark):
    df = spark.createDataFrame([("Umsatz (Vorjahr: 6)",), ("Verlust (6)",)], "x string")
    assert [r.v for r in df.select(T.trailing_numbers(F.col("x")).alias("v")).collect()] == [[], [-6.0]]


def test_inbox_streams_new_files(spark, tmp_path):
    from saldora.streaming import inbox

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("eins\fzwei")
    q = inbox.inbox(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("inbox_pages").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert {(r.page, r.text) for r in spark.table("inbox_pages").collect()} == {(1, "eins"), (2, "zwei")}


def test_unknown_status_is_an_error(spark):
    known = spark.createDataFrame([("OK",), (S.PARTIAL,), (None,)], "status string")
    assert [r.status for r in sinks.german_status(known).collect()] == ["OK", "TEILWEISE ENTSPRECHEND", None]
    with pytest.raises(Exception, match="unknown status: ODD"):
        sinks.german_status(spark.createDataFrame([("ODD",)], "status string")).collect()


def test_voucher_sheets_show_the_vouchers(spark):
    pos = spark.createDataFrame([("d", "Arbeitnehmer", "x", 1234.5, 1, "")], "doc_id string, section string, label string, current_value double, page int, note string")
    facts = spark.createDataFrame([("d", "hr_employees", "a", 1234.5, "f.xlsx")], "doc_id string, source_type string, label string, value double, filename string")
    sheets = sinks.voucher_sheets(vouch.check(pos, facts))
    assert [(r.status, r.vouchers) for r in sheets["detail"].collect()] == [("OK", "f.xlsx: 1.234,50")]
    assert [(r.doc_id, r.status, r.n) for r in sheets["overview"].collect()] == [("d", "OK", 1)]


def test_scope_takes_the_company_before_the_topics(spark):
    s = "doc_id string, item_id string, category string, description string, keywords array<string>, applicable_to array<string>, size_classes array<string>, relevant boolean, legal_form string, size_class string, text string, status string, reason string"
    row = lambda i, c, to: ("d", i, c, "Gibt es Angaben?", [], to, [], True, "gmbh", "mittel", "nichts davon", S.NOT_ASSESSABLE, "")
    triggers = spark.createDataFrame([("vorräte", ["handelswaren"])], "key string, words array<string>")
    got = checklist.scope(spark.createDataFrame([row("a", "Vorräte", ["klein"]), row("b", "Vorräte", []), row("c", "Anderes", [])], s), triggers, [])
    r = checklist.scope_summary(got).collect()[0]
    assert (r.by_law, r.by_machine, r.applicable, r.empty_categories) == (1, 1, 1, ["Vorräte"])


def test_long_lines_do_not_overflow(spark):
    """Patterns with a repeated group would go a call deeper for each repetition."""
    n = 100_000
    line = lambda c, t: spark.createDataFrame([(t,)], "x string").select(c).first()[0]
    many = "Posten " + "1.234,50 " * n
    got = line(T.label_and_numbers(F.col("x")), many)
    assert got["label"] == "Posten" and len(got["values"]) == n and got["values"][-1] == 1234.5
    assert len(line(T.trailing_numbers(F.col("x")), many + "Ende 3,00")) == 1
    assert line(T.without_units(F.col("x")), "Summe 5,00" + " EUR" * n + " ** ") == "Summe 5,00"
    assert line(T.is_noise(F.col("x")), "EUR " * n) is True and line(T.is_pair_header(F.col("x")), "TEUR " * n) is True
    assert line(T.repair_numbers(F.col("x")), "1" + ",234" * 5000 + ",56") == "1" + ".234" * 5000 + ",56"
    docs = spark.createDataFrame([("a", "Wort " * n + "GmbH 5 %"), ("b", "Wort " * n)], "doc_id string, text string")
    rows = rules.participations(docs).collect()
    assert [(r.doc_id, len(r["name"]), r.window) for r in rows] == [("a", 5 * n + 4, " 5 %")]


@pytest.mark.parametrize("text", [
    "Muster Bau GmbH, Wien und Neue AG Holding KG hält 5 % sowie klein GmbH", "xAbc GmbH; AG Wien; Bau & Co KG", "Eins GmbH Zwei AGnes drei Vier", "keine", "Muster GmbH" * 3, "A B c D SE. Ende Ltd"])
def test_participations_are_the_longest_runs(spark, text):
    import re

    pattern = re.compile(r"[A-ZÄÖÜ][\w&.\-]*(?:\s+[A-ZÄÖÜ&][\w&.\-]*)*\s+(?:GmbH|AG|KG|Ltd|Inc|SE)")
    found = list(pattern.finditer(text))
    want = [(k, m[0], text[m.end() : found[k + 1].start() if k + 1 < len(found) else None]) for k, m in enumerate(found)]
    got = rules.participations(spark.createDataFrame([("d", text)], "doc_id string, text string")).orderBy("n").collect()
    assert [(r.n, r["name"], r.window) for r in got] == want
