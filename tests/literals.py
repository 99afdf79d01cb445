"""Operators on literal documents, with the rows they must give, worked out by hand."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixtures import frame, values
from saldora import schemas as S
from saldora import sinks
from saldora.functions import text as T
from saldora.operators import align, checklist, items, ranges, reconcile, rules, sections, vouch, yoy
from saldora.sources import checklists, files

QUERIES, SQL = {}, {}


def query(sql):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add

_KEYED = "pair_id string, item_ord long, key string, opening double, closing double"


@query(values("pair_id, cur_ord, pri_ord, score", [("p", 1, 11, 0.8), ("p", 6, 15, 0.8)]))
def yoy_unique_value(spark, sf_dir):
    cur = frame(spark, _KEYED, [("p", 1, "a", 100.5, None), ("p", 2, "b", 100.5, None), ("p", 3, "c", 0.0, None), ("p", 4, "d", 7.0, None), ("p", 5, "e", 55.0, None), ("p", 6, "f", 821.75, None)])
    pri = frame(spark, _KEYED, [("p", 11, "k", None, 100.5), ("p", 12, "l", None, 0.0), ("p", 13, "m", None, 7.0), ("p", 14, "n", None, 7.0), ("p", 15, "o", None, 4821.75), ("p", 16, "q", None, 55.0)])
    return yoy.by_value(cur, pri, frame(spark, "pair_id string, key string, used_at long", [("p", "q", 2)]))


@query(values("pair_id, cur_ord, pri_ord, score", [("p", 1, 11, 0.9)]))
def yoy_suffix_match(spark, sf_dir):
    cur = frame(spark, _KEYED, [("p", 1, "verbindlichkeitenausliefersammelkontolieferanten", 1.0, None), ("p", 2, "kurz", 1.0, None), ("p", 3, "12345reisespesenaufwand", 1.0, None)])
    return yoy.by_suffix(cur, frame(spark, _KEYED, [("p", 11, "sammelkontolieferanten", None, 1.0), ("p", 12, "reisespesenaufwand", None, 1.0)]))


@query(values("pair_id, cur_ord, pri_ord", [("p", 1, 11)]))
def yoy_fuzzy_label(spark, sf_dir):
    cur = frame(spark, _KEYED, [("p", 1, "rueckstellungfuerabfertigungen", 1.0, None), ("p", 2, "forderungen", 1.0, None)])
    pri = frame(spark, _KEYED, [("p", 11, "rueckstellungfuerabfertigung", None, 1.0), ("p", 12, "forderungsverluste", None, 1.0)])
    return yoy.by_ratio(cur, pri).select("pair_id", "cur_ord", "pri_ord")

_SHAPES = [("double row", [1.0, 2.0, 3.0], [4.0, 5.0, 6.0], True), ("schedule", [10.0, -1.0, 2.0, 11.0], [], False), ("simple", [5.0], [4.0], False), ("no prior", [5.0, 6.0], [], False), ("empty", [], [], False)]


@query(values("name, opening, closing", [("double row", 6.0, 3.0), ("schedule", 10.0, 11.0), ("simple", 4.0, 5.0), ("no prior", None, 5.0), ("empty", None, None)]))
def opening_closing(spark, sf_dir):
    v = [F.col(c) for c in ("cur", "pri", "dbl")]
    return frame(spark, "name string, cur array<double>, pri array<double>, dbl boolean", _SHAPES).select("name", T.opening_value(*v).alias("opening"), T.closing_value(*v).alias("closing"))


@query(values("a, b, same", [(100.0, 100.004, True), (100.0, 100.01, False), (4821.75, 821.75, True), (-415.08, 415.08, True), (4821.75, -821.75, False), (7052.18, 52.18, False), (1.5, 0.5, False), (10.5, 0.5, True), (5.0, None, False)]))
def ocr_artifacts(spark, sf_dir):
    rows = [(100.0, 100.004), (100.0, 100.01), (4821.75, 821.75), (-415.08, 415.08), (4821.75, -821.75), (7052.18, 52.18), (1.5, 0.5), (10.5, 0.5), (5.0, None)]
    return frame(spark, "a double, b double", rows).select("a", "b", T.values_match(F.col("a"), F.col("b")).alias("same"))


@query(values("token, v", [("1.234,56", 1234.56), ("12345", 12345.0), ("-7,5", -7.5), ("(1.000)", -1000.0), ("(-3,00)", -3.0), ("abc", None), ("", None)]))
def german_number_parse(spark, sf_dir):
    return frame(spark, "token string", [("1.234,56",), ("12345",), ("-7,5",), ("(1.000)",), ("(-3,00)",), ("abc",), ("",)]).select("token", T.parse_number(F.col("token")).alias("v"))

_LINES = [
    ("Lizenzen 1.111.222,33 444.555,66 777.888,99", "Lizenzen", [1111222.33, 444555.66, 777888.99]), ("Erläuterungen zu einzelnen Posten", "Erläuterungen zu einzelnen Posten", []),
    ("4711 Halle Lindenallee 9 5.432,10 5.432,10", "4711 Halle Lindenallee 9", [5432.1, 5432.1]), ("Sonstige Rückstellungen: 1.234,00 EUR", "Sonstige Rückstellungen", [1234.0]),
    ("Angestellte 57 61", "Angestellte", [57.0, 61.0]), ("Typ-41 Geräte 5,00", "Typ-41 Geräte", [5.0]), ("Verlust (12,50) -3,00 **", "Verlust", [-12.5, -3.0])]


@query(values("line, label, v", _LINES))
def trailing_numbers(spark, sf_dir):
    got = T.label_and_numbers(F.col("line"))
    return frame(spark, "line string", [(x[0],) for x in _LINES]).select("line", got["label"].alias("label"), got["values"].alias("v"))


@query(values("line, fixed", [("B2.468,10", "2.468,10"), ("951,.37", "951,37"), ("321.654, 98 x", "321.654,98 x"), ("555.123 45", "555.123,45"), ("12,345,67", "12.345,67"), ("8642.13", "8642,13"), ("83 00 83 00", "83 00 83 00"), ("1.234,56", "1.234,56")]))
def number_repair(spark, sf_dir):
    return frame(spark, "line string", [("B2.468,10",), ("951,.37",), ("321.654, 98 x",), ("555.123 45",), ("12,345,67",), ("8642.13",), ("83 00 83 00",), ("1.234,56",)]).select("line", T.repair_numbers(F.col("line")).alias("fixed"))


@query(values("line, parts", [("Kassa 1,00 2,00 Bank 3,00 4,00", ["Kassa 1,00 2,00 ", "Bank 3,00 4,00"]), ("Darlehen 5,00 Muster", ["Darlehen 5,00 Muster"])]))
def glued_lines(spark, sf_dir):
    return frame(spark, "line string", [("Kassa 1,00 2,00 Bank 3,00 4,00",), ("Darlehen 5,00 Muster",)]).select("line", T.unglue(F.col("line")).alias("parts"))

_LABELS = [("1.2.3 Anlagevermögen", "anlagevermoegen"), ("A.II.1. Sachanlagen", "sachanlagen"), ("41300 Kautionen Lager", "kautionen lager"), ("Rücklage für Umbauten K", "ruecklage fuer umbauten"), ("3 Monate", "3 monate"), ("• Übrige", "uebrige"), ("2025 2024", "2025 2024")]


@query(values("label, key", _LABELS))
def label_normalise(spark, sf_dir):
    return frame(spark, "label string", [(x,) for x, _ in _LABELS]).select("label", T.normalise_label(F.col("label")).alias("key"))

_NOTES = "Aktiva\n\nSachanlagen 100,00 90,00\n1. Wertpapiere des\n8310 Anlagevermögens 10,00 8,00\nSUMME AKTIVA 110,00 98,00\nForderungen gegenüber Kunden 5,00\nVorjahr 4,00\nUmsatz 7 Mio (Vorjahr: 6)"


@query(values("item_ord, label, cur, pri", [(0, "Sachanlagen", [100.0], [90.0]), (1, "8310 1. Wertpapiere des Anlagevermögens", [10.0], [8.0]), (2, "SUMME AKTIVA", [110.0], [98.0]), (3, "Forderungen gegenüber Kunden", [5.0], [4.0]), (4, "AKTIVA Forderungen gegenüber Kunden Vorjahr Umsatz", [7.0], [6.0])]))
def line_items(spark, sf_dir):
    found = items.extract_items(frame(spark, S.PAGES, [("d", 1, _NOTES)]))
    return found.select("item_ord", "label", F.col("current_values").alias("cur"), F.col("prior_values").alias("pri"))


@query(values("label, cur, pri, double_row", [("Grundstücke und Bauten", [1.0, 2.0, 9.0], [1.0, 2.0, 8.0], True), ("Maschinen und Anlagen", [3.0, 4.0, 7.0], [3.0, 4.0, 6.0], True)]))
def asset_schedule(spark, sf_dir):
    page = "Anschaffungskosten Stand Buchwert\nGrundstücke und Bauten 1,00 2,00 8,00\n1,00 2,00 9,00\n12 Maschinen und Anlagen 3,00 4,00 6,00\n3,00 4,00 7,00"
    found = items.extract_items(frame(spark, S.PAGES, [("d", 1, page)]))
    return found.select("label", F.col("current_values").alias("cur"), F.col("prior_values").alias("pri"), "double_row")


@query(values("doc_id, first, last", [("a", 2, 3), ("b", 1, 2), ("c", 1, 3)]))
def notes_page_range(spark, sf_dir):
    rows = [("a", 1, "Bilanz"), ("a", 2, "x\nAnhang\n"), ("a", 3, "Text"), ("a", 4, "Lagebericht 2024"), ("b", 1, "x"), ("b", 2, None), ("c", 1, "Anhang zum Abschluss"), ("c", 2, "Bilanzierung im sehr langen Satz, der kein Ende anzeigt"), ("c", 3, "y")]
    return ranges.notes_range(frame(spark, S.PAGES, rows))


@query(values("doc_id, first, last", [("a", 1, 2), ("b", 1, 2)]))
def statement_page_range(spark, sf_dir):
    rows = [("a", 1, "Allgemeine Auftragsbedingungen ..... 3"), ("a", 2, "x"), ("a", 3, "Allgemeine Auftragsbedingungen " + "y" * 4000), ("b", 1, "x"), ("b", 2, "y")]
    return ranges.statement_range(frame(spark, S.PAGES, rows))


@query(values("doc_id, section_no, title, type", [("a", 1, "1. Allgemeine Angaben", "GENERAL"), ("a", 3, "VERBINDLICHKEITEN", "LIABILITIES"), ("b", 0, None, "OTHER"), ("c", 1, "Hinweise zur Bewertung", "METHODS")]))
def detected_sections(spark, sf_dir):
    long = "Text " * 12
    docs = [("a", f"1. Allgemeine Angaben\n{long}\n2. Leer\nkurz\nVERBINDLICHKEITEN\n{long}"), ("b", "nur ein kurzer text"), ("c", f"Vorwort\nHinweise zur Bewertung\n{long}")]
    return sections.detect_sections(frame(spark, "doc_id string, text string", docs)).select("doc_id", F.col("section_no"), "title", "type")

_OLD = [("p", 0, "Die Gesellschaft bilanziert nach den Grundsätzen ordnungsmäßiger Buchführung.", 1), ("p", 1, "Die Vorräte werden zu Anschaffungskosten bewertet und regelmäßig geprüft.", 1), ("p", 2, "Rechtsstreitigkeiten bestanden im abgelaufenen Jahr keine wesentlichen.", 2)]

_NOW = [("p", 0, "Die Vorräte werden zu Herstellungskosten bewertet und jährlich geprüft.", 1), ("p", 1, "Die Gesellschaft bilanziert nach den Grundsätzen ordnungsmäßiger Buchführung.", 1), ("p", 2, "Erstmals wurde ein Nachhaltigkeitsbericht erstellt und öffentlich aufgelegt.", 2)]

_PARS = "pair_id string, par_ord long, text string, page int"


@query(values("rank, status, i, j", [(1, "MISSING", None, 2), (2, "CHANGED", 0, 1), (3, "NEW", 2, None), (4, "SAME", 1, 0)]))
def paragraph_pairs(spark, sf_dir):
    rows = align.align(frame(spark, _PARS, _NOW), frame(spark, _PARS, _OLD))
    return align.ranked(rows).select("rank", "status", "i", "j")


@query(values("pair_id, i, j", [("g", 1, 2), ("g", 2, 1), ("g", 3, 3)]))
def greedy_pairs(spark, sf_dir):
    edges = [("g", 1, 1, 0.9), ("g", 1, 2, 0.95), ("g", 2, 2, 0.94), ("g", 2, 1, 0.7), ("g", 3, 1, 0.7), ("g", 3, 3, 0.65)]
    return align.greedy(frame(spark, "pair_id string, i long, j long, r double", edges)).select("pair_id", "i", "j")


@query(values("current, prior, excerpt", [("a b c", "a b c", ""), ("a", "", "only current"), ("", "b", "only prior"), ("der Wert steigt stark", "der Wert fällt stark", "current: steigt || prior: fällt"), ("a .", "a ,", "only numbers or signs")]))
def text_diff(spark, sf_dir):
    rows = [("a b c", "a b c"), ("a", ""), ("", "b"), ("der Wert steigt stark", "der Wert fällt stark"), ("a .", "a ,")]
    return align.with_excerpt(frame(spark, "current string, prior string", rows))


@query(values("pair_id, name, status", [("p", "Anlagenspiegel", "SAME"), ("p", "Forderungenspiegel", "NEW"), ("p", "Verbindlichkeitenspiegel", "MISSING")]))
def table_presence(spark, sf_dir):
    find = lambda t: align.tables_in(frame(spark, S.PAGES, [("p", 1, t)])).withColumnRenamed("doc_id", "pair_id")
    return align.table_presence(find("Buchwert und Anschaffungskosten. Forderungen nach Restlaufzeit"), find("Anschaffung\nBuchwert\nVerbindlichkeiten Restlaufzeit"))

_STAFF = "Durchschnittliche Zahl der Arbeitnehmer\nArbeiter 11 9\nAngestellte 57 61\nGesamt 68 70"


@query(values("doc_id, section, current_value, prior_value, page", [("d", "Haftungsverhaeltnisse", 1500.0, 1400.0, 1), ("d", "Arbeitnehmer", 68.0, 70.0, 2)]))
def disclosed_positions(spark, sf_dir):
    rows = [("d", 1, "Gesamtbetrag der Haftungsverhältnisse\n1.500,00 1.400,00"), ("d", 2, _STAFF), ("d", 3, "Gesamt 5 6")]
    return vouch.positions(frame(spark, S.PAGES, rows)).select("doc_id", "section", "current_value", "prior_value", "page")


@query(values("doc_id, value, source_line", [("d", 123987.45, "SUMME EURGGW 123.987,45")]))
def bank_statement_total(spark, sf_dir):
    rows = [("d", "bank.pdf", 1, "Konto 1,00\nSUMME EUR 12,00"), ("d", "bank.pdf", 2, "SUMME EURGGW 123.987,45\nTotal EUR")]
    return vouch.bank_totals(frame(spark, "doc_id string, filename string, page int, text string", rows)).select("doc_id", "value", "source_line")


@query(values("filename, value, sheet", [("a.xlsx", 41.0, "Blatt"), ("b.xlsx", 7.0, "Summary")]))
def head_count_workbook(spark, sf_dir):
    rows = [("d", "a.xlsx", "Blatt", 0, 2, 1, "AT01 Muster"), ("d", "a.xlsx", "Blatt", 0, 2, 2, "41"), ("d", "a.xlsx", "Blatt", 0, 3, 1, "Gesamt"), ("d", "a.xlsx", "Blatt", 0, 3, 2, "99"), ("d", "b.xlsx", "Detail", 0, 1, 1, "Gesamt"), ("d", "b.xlsx", "Detail", 0, 1, 2, "8"), ("d", "b.xlsx", "Summary", 1, 1, 1, "Gesamt"), ("d", "b.xlsx", "Summary", 1, 1, 2, "7")]
    return vouch.head_counts(frame(spark, "doc_id string, path string, sheet string, sheet_ord int, row int, col int, value string", rows), ("AT01",)).select("filename", "value", "sheet")

_IT = "doc_id string, item_ord long, label string, page int, current_values array<double>, prior_values array<double>"


@query(values("item_ord, label, front_value, notes_value, status, rank", [(3, "Bankguthaben gesamt Inland", 100.0, 5000.0, "DEVIATION", 1), (1, "Sonstige Rückstellungen", 100.0, 100.0, "OK", 2), (2, "Verbindlichkeiten Lieferanten", 30.0, 30.0, "OK", 3)]))
def internal_reconcile(spark, sf_dir):
    notes = [("d", 1, "Sonstige Rückstellungen", 5, [100.2], []), ("d", 2, "Verbindlichkeiten Lieferanten", 5, [30.0], []), ("d", 3, "Bankguthaben gesamt Inland", 6, [5000.0], []), ("d", 4, "Mitarbeiterbeteiligung", 6, [5000.0], []), ("d", 5, "kurz", 6, [1.0], [])]
    front = [("d", 1, "Sonstige Rückstellungen", 1, [100.0, 90.0], []), ("d", 2, "Verbindlichkeiten Lieferanten A", 1, [10.0], []), ("d", 3, "Verbindlichkeiten Lieferanten B", 1, [20.0], []), ("d", 4, "Bankguthaben gesamt Inland", 2, [100.0], []), ("d", 5, "Mitarbeiterbeteiligung", 2, [7.0], [])]
    out = reconcile.reconcile(frame(spark, _IT, notes), frame(spark, _IT, front))
    return out.select("item_ord", "label", "front_value", "notes_value", "status", "rank")


def _questions(spark) -> DataFrame:
    rows = [
        ("q1", "Vorräte", "Sind die Vorräte beschrieben?", ["vorratsbewertung"], ["alle"], [], True), ("q2", "Allgemein", "Ist die Wertpapierbewertung angegeben?", ["wertpapierbewertung"], [], ["AG groß; GmbH mittel"], True),
        ("q3", "Allgemein", "Gibt es Angaben?", [], ["klein"], [], True), ("q4", "Allgemein", "Sind die Arbeitnehmer angegeben?", ["arbeitnehmer"], [], [], False), ("q5", "Allgemein", "Sind die Rückstellungen aufgegliedert?", ["rückstellungen"], [], [], True)]
    s = "item_id string, category string, description string, keywords array<string>, applicable_to array<string>, size_classes array<string>, relevant boolean"
    return frame(spark, s, rows)


def _documents(spark) -> DataFrame:
    return frame(spark, "doc_id string, legal_form string, size_class string, text string", [("d", "gmbh", "mittel", "Die Rückstellungen betreffen Urlaube und sonstige Posten.")])


def _review(spark) -> DataFrame:
    return checklist.company_scope(checklist.blank_result(_questions(spark), _documents(spark)))

_TRIGGERS = [("vorräte", ["vorräte", "handelswaren"])]


@query(values("item_id, status", [("q1", "NOT_ASSESSABLE"), ("q2", "NOT_ASSESSABLE"), ("q3", "NOT_APPLICABLE"), ("q4", "NOT_APPLICABLE"), ("q5", "NOT_ASSESSABLE")]))
def scope_filter(spark, sf_dir):
    return _review(spark).select("item_id", "status")


@query(values("item_id, status, reason", [("q1", "NOT_APPLICABLE", "machine: no such position (vorräte, handelswaren)"), ("q2", "NOT_APPLICABLE", "machine: no such case (wertpapier)"), ("q3", "NOT_APPLICABLE", "not required for gmbh mittel"), ("q4", "NOT_APPLICABLE", "marked as not relevant in the programme"), ("q5", "NOT_ASSESSABLE", "")]))
def topic_filter(spark, sf_dir):
    t = frame(spark, "key string, words array<string>", _TRIGGERS)
    return checklist.topic_scope(_review(spark), t, [("wertpapier", ["wertpapier"])], documents=_documents(spark)).select("item_id", "status", "reason")


@query(values("item_id, status, quote, missing", [("q1", "NOT_COMPLIANT", None, "Sind die Vorräte beschrieben?"), ("q2", "NOT_COMPLIANT", None, "Ist die Wertpapierbewertung angegeben?"), ("q3", "NOT_APPLICABLE", None, None), ("q4", "NOT_APPLICABLE", None, None), ("q5", "NOT_ASSESSABLE", "Die Rückstellungen betreffen Urlaube und sonstige Posten.", None)]))
def evidence_verdict(spark, sf_dir):
    pars = frame(spark, "doc_id string, par_ord long, text string, page int", [("d", 0, "Allgemeines zur Firma. Die Rückstellungen betreffen Urlaube und sonstige Posten.", 3)])
    return checklist.verdicts(_review(spark), pars, documents=_documents(spark)).select("item_id", "status", "quote", "missing")


@query(values("doc_id, status", [("full", "COMPLIANT"), ("half", "PARTIAL"), ("none", "NOT_COMPLIANT"), ("bare", "NOT_ASSESSABLE")]))
def employees_rule(spark, sf_dir):
    rows = [("full", "Durchschnittliche Zahl der Arbeitnehmer: Arbeiter 3, Angestellte 5 (Vorjahr 4)"), ("half", "Im Durchschnitt 8 Arbeitnehmer"), ("none", "Nichts davon"), ("bare", "Arbeitnehmer")]
    return rules.employees_rule(frame(spark, "doc_id string, text string", rows)).select("doc_id", "status")


@query(values("doc_id, status", [("a", "COMPLIANT"), ("b", "PARTIAL"), ("c", "NOT_ASSESSABLE"), ("d", "COMPLIANT")]))
def participation_rule(spark, sf_dir):
    rows = [("a", "Muster Bau GmbH, Wien, 100 %, Eigenkapital 5, Jahresüberschuss 1"), ("b", "Muster Bau GmbH 50 %"), ("c", "keine"), ("d", "Muster Bau GmbH 50 % (Schutzklausel)")]
    return rules.participation_rule(frame(spark, "doc_id string, text string", rows))


@query(values("source_id, allowed, issues, rank", [("s1", True, [], 0), ("s2", False, ["citation missing"], 3), ("s3", True, ["title missing", "url missing"], 4), ("s4", False, ["authority unknown", "url missing"], 7)]))
def source_policy(spark, sf_dir):
    rows = [("s1", "LAW", "t", "c", "u", 9999), ("s2", "STANDARD", "t", "", "u", 101), ("s3", "COMMENTARY", None, "c", None, 50), ("s4", "X", "t", "c", None, 1)]
    src = frame(spark, "source_id string, authority string, title string, citation string, url string, words int", rows)
    return src.select("source_id", rules.storage_allowed(F.col("authority"), F.col("words")).alias("allowed"), rules.metadata_issues().alias("issues"), rules.authority_rank(F.col("authority")).alias("rank"))


@query(values("rule_id, authority, citations, rank", [("r1", "LAW", ["§ 1", "§ 2"], 0), ("r1", "COURT", ["OGH 1"], 1)]))
def audit_trail(spark, sf_dir):
    links = frame(spark, "rule_id string, source_id string, component string, ord int", [("r1", "a", "x", 1), ("r1", "b", "x", 2), ("r1", "c", "x", 3), ("r1", "a", "x", 4)])
    src = frame(spark, "source_id string, authority string, citation string", [("a", "LAW", "§ 2"), ("b", "LAW", "§ 1"), ("c", "COURT", "OGH 1")])
    return rules.audit_trail(links, src)


@query(values("number, content", [("1", "§ 1 Neu\nzwei"), ("2a", "§ 2a Text\nmehr")]))
def statute_split(spark, sf_dir):
    text = "Vorwort\n§ 1 Alt\n§ 2a Text\nmehr\n§ 1 Neu\nzwei"
    return sections.statute_paragraphs(frame(spark, "doc_id string, text string", [("u", text)])).select("number", "content")


@query(values("line_no, text", [(0, "links rechts"), (1, "unten")]))
def scanned_lines(spark, sf_dir):
    rows = [("d", 1, 50.0, 10.0, "rechts"), ("d", 1, 5.0, 14.0, "links"), ("d", 1, 5.0, 60.0, "unten")]
    return sections.scan_lines(frame(spark, "doc_id string, page int, x double, y double, text string", rows)).select("line_no", "text")


@query(values("text, refs", [("nach § 238 Abs. 1 und §§ 12 sowie Paragraph 7, § 238 Abs. 1", ["§ 238 Abs. 1", "§§ 12", "Paragraph 7"]), ("nichts", [])]))
def legal_references(spark, sf_dir):
    rows = [("nach § 238 Abs. 1 und §§ 12 sowie Paragraph 7, § 238 Abs. 1",), ("nichts",)]
    return frame(spark, "text string", rows).select("text", T.legal_references(F.col("text")).alias("refs"))


@query(values("path, suffix, ok", [("/a/b.PDF", ".pdf", True), ("x.docx", ".docx", True), ("t.xlsx", ".xlsx", False), ("none", "", False)]))
def readable_files(spark, sf_dir):
    return frame(spark, "path string", [("/a/b.PDF",), ("x.docx",), ("t.xlsx",), ("none",)]).select("path", files.suffix(F.col("path")).alias("suffix"), files.can_read(F.col("path")).alias("ok"))


@query(values("item_id, category, relevant, kw", [("1", "Steuern", False, ["a", "b"]), ("2", "Personal", True, [])]))
def checklist_workbook(spark, sf_dir):
    c = lambda sheet, k, rows: [("w.xlsx", sheet, k, r, i, v) for r, row in enumerate(rows, 1) for i, v in enumerate(row, 1) if v]
    cells = c("Start", 0, [["Nr", "Kategorie", "Anzahl", "Relevant"], ["1", "Steuern", "1", "nein"], ["2", "Personal", "1", "ja"]]) + c("Alle", 1, [["ID", "Kategorie", "Frage", "Stichworte"], ["1", "", "Steuern da?", "a; b"], ["2", "Personal", "Personal da?", ""]]) + c("Steuern", 2, [["ID", "Kategorie", "Frage"], ["1", "", "Steuern da?"]])
    return checklists.from_cells(frame(spark, S.CELLS, cells)).select("item_id", "category", "relevant", F.col("keywords").alias("kw"))


@query(values("n, shown", [(1, "kurz"), (2, "…und dort die Pauschalwertberichtigung zum Stichtag…")]))
def quote_windows(spark, sf_dir):
    rows = [(1, "kurz"), (2, "Zuerst steht hier sehr viel anderer Text und dort die Pauschalwertberichtigung zum Stichtag und danach noch mehr Text")]
    shown = checklist.quote_window(F.col("s"), F.array(F.lit("pauschalwertberichtigung")), 50)
    return frame(spark, "n int, s string", rows).select("n", shown.alias("shown"))


@query(values("doc_id, item_id, n_sections, n_quotes, refs, status", [("d", "q1", 1, 2, 1, "COMPLIANT"), ("d", "q2", 1, 1, 0, "PARTIAL")]))
def requirement_match(spark, sf_dir):
    sec = frame(spark, "doc_id string, section_no int, content string", [("d", 1, "Rückstellungen\nnach § 9 gebildet\nEnde"), ("d", 2, "Sonstiges\nVorräte zu Kosten")])
    ask = frame(spark, "item_id string, keywords array<string>, references array<string>", [("q1", ["rückstellungen"], ["§ 9"]), ("q2", ["vorräte", "fehlt", "nirgends"], ["§ 1"]), ("q3", ["ganz anders"], [])])
    out = checklist.match_sections(ask, sec)
    return out.select("doc_id", "item_id", F.size("sections").alias("n_sections"), F.size("quotes").alias("n_quotes"), "refs", "status")


@query(values("quote, page", [("zweite Seite", 2), ("fehlt", None)]))
def quote_pages(spark, sf_dir):
    pages = frame(spark, S.PAGES, [("d", 1, "erste Seite"), ("d", 2, "die zweite Seite"), ("d", 3, "zweite Seite")])
    return sections.page_of_quote(frame(spark, "doc_id string, quote string", [("d", "zweite Seite"), ("d", "fehlt")]), pages).select("quote", "page")


@query(values("rule_id, caveat, adequate", [("r1", "", True), ("r2", "opinion of an author", False)]))
def source_adequacy(spark, sf_dir):
    links = frame(spark, "rule_id string, source_id string, component string, ord int", [("r1", "a", "x", 1), ("r1", "c", "x", 2), ("r2", "c", "x", 3)])
    src = frame(spark, "source_id string, authority string", [("a", "LAW"), ("c", "COMMENTARY")])
    caveat = rules.combined_caveat(links.join(src, "source_id"))
    return caveat.join(rules.adequately_sourced(links.select("rule_id").distinct(), links, src), "rule_id")


@query(values("text", [("§ 5, Statute, p. 3",), ("AB 12, Handbook [opinion of an author]",)]))
def citations(spark, sf_dir):
    rows = [("LAW", "§ 5", "Statute", "p. 3"), ("COMMENTARY", "AB 12", "Handbook", None)]
    return frame(spark, "authority string, citation string, title string, place string", rows).select(rules.citation().alias("text"))


@query(values("item_id, evidence, tool, note, final", [("q1", None, "NOT_COMPLIANT", "missing: Sind die Vorräte beschrieben?", "NOT_COMPLIANT"), ("q5", "Die Rückstellungen betreffen Urlaube und sonstige Posten. (p. 3)", "NOT_ASSESSABLE", "found, please confirm", "NOT_ASSESSABLE")]))
def reviewer_sheet(spark, sf_dir):
    pars = frame(spark, "doc_id string, par_ord long, text string, page int", [("d", 0, "Allgemeines zur Firma. Die Rückstellungen betreffen Urlaube und sonstige Posten.", 3)])
    done = checklist.verdicts(_review(spark), pars, documents=_documents(spark))
    return sinks.checklist_sheet(done).where("item_id in ('q1', 'q5')").select("item_id", "evidence", "tool", "note", "final")


@query(values("item_id, section_no, title, quote, rank", [
    ("q1", 1, "Rückstellungen", "Rückstellungen nach § 9 gebildet", 1), ("q1", 1, "Rückstellungen", "Rückstellungen nach § 9 gebildet Ende", 2),
    ("q2", 2, "Sonstiges", "Die Bewertung der Vorräte folgt den Kosten der Anschaffung.", 1)]))
def section_evidence(spark, sf_dir):
    sec = frame(spark, "doc_id string, section_no int, title string, content string", [
        ("d", 1, "Rückstellungen", "Rückstellungen\nnach § 9 gebildet\nEnde"), ("d", 2, "Sonstiges", "Ein anderer Absatz.\n\nDie Bewertung der\nVorräte folgt den Kosten der Anschaffung.")])
    ask = frame(spark, "item_id string, keywords array<string>, references array<string>", [("q1", ["rückstellungen"], ["§ 9"]), ("q2", ["der\nvorräte"], [])])
    return checklist.section_evidence(checklist.match_sections(ask, sec), ask, sec).select("item_id", "section_no", "title", "quote", "rank")
