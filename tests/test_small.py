"""Small operators without a query of their own."""

from pyspark.sql import functions as F

from saldora import schemas as S
from saldora import sinks
from saldora.functions import similarity
from saldora.functions import text as T
from saldora.operators import align, checklist, ranges, vouch
from saldora.sources import checklists, files


def test_newest_files_of_folders(spark):
    paths = [("/k/a/Bericht 2022.pdf",), ("/k/a/Bericht 2024.pdf",), ("/k/a/Bericht 2023.pdf",), ("/k/b/Anhang 2021.docx",), ("/k/c/ohne.pdf",)]
    got = {r.folder: (r.newest, r.prior) for r in files.newest_by_year(spark.createDataFrame(paths, "path string")).collect()}
    assert got == {"/k/a": ("/k/a/Bericht 2024.pdf", "/k/a/Bericht 2023.pdf"), "/k/b": ("/k/b/Anhang 2021.docx", None)}


def test_ranges_are_clamped(spark):
    rows = spark.createDataFrame([(-2, 3, 5), (1, None, 5), (0, 9, 5)], "a int, b int, n int")
    got = rows.select(*[c.alias(x) for c, x in zip(ranges.clamp_range(F.col("a"), F.col("b"), F.col("n")), "xy")]).collect()
    assert [tuple(r) for r in got] == [(0, 3), (1, 5), (0, 5)]


def test_protocol_and_critical_findings(spark):
    rows = [("d", "Vorräte", "1", "Da?", S.NOT_COMPLIANT, "fehlt"), ("d", "Allgemein", "2", "Dort?", S.COMPLIANT, ""), ("d", "Vorräte", "3", "Hier?", S.NOT_ASSESSABLE, "")]
    f = spark.createDataFrame(rows, "doc_id string, category string, item_id string, description string, status string, reason string")
    said = sinks.protocol(f, top=2)
    assert "## Allgemein" in said and "- **1** Da? — NOT_COMPLIANT (fehlt)" in said and "only the first 2 findings" in said
    assert {r.item_id for r in sinks.critical(f).collect()} == {"1", "3"}


def test_narrative_and_segments(spark):
    text = "Die Gesellschaft bewertet ihre Vorräte zu den Kosten der Anschaffung.\nJedes Jahr wird der Bestand vor Ort vollständig gezählt.\n\nAnl. 1.234,56 7.890,12\nS\nDas Eigenkapital blieb im Jahr ohne jede Änderung bestehen."
    pages = spark.createDataFrame([("d", 1, text), ("e", 1, None)], S.PAGES)
    got = [r.text for r in align.narrative(pages).orderBy("par_ord").collect()]
    assert got == ["Die Gesellschaft bewertet ihre Vorräte zu den Kosten der Anschaffung. Jedes Jahr wird der Bestand vor Ort vollständig gezählt.", "Das Eigenkapital blieb im Jahr ohne jede Änderung bestehen."]
    assert align.segments(pages).count() >= 2


def test_voucher_counts_words_and_composed_characters(spark):
    rows = spark.createDataFrame([("d", S.OK), ("d", S.NOTE), ("d", S.OK)], "doc_id string, status string")
    assert vouch.counts(rows).count() >= 1
    one = spark.createDataFrame([("ä b c",), (None,)], "t string")
    assert [r.w for r in one.select(T.word_count(F.col("t")).alias("w")).collect()] == [3, 0]
    assert one.select(similarity.nfc("t").alias("n")).first().n == "ä b c"


def test_questions_of_a_text(spark):
    pages = spark.createDataFrame([("d", 1, "Kopf\n1. Sind die Wertpapiere ausreichend beschrieben?\n2.1 Ist der Bestand gezählt worden?")], S.PAGES)
    got = checklists.from_pages(pages).orderBy("item_id").collect()
    assert [r.item_id for r in got] == ["1", "2.1"] and "wertpapiere" in got[0].keywords


def test_missing_evidence_and_evaluation(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "item_id string")
    m = spark.createDataFrame([("d", "a"), ("d", "b")], "doc_id string, item_id string")
    e = spark.createDataFrame([("d", "a")], "doc_id string, item_id string")
    assert {r.reason: r.item_ids for r in checklist.missing_evidence(m, e, q).collect()} == {"no quote": ["b"], "no section": ["c"]}
    f = spark.createDataFrame([("d", S.COMPLIANT, "", "x"), ("d", S.NOT_COMPLIANT, "", None), ("d", S.NOT_APPLICABLE, "law", " ")], "doc_id string, status string, reason string, quote string")
    got = checklist.evaluation(f).first()
    assert (got.total, got.with_evidence, got.compliance_rate, got.legal_na) == (3, 1, 0.5, 1)


def test_patterns_found_at_once(spark):
    from saldora.functions import patterns

    texts = spark.createDataFrame([(1, "abcabc ü"), (2, None), (3, ""), (4, "xbcx")], "k long, t string")
    asked = spark.createDataFrame([("abc",), ("bc",), ("ü",), ("",), (None,), ("nie",), ("bc",)], "pattern string")
    got = {(r.k, r.pattern): r.times for r in patterns.found_in(texts, ["k"], "t", asked).collect()}
    assert got == {(1, "abc"): 2, (1, "bc"): 2, (1, "ü"): 1, (4, "bc"): 1}
    assert patterns.found_in(texts, ["k"], "t", asked.where("false")).count() == 0


def test_keys_contained_in_either_way(spark, monkeypatch):
    from saldora.functions import patterns

    texts = spark.createDataFrame([("p", "einlangertext"), ("p", None), ("q", "anders")], "pair_id string, packed string")
    keys = spark.createDataFrame([("p", "langer"), ("p", "anders"), ("q", "anders"), ("r", "langer"), ("p", "")], "pair_id string, key string")
    want = {("p", "langer"), ("q", "anders")}
    assert {tuple(r) for r in patterns.contained(texts, "pair_id", "packed", keys).collect()} == want
    monkeypatch.setattr(patterns, "PASSES", 0)
    assert {tuple(r) for r in patterns.contained(texts, "pair_id", "packed", keys).collect()} == want
    monkeypatch.undo()
    monkeypatch.setattr(patterns, "SET_CHARS", 7)
    assert {tuple(r) for r in patterns.contained(texts, "pair_id", "packed", keys).collect()} == want


def test_values_match_in_rounds(spark):
    """As one walk over the items in order would, over chains of items that share keys."""
    import random

    from saldora.operators import yoy

    rnd = random.Random(8)
    cur = [("p" if k % 3 else "q", k, float(rnd.randrange(1, 9) * 100)) for k in range(60)]
    pri = [("p" if k % 2 else "q", 100 + k, f"k{rnd.randrange(14)}", float(rnd.randrange(1, 9) * 100)) for k in range(30)]
    used = {("p", "k3"): 20, ("q", "k5"): 0}
    want = set()
    for pair in "pq":
        taken = set()
        for p, c, v in cur:
            if p == pair:
                free = [(o, k) for q, o, k, w in pri if q == pair and w == v and k not in taken and used.get((pair, k), 1000) >= c]
                if len(free) == 1:
                    taken.add(free[0][1])
                    want.add((pair, c, free[0][0]))
    got = yoy.by_value(
        spark.createDataFrame(cur, "pair_id string, item_ord long, opening double"), spark.createDataFrame(pri, "pair_id string, item_ord long, key string, closing double"),
        spark.createDataFrame([(*k, v) for k, v in used.items()], "pair_id string, key string, used_at long"))
    assert {(r.pair_id, r.cur_ord, r.pri_ord) for r in got.collect()} == want and want


def test_report_on_participations(spark):
    from saldora.operators import rules

    docs = spark.createDataFrame([("a", "Muster Bau GmbH, Wien, 50 % und Neu Holding AG"), ("b", "nichts davon")], "doc_id string, text string")
    els, status = rules.participation_elements(docs), rules.participation_rule(docs)
    said = sinks.participation_markdown(els, status, "a")
    assert "| Muster Bau GmbH | yes | yes | no | no |" in said and "| Neu Holding AG | no | no | no | no |" in said and "PARTIAL" in said
    assert "No participation" in sinks.participation_markdown(els, status, "b")
    assert {r.element: r.names for r in sinks.missing_elements(els).collect()}["share"] == ["Neu Holding AG"]


def test_messages_of_a_review(spark):
    rows = spark.createDataFrame([("a", 2, 0, 1, 3, 9), ("b", 0, 0, 0, 4, 4), ("c", 0, 0, 0, 0, 1)], "doc_id string, to_confirm long, no_hint long, missing long, not_applicable long, total long")
    got = {r.doc_id: r.message for r in sinks.review_message(rows).collect()}
    assert got == {"a": "2 to confirm, 1 missing of 9 questions", "b": "nothing is open (4 not applicable)", "c": "nothing is open"}


def test_command_line(spark, tmp_path):
    from saldora.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "q.txt").write_text("1. Sind die Wertpapiere ausreichend beschrieben?")
    assert main(["init", str(tmp_path / "c")]) == 0 and main(["questions", str(tmp_path / "in"), str(tmp_path / "q")]) == 0 and main([]) == 2
    assert spark.read.json(str(tmp_path / "c")).count() == 5 and spark.read.parquet(str(tmp_path / "q")).first().item_id == "1"
