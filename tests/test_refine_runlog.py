"""Refinement that goes on where it stopped, run logs, requirements, profiles with rules."""

import pytest
from pyspark.sql import functions as F

from saldora import runlog
from saldora import schemas as S
from saldora.operators import profiles, refine
from saldora.sources import requirements

ASKED = "doc_id string, item_id string, par_ord long, rank int, question string, paragraph string"


def reviewer(fails=()):
    """Says yes to paragraphs with 'gut', with a quote; no to 'schlecht'; fails on questions it is told to."""

    class Reviewer:  # goes to the workers by value
        def answer(self, questions):
            if any(q["item_id"] in fails for q in questions):
                raise RuntimeError("out of reach")
            words = lambda t: "ja" if "gut" in t else "nein" if "schlecht" in t else "unklar"
            return [{"verdict": words(q["paragraph"]), "quote": q["paragraph"][:40] if q["item_id"] != "q4" else "frei erfundener Satz ohne Beleg", "missing": ""} for q in questions]

    return Reviewer()


@pytest.fixture(scope="module")
def asked(spark):
    good, bad, odd = "Die Angaben sind gut und vollständig beschrieben.", "Die Angaben sind schlecht beschrieben worden.", "Hierzu steht nichts weiter in diesem Absatz."
    rows = [("d", "q1", 0, 1, "?", odd), ("d", "q1", 1, 2, "?", good), ("d", "q2", 0, 1, "?", bad), ("d", "q2", 1, 2, "?", odd), ("d", "q3", 0, 1, "?", odd), ("d", "q4", 1, 1, "?", good), ("e", "q1", 5, 1, "?", good)]
    return spark.createDataFrame(rows, ASKED)


@pytest.fixture(scope="module")
def findings(spark):
    rows = [("d", q, S.NOT_ASSESSABLE) for q in ("q1", "q2", "q3", "q4")] + [("e", "q1", S.NOT_APPLICABLE), ("e", "q9", S.NOT_ASSESSABLE)]
    return spark.createDataFrame(rows, "doc_id string, item_id string, status string")


WANT = {("d", "q1"): S.COMPLIANT, ("d", "q2"): S.PARTIAL, ("d", "q3"): S.NOT_ASSESSABLE, ("d", "q4"): S.NOT_ASSESSABLE, ("e", "q1"): S.NOT_APPLICABLE, ("e", "q9"): S.NOT_ASSESSABLE}


def test_a_broken_run_goes_on(spark, asked, findings, tmp_path):
    path = str(tmp_path / "answers")
    assert refine.ask(asked, None, path).count() == 0  # nobody is asked by default
    assert refine.ask(asked, reviewer(), path, seconds=0).count() == 0  # no time
    some = refine.ask(asked, reviewer(fails=("q1", "q2")), path, waves=2, size=1)
    assert {(r.doc_id, r.item_id) for r in some.collect()} == {("d", "q3"), ("d", "q4")}
    assert {r.doc_id: (r.asked, r.answered) for r in refine.progress(asked, some).collect()} == {"d": (6, 2), "e": (1, 0)}
    assert refine.first_open(asked, some).count() == 3
    files = len(list((tmp_path / "answers").glob("*.parquet")))
    done = refine.ask(asked, reviewer(fails=("q3", "q4")), path, waves=2, size=1)  # what is answered is not asked again
    assert done.count() == 7 and len(list((tmp_path / "answers").glob("*.parquet"))) > files
    got = refine.resolve(findings, done, asked)
    assert {(r.doc_id, r.item_id): r.status for r in got.collect()} == WANT
    assert got.where("item_id = 'q1' and doc_id = 'd'").first().quote.startswith("Die Angaben sind gut")
    once = refine.ask(asked, reviewer(), str(tmp_path / "once"), waves=1)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, done.collect()))


def test_half_answered_questions_stay_open(asked, findings, spark):
    said = spark.createDataFrame([("d", "q2", 0, "nein", "", "")], "doc_id string, item_id string, par_ord long, verdict string, quote string, missing string")
    assert {r.status for r in refine.resolve(findings, said, asked).where("item_id = 'q2'").collect()} == {S.NOT_ASSESSABLE}


def test_candidates_are_the_best_paragraphs_of_open_questions(spark):
    f = spark.createDataFrame([("d", "a", "Sind die Wertpapiere bewertet?", [], S.NOT_ASSESSABLE), ("d", "b", "Sind die Wertpapiere bewertet?", [], S.NOT_APPLICABLE)], "doc_id string, item_id string, description string, keywords array<string>, status string")
    p = spark.createDataFrame([("d", k, 1, t) for k, t in enumerate(["Die Wertpapiere sind da.", "Wertpapiere werden bewertet.", "Nichts."])], "doc_id string, par_ord long, page int, text string")
    assert [(r.item_id, r.par_ord, r["rank"]) for r in refine.candidates(f, p, 2).orderBy("rank").collect()] == [("a", 1, 1), ("a", 0, 2)]


def test_log_counts_what_was_written(spark, tmp_path):
    df = spark.range(100).select("id", F.when(F.col("id") % 10 != 0, F.col("id") % 7).alias("v"))
    log = str(tmp_path / "log")
    row = runlog.write(df, str(tmp_path / "out"), log, "r1", "items", {"v is there": F.col("v").isNotNull(), "small": F.col("id") < 90}, {"most": F.max("id")})
    assert row["rows"] == spark.read.parquet(str(tmp_path / "out")).count() == 100 and row["failed"] == {"v is there": 10, "small": 10} and row["metrics"] == {"most": 99.0}
    runlog.write(df.where("false"), str(tmp_path / "none"), log, "r1", "empty")
    with pytest.raises(Exception):
        runlog.write(df.select(F.raise_error(F.lit("broken")).alias("x")), str(tmp_path / "bad"), log, "r1", "broken")
    got = runlog.read(spark, log)
    assert {(r.stage, r.problem[:7]) for r in runlog.problems(got).collect()} >= {("items", "v is th"), ("items", "small"), ("empty", "nothing")} and got.where("error is not null").count() == 1
    total = runlog.summary(got).first()
    assert (total.run, total.stages, total["rows"], total.failed_checks) == ("r1", 3, 100, 20)


def test_requirements_by_paragraph_size_and_keyword(spark):
    base = requirements.default(spark)
    assert base.count() == 15
    idx = requirements.index(base)
    ask = spark.createDataFrame([(1, "paragraph", "§ 3"), (2, "keyword", " Steuer "), (3, "size", "gross"), (3, "keyword", "umsatz"), (4, "size", "klein"), (4, "keyword", "umsatz"), (5, "keyword", "nirgends")], "n int, kind string, value string")
    found = {}
    for r in requirements.lookup(idx, ask).collect():
        found.setdefault((r.n, r.kind), set()).add(r.item_id)
    assert found[1, "paragraph"] == {"R03", "R04"} and found[2, "keyword"] == {"R13"} and (5, "keyword") not in found
    assert {(r.n, r.item_id) for r in requirements.lookup_all(idx, ask.where("n in (3, 4)"), ["n"]).collect()} == {(3, "R09")}
    assert requirements.as_checklist(base).where("size(applicable_to) > 0").count() == 15


def test_profiles_of_packages(monkeypatch):
    class Point:
        def __init__(self, name, value):
            self.name, self.value = name, value

        def load(self):
            if isinstance(self.value, Exception):
                raise self.value
            return self.value

    points = [Point("a", profiles.Profile("a", ("alpha",))), Point("b", ImportError("gone")), Point("c", "text")]
    monkeypatch.setattr(profiles, "entry_points", lambda group: points)
    r = profiles.Registry()
    r.load()
    assert r.pick("Alpha AG").name == "a" and [n for n, _ in r.problems] == ["b", "c"]


def test_rules_of_profiles_in_one_plan(spark):
    r = profiles.Registry()
    r.add(profiles.Profile("a", ("a",), noise=("^kopf",), rules={"noise": lambda line: line.startswith("x")}))
    pages = spark.createDataFrame([("1", 1, "Kopf\nx1\nPosten 1,00", "a"), ("2", 1, "Kopf\nx1\nPosten 1,00", "standard"), ("3", 1, None, "a")], "doc_id string, page int, text string, profile string")
    assert {x.doc_id: x.text for x in profiles.without_noise(pages, r).collect()} == {"1": "\n\nPosten 1,00", "2": "Kopf\nx1\nPosten 1,00", "3": ""}
