"""Small tables on which the queries of the third round's findings went wrong."""

import datetime
import random
import sys
from collections import Counter

import duckdb
import numpy as np

from compare import assert_same
from pyspark.sql import functions as F

from saldora.functions import text as T
from saldora.operators import align, checklist, reconcile, vouch
from saldora.plans import catalogue


def check(spark, folder, name, **tables):
    """The query and its SQL over tables given as (schema, rows)."""
    c = duckdb.connect()
    for table, (schema, rows) in tables.items():
        path = f"{folder}/{table}.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    assert_same(catalogue.QUERIES[name](spark, str(folder)), c.execute(catalogue.SQL[name]))


ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"


def order(key, cust, price, year=1996, priority="5-LOW"):
    return key, cust, "O", price, datetime.datetime(year, 5, 1), priority


def test_another_customers_amount_is_no_match(spark, tmp_path):
    rows = [order(1, 1, 100.25, priority="1-URGENT"), order(2, 1, 9.0, 1997), order(3, 2, 100.25)]
    customers = "c_custkey long, c_mktsegment string", [(1, "X"), (2, "X")]
    check(spark, tmp_path, "yoy_stats", orders=(ORDERS, rows), customer=customers)


def test_an_amount_that_occurs_twice_stays_open(spark, tmp_path):
    """Order 3's amount is that of 3 and, less a digit, of 6; that order 2 takes 3 before does not make it unique."""
    check(spark, tmp_path, "yoy_unique_value", orders=(ORDERS, [order(2, 1, 8500.0), order(3, 1, 500.0), order(6, 1, 7500.0)]))


def shuffled(df) -> int:
    """Exchanges of the physical plan."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_dice_shuffles_no_words(spark):
    pairs = spark.createDataFrame([(1, "a b  b c", "b b d"), (2, None, "x"), (3, "", None)], "id long, a string, b string")
    got = align.dice(pairs, "id")
    assert {r.id: round(r.dice, 6) for r in got.collect()} == {1: round(4 / 7, 6), 2: 0.0, 3: 0.0}
    assert shuffled(got) == 0


def test_grams_are_never_broadcast(spark):
    keys = spark.createDataFrame([("d", 1, "positionenabc")], "doc_id string, ord long, key string")
    got = reconcile.containing(keys, keys)
    assert [tuple(r) for r in got.collect()] == [("d", 1, 1)]
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_scope_shuffles_no_finding(spark):
    """Questions meet documents last: nothing is exchanged after them."""
    q = spark.createDataFrame([("q", "Vorräte", "Gibt es Vorräte?", [], [], [], True)], "item_id string, category string, description string, keywords array<string>, applicable_to array<string>, size_classes array<string>, relevant boolean")
    docs = spark.createDataFrame([(1, "gmbh", "klein", "Handelswaren"), (2, "gmbh", "klein", "nichts")], "doc_id long, legal_form string, size_class string, text string")
    ask = checklist.topics(q, spark.createDataFrame([("vorr", ["handelswaren"])], "key string, words array<string>"), [])
    got = checklist.topic_scope(checklist.company_scope(checklist.blank_result(ask, checklist.with_topics(docs, ask))))
    assert {r.doc_id: r.status for r in got.collect()} == {1: "NOT_ASSESSABLE", 2: "NOT_APPLICABLE"}
    plan = checklist.scope_summary(got)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Cross") < plan.index("Join LeftOuter")


def test_every_document_trains_the_network(spark):
    from saldora.llm import pseudo_likelihood as lm

    docs = spark.createDataFrame([(k, f"alpha beta {'gamma ' * k}delta {'epsilon ' * (k % 3)}") for k in range(6)], "doc_id long, text string").coalesce(1)
    rows = lm.read(docs, lm.counted(docs))
    whole = lm.trained(rows, start=0).to_bytes()
    assert all(lm.trained(rows.where(f"doc_id <> {k}"), start=0).to_bytes() != whole for k in range(6))


def test_a_reference_across_the_end_of_a_line_gives_no_quote(spark, tmp_path):
    """Item 1's first word goes over a line end: the section has it, none of its lines, and its paragraph is over 100 characters."""
    text = "Vorwort\nAbsatz " + "über die Dinge und die Sachen " * 5
    docs = "doc_id long, text string", [(1, text), (2, "Absonderliches davon.")]
    check(spark, tmp_path, "section_evidence", documents=docs, benchmark=("item_id long, text string", [(1, "Vorwort\nAbsatz 7"), (2, "Absonderliches hier")]))


def test_lines_are_read_once_and_cut_without_a_new_pattern(spark):
    """The mark by which a line is cut may stand in it; a number with a line separator behind is none, and no error."""
    rows = spark.createDataFrame([("A\x01 1,00 2,00",), ("A 1,00\x012,00",), ("5\u2028",), ("(-5,5)",)], "x string")
    got = rows.select(T.label_and_numbers(F.col("x")).alias("p"), T.parse_number(F.col("x")).alias("v")).collect()
    assert [tuple(r.p) for r in got[:2]] == [("A\x01", [1.0, 2.0]), ("A 1,00\x01", [2.0])]
    assert [r.v for r in got[2:]] == [None, -5.5]


def test_positions_shuffle_only_lines_that_disclose(spark):
    """The first page counts, of a page the first line; lines meet their neighbours before anything is shuffled."""
    text = "Arbeiter 11 9\nGesamt 12 13\nGesamt 99 98\nGesamtbetrag der Haftungsverhältnisse\n5,00 6,00\n" + "x\n" * 15 + "Gesamt 7 7"
    got = vouch.positions(spark.createDataFrame([("d", 3, "Arbeiter\nGesamt 1 2"), ("d", 2, text), ("e", 1, None)], "doc_id string, page int, text string"))
    assert shuffled(got) == 1
    assert sorted((r.section, r.current_value, r.prior_value, r.page, r.source_line) for r in got.collect()) == [
        ("Arbeitnehmer", 12.0, 13.0, 2, "Gesamt 12 13"), ("Haftungsverhaeltnisse", 5.0, 6.0, 2, "Gesamtbetrag der Haftungsverhältnisse")]


def test_words_are_found_as_the_pattern_finds_them(monkeypatch):
    from saldora.llm import pseudo_likelihood as lm

    r = random.Random(1)
    signs = ["a", "B", "é", "Σ", "İ", "_", "1", "²", "ß", "́", "‍", "\x1c", "\x85", " ", " ", "\n", ".", ",", "🙂", "漢", "\U00010400", "ﬁ", "\xad"]
    for part in (lm.PART, 7):  # whole, and cut
        monkeypatch.setattr(lm, "PART", part)
        tables = [[None if r.random() < 0.1 else "".join(r.choices(signs, k=r.randrange(60))) for _ in range(r.randrange(6))] for _ in range(200)]
        for texts in [*tables, [None], ["x" * 5000 + " " + "x" * 5001 + "\n" + "x" * 5000]]:
            lens, at, words, times = lm.places(texts)
            want = [lm.tokens(t.lower()) if t else [] for t in texts]
            assert lens.tolist() == [len(x) for x in want] and [words[i] for i in at] == [w for x in want for w in x]
            assert dict(zip(words, times.tolist())) == Counter(w for x in want for w in x) and len(set(words)) == len(words)


def test_a_step_follows_the_gradient_of_every_token():
    """One step of a fresh network moves each weight by RATE * g / sqrt(g * g + 1e-6), g the mean gradient by differences."""
    from saldora.llm import pseudo_likelihood as lm

    r = np.random.default_rng(2)
    units, lens = r.choice([3, 70, 71, 4040], 400), np.array([150, 250])
    net, near = lm.Network(), lm.Network.around(units, lens)
    places = [(net.e, (1, 70, 2)), (net.w, (3, 1)), (net.b, (0,)), (net.u, (1, 5, 6)), (net.c, (1, 7))]
    loss, want = lambda: -net.log_probs(units, near).astype(float).mean(), []
    for part, at in places:
        old = part[at]
        part[at] = old + 0.02
        up = loss()
        part[at] = old - 0.02
        g = (up - loss()) / 0.04
        part[at] = old
        want.append(old - lm.RATE * g / np.sqrt(g * g + 1e-6))
    net.train(units, lens, epochs=1)
    assert np.allclose([part[at] for part, at in places], want, atol=2e-3)


def test_a_step_makes_few_calls_for_each_group():
    """All groups meet in a step; what is done for each is three products, everything else is done for all at once."""
    from saldora.llm import pseudo_likelihood as lm

    units, calls = np.random.default_rng(3).integers(0, lm.UNITS, lm.BATCH), []
    net = lm.Network()
    sys.setprofile(lambda frame, event, what: calls.append(event))
    try:
        net.train(units, np.array([len(units)]), epochs=1)
    finally:
        sys.setprofile(None)
    assert sum(x in ("call", "c_call") for x in calls) < 8 * lm.GROUPS
