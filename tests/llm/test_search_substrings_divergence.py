"""op11, op12 and op13 against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from conftest import prose
from saldora.llm import ranked_search, substring_dedup
from saldora.llm.divergence import divergence
from saldora.llm.ranked_search import search
from saldora.llm.substring_dedup import deduplicated

SPACE = " \t\n\r\x0b\x0c"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def covered(rows, window=20):
    """By row in order of doc_id: words, and which of them go; doc_ids are unique."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out[doc_id] = (w, gone)
    return out


def planted(n=60, seed=5):
    """Documents that share passages of 15 to 80 words at any offset, copies, and runs of one word."""
    rnd = random.Random(seed)
    passages = [prose(1000 + k, rnd.choice((15, 19, 20, 21, 27, 40, 80))).split() for k in range(8)]
    rows = []
    for k in range(n):
        w = prose(k, rnd.randrange(0, 120)).split()
        for _ in range(rnd.randrange(4)):
            at = rnd.randrange(len(w) + 1)
            w[at:at] = rnd.choice(passages)
        rows.append((k * 7 % 1009, rnd.choice((" ", "\n", "  \t")).join(w)))
    rows += [(2000, rows[3][1]), (2001, rows[3][1]), (2002, "x " * 90), (2003, "x " * 19), (2004, "a b " * 70), (2005, None), (2006, " \n "), (2007, "ß é 漢字 🙂 " * 12)]
    return rows


def test_substrings_equal_brute_force(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = {d: (len(w), sum(g), " ".join(x for x, gone in zip(w, g) if not gone)) for d, (w, g) in covered(rows).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in deduplicated(docs).collect()}
    assert got == want
    digests = {r.doc_id: r.kept_sha256 for r in substring_dedup.substring_dedup(docs).collect()}
    assert digests == {d: hashlib.sha256(k.encode()).hexdigest() for d, (_, _, k) in want.items()}


def test_every_shift_shares_an_anchor():
    for d in range(substring_dedup.PERIOD):
        assert any((a - b) % substring_dedup.PERIOD == d for a in substring_dedup.COVER for b in substring_dedup.COVER)


def test_substrings_on_the_fixture_and_a_table(spark, docs, rows, empty, sf_dir):
    got = deduplicated(docs)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept"] and got.count() == len(rows)
    by_words = Counter(len(words(r[1])) for r in rows)
    assert Counter(r.n_words for r in got.collect()) == by_words
    nulls = [r for r in got.collect() if r.doc_id is None]
    assert sorted(r.n_removed for r in nulls) == [0, 120]  # a copy under a null doc_id comes after all others
    assert substring_dedup.substring_dedup(empty).count() == 0
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pairs = [tuple(r) for r in table.collect()]
    want = {d: (len(w), sum(g)) for d, (w, g) in covered(pairs).items()}
    assert {r.doc_id: (r.n_words, r.n_removed) for r in deduplicated(table).collect()} == want


def test_substrings_of_a_very_long_text(spark):
    long = prose(77, 60_000)
    tail = " ".join(long.split()[-5_000:])
    got = {r.doc_id: r for r in deduplicated(spark.createDataFrame([(1, long), (2, "new " + tail), (3, "y" * 3_000_000)], "doc_id long, text string")).collect()}
    assert got[2].n_removed == 5_000 and got[2].kept == "new" and got[3].n_words == 1
    assert got[1].n_removed == sum(covered([(1, long)])[1][1])


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(rows, items, top=10):
    held = [(d, TERM.findall(t.translate(ASCII_LOWER)) if t else []) for d, t in rows]
    n_docs, total = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    df = Counter(t for _, terms in held for t in set(terms))
    out = []
    for item, text in items:
        scores = []
        for doc_id, terms in held:
            tf, m = Counter(terms), 10 + 90 * len(terms) * n_docs // max(total, 1)
            s = 0
            for t in set(TERM.findall(text.translate(ASCII_LOWER)) if text else []):
                if tf[t]:
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
            if s:
                scores.append((-s, doc_id is None, doc_id))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [200_000, 5])
def test_search_equals_brute_force(spark, docs, rows, sf_dir, monkeypatch, limit):
    monkeypatch.setattr(ranked_search, "ITEM_TERMS", limit)
    items = [(1, prose(1, 12)), (2, None), (3, ""), (4, "Alpha1 ALPHA1 é漢字 🙂"), (5, "nowhere-found"), (6, rows[0][1]), (7, "ß ΣΣ one"), (6, rows[5][1])]
    got = search(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == ranked([(r[0], r[1]) for r in rows], items)


def test_search_of_the_benchmark(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted(map(tuple, search(docs, items).collect()), key=str)
    assert got == ranked([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.select("item_id", "text").collect()])


def test_search_ties_long_texts_and_empty_tables(spark, docs, empty):
    items = spark.createDataFrame([("a", "needle"), ("b", "hay")], "item_id string, text string")
    rows = [(k, "needle in hay") for k in range(40, 0, -1)] + [(None, "needle in hay"), (100, "hay " * 300_000 + "needle")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = search(table, items).collect()
    assert sorted(map(tuple, got), key=str) == ranked(rows, [("a", "needle"), ("b", "hay")])
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.item_id, r.rank))][:10] == list(range(1, 11))
    assert search(empty, items).count() == 0 and search(docs, items.where("false")).count() == 0



def audited(rows, least=10, top=10):
    """rows (text, lang, source): all rows of the result."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    groups, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = term.findall((text or "").translate(ASCII_LOWER))
        groups[lang or "", source or ""].update(found)
        df[lang or ""].update(set(found))
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= least]
        mine = {s: c for (g, s), c in groups.items() if g == lang}
        whole = Counter()
        for c in mine.values():
            whole.update(c)

        def rates(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        q, p = rates(whole), {s: rates(c) for s, c in mine.items()}
        for s in mine:
            pair = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in mine if o != s)
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pair)]
            tell = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if mine[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(tell)]
    return sorted(out)


@pytest.mark.parametrize("least", [1, 2, 10, 50])
def test_divergence_equals_brute_force(spark, docs, rows, least):
    got = divergence(docs, least_docs=least)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["value"] == "bigint"
    assert sorted(map(tuple, got.collect())) == audited([(r[1], r[2], r[3]) for r in rows], least)


def test_divergence_of_a_table(spark, sf_dir, monkeypatch):
    from saldora.llm import divergence as module

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = audited([(r.text, r.lang, r.source) for r in docs.collect()])
    assert sorted(map(tuple, divergence(docs).collect())) == want
    monkeypatch.setattr(module, "HELD", 10)
    monkeypatch.setattr(module, "CELLS", 50)
    assert sorted(map(tuple, divergence(docs.repartition(3)).collect())) == want


def test_divergence_edge_cases(spark, empty):
    assert divergence(empty).count() == 0
    one = spark.createDataFrame([("word " * 400_000, "en", "a"), ("w" * 2_000_000, "en", "b"), (None, "en", "c"), (None, None, None), ("x", None, "")], "text string, lang string, source string")
    want = audited([tuple(r) for r in one.collect()], 1)
    got = divergence(one, least_docs=1)
    assert sorted(map(tuple, got.collect())) == want
    assert got.where(F.col("lang") == "").where("part = 'pair'").count() == 0


@pytest.mark.parametrize("name", ["op11_substring_dedup", "op12_ranked_search", "op13_source_divergence"])
def test_queries_equal_their_sql(spark, duck, sf_dir, name):
    from compare import assert_same
    from saldora.llm import queries

    assert_same(queries.QUERIES[name](spark, sf_dir), duck.execute(queries.SQL[name]))
