import re
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

import corpus_pipeline
from saldora.llm import jaccard, mixing, nbest, queries
from saldora.llm import pseudo_likelihood as lm
from saldora.llm.components import connected

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    """Smallest doc_id reachable by links, by comparing all rows."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if both and 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_components_by_brute_force(docs, rows, empty):
    want = components([(r[0], r[1]) for r in rows if r[0] is not None])
    got = jaccard.jaccard_groups(docs).collect()
    assert sorted((r.n_shingles for r in got)) == sorted(len(shingles(r[1])) for r in rows)
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None} == {i for i, c in want.items() if i == c}
    assert jaccard.jaccard_groups(empty).count() == 0


def links_by_hand(rows):
    """(doc_id, text) -> the number of other rows with a linked set, in the rows' order."""
    sets, out = [shingles(t) if i is not None else set() for i, t in rows], []
    for k, a in enumerate(sets):
        both = [len(a & b) for b in sets]
        out.append(sum(bool(x) and 100 * x >= 75 * (len(a) + len(sets[j]) - x) for j, x in enumerate(both) if j != k))
    return out


def test_links_by_brute_force(docs, rows, spark, monkeypatch):
    got = sorted((r.doc_id, r.n_links) for r in jaccard.jaccard_groups(docs).collect() if r.doc_id is not None)
    want = links_by_hand([(r[0], r[1]) for r in rows])
    assert got == sorted((r[0], n) for r, n in zip(rows, want) if r[0] is not None)
    r = np.random.default_rng(11)
    base, data = [f"w{k}" for k in range(120)], []
    for k in range(150):  # from copies to a few edits, some of them shared, so that links go both ways
        w = list(base)
        for at in [*r.integers(0, 12, k % 3), *r.integers(0, 120, k % 7)]:
            w[at] = f"x{at}" if at % 2 else f"x{at}y{k}"
        data.append((k, " ".join(w)))
    data += [(500 + k, data[k][1]) for k in range(20)] + [(900, "a word"), (901, "A  word")]
    want = links_by_hand(data)
    for half in (7, 1000):  # in parts and whole
        monkeypatch.setattr(jaccard, "HALF", half)
        found = jaccard.jaccard_groups(spark.createDataFrame(data, "doc_id long, text string")).collect()
        assert {x.doc_id: x.n_links for x in found} == {i: n for (i, _), n in zip(data, want)}
    assert len(set(want)) > 10


def test_chain_of_near_copies(spark):
    words = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(60):  # each differs a little from the one before, the ends do not link
        words[(k * 7) % 200] = f"x{k}"
        rows.append((k, " ".join(words)))
    want = components(rows)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_index_alone_loses_no_link(docs, rows):
    """Without the pivots' answers the index must find every link between different documents."""
    table = docs.select("doc_id", "text")
    none = docs.selectExpr("doc_id as id", "doc_id as comp").limit(0)
    found = {(r.a, r.b) for r in jaccard.compare(table, jaccard.may_link(jaccard.crossing(table, none, np.zeros(1 << jaccard.SKETCH, np.uint32), 10), jaccard.signatures(table))).collect()}
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    for a in sets:
        for b in sets:
            if a > b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                assert (a, b) in found


def test_blocks_of_a_long_list():
    n = 300
    size, pos, comp = np.array([40 + k % 50 for k in range(n)]), np.array([k % 9 for k in range(n)]), np.arange(n) // 2
    got = {p for part in jaccard.mixed_pairs(np.zeros(n, np.uint64), np.arange(n), pos, comp, size, np.arange(n)) for p in part}
    want = set()
    for i in range(n):
        for j in range(i):
            most = min(size[i] - pos[i], size[j] - pos[j])
            if comp[i] != comp[j] and 175 * most >= 75 * (size[i] + size[j]) and 100 * min(size[i], size[j]) >= 75 * max(size[i], size[j]):
                want.add((i, j))
    assert got == want


def test_word_hashes_do_not_depend_on_parts(monkeypatch):
    text = ("Alpha beta  gamma\n" * 40 + "x" * 300 + " end").encode()
    whole = jaccard.word_hashes(np.frombuffer(text, np.uint8))
    monkeypatch.setattr(jaccard, "PART", 50)
    parts = jaccard.word_hashes(np.frombuffer(text, np.uint8))
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all() and len(whole[0]) == 122


def test_connected_path_and_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200 + k) for k in range(40)] + [(500, 500)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[200 + k] for k in range(40)} == {100} and 500 not in got


def one_at_a_time(net, words, units):
    """Sum of the units' log-probabilities, token by token."""
    pad, total = [lm.UNITS] * 2, 0.0
    softmax = lambda z, k: z[k] - np.log(np.exp(z - z.max()).sum()) - z.max()
    row = [*pad, *units, *pad]
    for k, y in enumerate(units):
        h = np.tanh(sum(net.e[i][row[k + 2 + d]] for i, d in enumerate((-2, -1, 1, 2))))
        g, c = divmod(int(y), lm.ENDINGS)
        total += softmax(h @ net.w + net.b, g) + softmax(h @ net.u[g] + net.c[g], c)
    return total


def by_hand(texts, n, words, net, own=True):
    """Scores by their definition; n: count of every word of the corpus."""
    out, top = [], sorted(n, key=lambda w: (-n[w], w))[: lm.VOCABULARY]
    mass = Counter()
    for w, k in n.items():
        if w not in words.own:
            mass[lm.ending(w)] += k
    assert set(top) == set(words.own)
    for t in texts:
        list_ = lm.tokens((t or "").lower())
        here = Counter(list_)
        units = [words.own.get(w, lm.ending(w)) for w in list_]
        rest = sum(np.log(max(n[w] - here[w] * own, 0) + lm.UNSEEN) - np.log(mass[lm.ending(w)] + 1) for w in list_ if w not in words.own)
        out.append(one_at_a_time(net, list_, units) + rest)
    return out


def test_pseudo_likelihood_by_hand(docs, rows, empty, spark):
    model = lm.learn(docs)
    n = Counter(w for r in rows for w in lm.tokens((r[1] or "").lower()))
    got = lm.pseudo_likelihood(docs).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(lm.tokens((r[1] or "").lower())) for r in rows)
    assert all((r.mean is None) == (r.n_tokens == 0) and r.score <= 0 for r in got)
    want = by_hand([r[1] for r in rows], n, *model)
    assert np.allclose(sorted(r.score for r in got), sorted(want), atol=1e-2, rtol=1e-4)
    other = lm.pseudo_likelihood(spark.createDataFrame([(1, "alpha1 nowhere beta2")], "doc_id long, text string"), model).first()
    assert np.isclose(other.score, by_hand(["alpha1 nowhere beta2"], n, *model, own=False)[0], atol=1e-2)
    assert lm.pseudo_likelihood(empty).count() == 0


def test_words_outside_the_vocabulary_keep_their_counts(spark, monkeypatch):
    """More words than the vocabulary holds: ties by word, counts of the rest joined from the table, less the own."""
    r = np.random.default_rng(3)
    most = [f"v{k:05d}" for k in range(lm.VOCABULARY)]
    texts = [" ".join(most) + " " + " ".join(f"r{x}" for x in r.integers(0, 60, 40)) + (" seldom1 seldom1" if k < 2 else f" once{k}") for k in range(6)]
    docs = spark.createDataFrame([(None if k == 5 else k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(lm, "COMMON", lm.VOCABULARY + 20)
    n = Counter(w for t in texts for w in t.split())
    model = lm.learn(docs)
    table = {x.word: x.n for x in spark.read.parquet(model[0].table).collect()}
    assert table == {w: n[w] for w in sorted(n, key=lambda w: (-n[w], w))[lm.COMMON :]} and len(model[0].counts) == 20
    got = sorted(x.score for x in lm.pseudo_likelihood(docs).collect())
    assert np.allclose(got, sorted(by_hand(texts, n, *model)), rtol=1e-4)


def test_what_trains_grows_with_the_corpus(spark):
    r = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 50, 60)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = lm.counted(docs)
    few, many = (lm.trained(lm.read(docs.where(f"doc_id < {k}"), words), share=2, start=0, shard=500) for k in (60, 120))
    assert np.abs(few.w - many.w).max() > 1e-4
    copies = docs.select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text again").alias("text"))
    assert lm.pseudo_likelihood(copies).count() == 120  # rows of null doc_id and equal text start the network once


def test_training_helps():
    net = lm.Network()
    units = np.array([(k * 3) % 7 * 70 for k in range(20_000)])
    lens = np.full(200, 100)
    before = net.log_probs(units, net.around(units, lens)).mean()
    net.train(units, lens, epochs=4)
    assert net.log_probs(units, net.around(units, lens)).mean() > before + 2


def test_pipeline_stage_by_stage(docs, rows, spark, sf_dir):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard", "mix_sources", "nbest_pieces"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in now.collect()]
        now = stage(spark, now, sf_dir).cache()
        assert now.columns == docs.columns
        after = Counter(r.doc_id for r in now.collect())
        if name == "exact_dedup":
            texts = [re.sub(r"\s", "", r.text) for r in now.collect()]
            assert len(texts) == len(set(texts)) == len({re.sub(r"\s", "", t) for _, t in before})
        if name == "ngram_jaccard":
            want = components([(i, t) for i, t in before if i is not None])
            assert {i for i in after if i is not None} == {i for i, c in want.items() if i == c}
    out = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in now.collect())


def test_pipeline_runs_on_an_empty_table(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    assert {re.match(r"op(\d+)_", k)[1] for k in queries.QUERIES} == {str(k) for k in range(1, 11)}
    assert mixing.WEIGHTS == (5, 2, 1) and nbest.N >= 2


def test_most_frequent_words_from_histograms(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from saldora.llm import pseudo_likelihood as lm

    rnd = random.Random(4)
    rows = [(f"w{k}", rnd.choice((1, 1, 1, 2, 3, 7, 8, 9, 100, 4095, 4096, 70_000, 5 * 10**9))) for k in range(900)]
    counts = spark.createDataFrame(rows, "word string, n long").repartition(3)
    monkeypatch.setattr(lm, "RANGE", 50)
    for most in (1, 10, 100, 500, 899, 900, 5000):
        got = {r.word for r in counts.where(lm.most_frequent(counts, most)).collect()}
        assert got == {w for w, _ in sorted(rows, key=lambda x: (-x[1], x[0]))[:most]}
    assert counts.limit(0).where(lm.most_frequent(counts.limit(0), 5)).count() == 0
