import hashlib
import re
from collections import Counter, defaultdict

from compare import assert_same
from saldora.llm import dedup, mixing, queries


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_dedup_by_brute_force(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[squeezed(r[1])].append(r)
    got = dedup.exact_dedup(docs, prefix=4, digest_all=True).collect()
    assert len(got) == len(rows)
    kept = Counter()
    for g in got:
        members = next(m for t, m in groups.items() if hashlib.sha256(t.encode()).hexdigest() == g.digest)
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        assert (g.group_size, g.keep_id) == (len(members), best[0])
        kept[g.digest] += g.kept
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_query_equals_sql(spark, duck, sf_dir):
    assert_same(queries.op10_exact_dedup(spark, sf_dir), duck.execute(queries.SQL["op10_exact_dedup"]))


def test_hot_group_and_prefix_collisions(spark):
    docs = spark.createDataFrame([(k, "same text") for k in range(3000)] + [(5000 + k, "same prefix " + str(k % 50 + 100)) for k in range(100)], "doc_id long, text string")
    got = {(r.keep_id, r.group_size) for r in dedup.exact_dedup(docs, prefix=6).where("kept").collect()}
    assert got == {(0, 3000)} | {(5000 + k, 2) for k in range(50)}


def test_keep_one_keeps_columns_and_one_of_each(docs, rows, empty):
    got = dedup.keep_one(docs)
    assert got.columns == docs.columns
    assert Counter(squeezed(r.text) for r in got.collect()) == Counter({squeezed(r[1]) for r in rows})
    assert dedup.keep_one(empty).count() == 0 and dedup.exact_dedup(empty).count() == 0


def test_keep_one_keeps_unique_texts_of_mixed_ids(spark):
    rows = [(3, "a copied text"), (5, "a copied text"), (5, "a text of its own"), (None, "a copied text"), (None, "one more"), (None, "and a last one, longer"), (6, "six")]
    for data in (rows, rows[:3], [r for r in rows if r[0] != 5]):
        got = dedup.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect()
        assert Counter(map(tuple, got)) == Counter(r for r in data if r[1] != "a copied text" or r[0] == 3)


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    budget, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in names if s not in capped)
        level = (budget - sum(2 * sizes[s] for s in capped)) / free if free else 0
        more = {s for s in names if s not in capped and weight[s] * level > 2 * sizes[s]}
        if not more:
            return {s: 2.0 * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= more


def test_mix_targets_and_takes(docs, rows, empty):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = sorted((round(targets(sizes)[r[3]], 6), size(r[1])) for r in rows)
    got = mixing.mix(docs).collect()
    assert sorted((round(g.target, 6), g.size) for g in got) == want
    assert all(g.taken <= 2 * g.size and g.taken % max(1, g.size) == 0 for g in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect())) if not any(g.doc_id is None for g in got) else True
    assert mixing.mix(empty).count() == 0


def test_many_rows_come_near_their_targets(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(id % 40 as int)) as text", "concat('s', id % 5) as source")
    taken, target, largest = Counter(), {}, 40
    for g in mixing.mix(docs).collect():
        key = (g.source_size, g.target)
        taken[key] += g.taken
        target[key] = g.target
    assert taken and all(abs(taken[k] - target[k]) <= largest for k in taken)


def test_mixed_repeats_rows(docs, empty):
    times = Counter()
    for g in mixing.mix(docs).collect():
        times[g.doc_id] += g.times if g.size else 1
    got = mixing.mixed(docs)
    assert got.columns == docs.columns and Counter(r.doc_id for r in got.collect()) == Counter({k: v for k, v in times.items() if v})
    assert mixing.mixed(empty).count() == 0
