"""Source divergence audit: how far apart the sources of a language are in their words, and which words tell them.

Counts become rates p (in billionths, smoothed by 2), and two rates p and q differ by floor((p - q)**2 / (p + q)).
Most terms of a pair of sources occur in neither, so that their rates are the same two numbers over and over. Each
pair therefore starts at V times f of its zero counts, and the terms' postings (the sources that have a term) give
only corrections that are not zero, in two parts:

* one-sided: what a term of count c in the one source adds if the other has none. It depends on c alone, so that the
  terms of a source are first counted by c;
* two-sided: for terms that both have, f of the two less what the one-sided parts and the start have put in. Each
  task sums these by pair over its postings before anything is shuffled.

Terms are ranked by windows over source, cut to the first ranks before the shuffle.

Defined cases. A null text, lang or source counts as ''. A source without terms still is in all pairs of its language;
if a language keeps no term, all its pairs have the value 0. Texts of any length are taken whole; repeated rows count
again; an empty table gives an empty result. Rates are computed in decimals of 38 digits, everything else fits 64 bits.
The pairs of a language's sources are the result itself; a term's posting, one entry a source, fits into one task.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldora.llm.common import join_checked, stash, tidy

LEAST_DOCS = 10
TOP_TERMS = 10
#: Entries a task holds before it passes them on, and cells of one step of the two-sided corrections.
HELD, CELLS = 300_000, 2_000_000
#: All ASCII but letters parts terms; only A-Z are folded.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"


def rate(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 * (count + 2) / (total + 2 * kept)), exactly; null where nothing is kept."""
    top = (count + 2).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    under = (total + 2 * kept).cast("decimal(20,0)")
    return F.when(kept > 0, F.call_function("div", top, under) + 1).cast("long")


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it), summed within tasks and then over them."""

    def run(batches):
        held: dict = defaultdict(lambda: (Counter(), Counter()))

        def rows():
            for (lang, source), (n, d) in held.items():
                terms = list(n)
                for i in range(0, len(terms), 50_000):
                    part = terms[i : i + 50_000]
                    yield pa.record_batch({
                        "lang": pa.array([lang] * len(part), pa.string()), "source": pa.array([source] * len(part), pa.string()), "term": pa.array(part, pa.binary()).cast(pa.string()),
                        "n": pa.array([n[t] for t in part], pa.int64()), "docs": pa.array([d[t] for t in part], pa.int64())})
            held.clear()

        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for k, (lang, source, text) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts)):
                found = text.translate(FOLD).split()
                n, d = held[lang, source]
                n.update(found)
                d.update(set(found))
                if k % 256 == 255 and sum(len(x[0]) for x in held.values()) > HELD:
                    yield from rows()
        yield from rows()

    part = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]).mapInArrow(tidy(run), COUNTS)
    return stash(part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")


def two_sided(postings: DataFrame, n_groups: int) -> DataFrame:
    """pair (smaller group number * n_groups + larger), value: sums of the two-sided corrections."""
    f = lambda p, q: (p - q) ** 2 // (p + q)

    def pairs(group, p, zero):
        """Corrections of all pairs of each row; the three are (postings, sources in each)."""
        i, j = np.triu_indices(group.shape[1], 1)
        step = max(1, CELLS // max(1, len(i)))
        for a in range(0, len(group), step):
            g, x, z = group[a : a + step], p[a : a + step], zero[a : a + step]
            value = f(x[:, i], x[:, j]) - f(x[:, i], z[:, j]) - f(z[:, i], x[:, j]) + f(z[:, i], z[:, j])
            low, high = np.minimum(g[:, i], g[:, j]), np.maximum(g[:, i], g[:, j])
            yield (low * n_groups + high).ravel(), value.ravel()

    def summed(parts):
        key, value = np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts])
        key, at = np.unique(key, return_inverse=True)
        out = np.zeros(len(key), np.int64)
        np.add.at(out, at, value)
        return key, out

    def run(batches):
        parts: list = []
        held = 0
        for batch in batches:
            lists = batch.column("posting")
            length = np.diff(lists.offsets.to_numpy())
            begin = lists.offsets.to_numpy()[:-1]
            cells = [lists.values.field(c).to_numpy() for c in ("g", "p", "zero")]
            for size in np.unique(length[length > 1]):
                at = begin[length == size][:, None] + np.arange(size)
                for part in pairs(*[c[at] for c in cells]):
                    parts.append(part)
                    held += len(part[0])
                    if held > CELLS:
                        parts = [summed(parts)]
                        held = len(parts[0][0])
                        if held > CELLS // 2:
                            yield pa.record_batch(dict(zip(("pair", "value"), parts.pop())))
                            held = 0
        if parts:
            yield pa.record_batch(dict(zip(("pair", "value"), summed(parts))))

    return postings.select("posting").mapInArrow(tidy(run), "pair long, value long").groupBy("pair").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    found = counts(docs)
    kept = stash(found.groupBy("lang", "term").agg(F.sum("docs").alias("df"), F.sum("n").alias("all")).where(F.col("df") >= least_docs).drop("df"), "divergence-kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("lang_total"))
    rows = stash(found.drop("docs").join(kept.hint("merge"), ["lang", "term"]), "divergence-rows")

    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    groups = groups.withColumn("zero", rate(F.lit(0), F.col("total"), F.col("kept")))
    groups = stash(groups.join(numbered(groups), ["lang", "source"]), "divergence-groups")
    n_groups = groups.count()

    rated = join_checked(rows, groups, ["lang", "source"]).withColumn("p", rate(F.col("n"), F.col("total"), F.col("kept")))
    q = rate(F.col("all"), F.col("lang_total"), F.col("kept"))
    telling = rated.select("lang", "source", F.col("term").alias("item"), "p", q.alias("q")).where("p > q")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = telling.select("lang", "source", "item", apart(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    # The pairs of a language's sources: the rows of the result.
    here = groups.select("lang", "source", "id", "kept", "zero")
    other = groups.select("lang", F.col("source").alias("item"), F.col("id").alias("item_id"), F.col("zero").alias("item_zero"))
    pairs = stash(here.join(other, "lang").where("id <> item_id"), "divergence-pairs")
    start = pairs.select("id", "item_id", F.coalesce(F.col("kept") * apart(F.col("zero"), F.col("item_zero")), F.lit(0)).alias("value"))

    by_count = stash(rated.groupBy("id", "p").agg(F.count("*").alias("terms")), "divergence-by-count")
    one = pairs.select("id", "item_id", "zero", "item_zero").join(by_count, "id")
    change = apart(F.col("p"), F.col("item_zero")) - apart(F.col("zero"), F.col("item_zero"))
    one = one.groupBy("id", "item_id").agg(F.sum(F.col("terms") * change).alias("value"))

    posting = F.collect_list(F.struct(F.col("id").alias("g"), "p", "zero")).alias("posting")
    both = stash(two_sided(rated.groupBy("lang", "term").agg(posting), n_groups), "divergence-both")
    low, high = F.expr(f"pair div {n_groups}L"), F.expr(f"pair % {n_groups}L")
    both = both.select(low.alias("id"), high.alias("item_id"), "value").union(both.select(high, low, "value"))

    flipped = one.select(F.col("item_id").alias("id"), F.col("id").alias("item_id"), "value")
    summed = start.unionByName(one).unionByName(flipped).unionByName(both).groupBy("id", "item_id").agg(F.sum("value").alias("value"))
    valued = pairs.join(summed, ["id", "item_id"]).select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(ranked))
    order = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return order(valued, "pair").unionByName(order(terms, "term"))


def numbered(groups: DataFrame) -> DataFrame:
    """lang, source, id from 0 without gaps: a number within each of many parts, plus the sizes of the parts before."""
    dealt = stash(groups.select("lang", "source", F.pmod(F.xxhash64("lang", "source"), F.lit(1024)).alias("part")), "divergence-ids")
    sizes = sorted(map(tuple, dealt.groupBy("part").count().collect()))
    before = dict(zip([p for p, _ in sizes], itertools.accumulate([0, *[n for _, n in sizes]])))
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("part"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("lang", "source"))
    return dealt.select("lang", "source", (offset + inside - 1).cast("long").alias("id"))
