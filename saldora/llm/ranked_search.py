"""Ranked lexical search over a two-level quantised index.

The index holds blocks of documents with the postings of the terms asked for. Its first level is one byte a posting:
the term's impact in the document, 10**9 * tf div (1000 * tf + 8 * m), in steps of STEP and rounded up. The sum of
w * byte * STEP over an item's terms is never below the document's score, and that of w * (byte - 1) * STEP never
above it. The second level has the exact counts. Three passes:

1. one scan of the texts counts N, L and the df of the terms asked for; a second writes the index (first level and
   second), every document in it;
2. over the bytes, each task gives its TOP best lower bounds an item; the TOP-th best of all tasks is the item's floor;
3. every document whose upper bound reaches the floor is scored again in exact integers from the second level.

Tasks give at most TOP rows an item, so that a group of copies, however large, is scored where it lies. Items are
searched in sets of about ITEM_TERMS terms together, which is what is brought to the tasks; N and L do not depend on
the set.

Defined cases. A null text, or one without a term, is in no list and counts neither for N nor for L. An item that is
null or has no term found anywhere gives no rows. Each row of items is an item: a repeated row is answered again, with
the same ranks. Documents of equal score come by doc_id, a null doc_id last; repeated rows each have a rank. Texts of
any length are taken whole. Empty documents or items give an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType

from saldora.llm.common import by_bytes, stash, tidy

TOP = 10
ITEM_TERMS = 200_000
BLOCK = 16 * 2**20
#: Impacts are below 10**6; 255 steps cover them.
STEP = -(-(10**6) // 255)
LAST = np.iinfo(np.int64).max
#: ASCII other than letters and digits parts terms; of letters only A-Z are folded.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
INDEX = "docs binary, sizes binary, terms binary, ends binary, places binary, impacts binary, counts binary"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def texts_of(batch: pa.RecordBatch) -> list:
    return batch.column("text").cast(pa.binary()).to_pylist()


def counted(docs: DataFrame, vocabulary) -> tuple[int, int, dict[int, int]]:
    """N, L and df by number of the term; vocabulary is a broadcast dict of terms to numbers."""

    def run(batches):
        n, total, df = 0, 0, Counter()
        known = vocabulary.value
        for batch in batches:
            for text in texts_of(batch):
                if found := terms_of(text):
                    n, total = n + 1, total + len(found)
                    df.update({known[t] for t in set(found) if t in known})
        keys = [-1, -2, *df]
        yield pa.record_batch({"term": pa.array(keys, pa.int32()), "n": pa.array([n, total, *df.values()], pa.int64())})

    sums = dict(map(tuple, docs.select("text").mapInArrow(tidy(run), "term int, n long").groupBy("term").agg(F.sum("n")).collect()))
    return sums.pop(-1, 0), sums.pop(-2, 0), sums


def index(docs: DataFrame, vocabulary, n_docs: int, n_terms: int) -> DataFrame:
    """Blocks of documents: ids and m by place; the terms there, and for each the places, impacts and counts."""

    def block(part: pa.RecordBatch) -> dict | None:
        known, ids, sizes, rows, terms, counts = vocabulary.value, [], [], [], [], []
        for doc_id, text in zip(part.column("doc_id").to_pylist(), texts_of(part)):
            found = terms_of(text)
            tf = Counter(known[t] for t in found if t in known)
            if tf:
                rows += [len(ids)] * len(tf)
                terms += tf.keys()
                counts += tf.values()
                ids.append(LAST if doc_id is None else doc_id)
                sizes.append(10 + 90 * len(found) * n_docs // n_terms)
        if not ids:
            return None
        place, term, tf, m = np.array(rows, np.uint32), np.array(terms, np.int64), np.array(counts, np.int64), np.array(sizes, np.int64)
        order = np.argsort(term, kind="stable")
        place, term, tf = place[order], term[order], tf[order]
        some, first = np.unique(term, return_index=True)
        impact = 10**9 * tf // (1000 * tf + 8 * m[place])
        parts = (np.array(ids, np.int64), m, some, np.append(first, len(term))[1:], place, (-(-impact // STEP)).astype(np.uint8), tf)
        return {c.split()[0]: p.tobytes() for c, p in zip(INDEX.split(", "), parts)}

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, batch.schema.get_field_index("text"), BLOCK):
                if made := block(part):
                    yield pa.record_batch({k: pa.array([v], pa.binary()) for k, v in made.items()})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), INDEX)


class Block:
    def __init__(self, row: dict):
        kinds = (np.int64, np.int64, np.int64, np.int64, np.uint32, np.uint8, np.int64)
        self.docs, self.m, terms, ends, self.places, self.impacts, self.counts = [np.frombuffer(row[c.split()[0]], k) for c, k in zip(INDEX.split(", "), kinds)]
        self.spans = {t: slice(a, b) for t, a, b in zip(terms.tolist(), [0, *ends.tolist()], ends.tolist())}

    def lists(self, terms) -> list:
        return [(w, self.spans[t]) for t, w in terms if t in self.spans]

    def bounds(self, terms) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bounds of the documents' scores."""
        up, low = np.zeros(len(self.docs), np.int64), np.zeros(len(self.docs), np.int64)
        for w, at in self.lists(terms):
            byte = self.impacts[at].astype(np.int64)
            up[self.places[at]] += w * byte
            low[self.places[at]] += w * (byte - (byte > 0))
        return up * STEP, low * STEP

    def scores(self, terms, chosen: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.docs), np.int64)
        for w, at in self.lists(terms):
            place, tf = self.places[at], self.counts[at]
            use = chosen[place]
            place, tf = place[use], tf[use]
            out[place] += w * (10**9 * tf // (1000 * tf + 8 * self.m[place]))
        return out


def blocks(batches):
    for batch in batches:
        for row in batch.to_pylist():
            yield Block(row)


def floors(idx: DataFrame, wanted) -> dict[int, int]:
    """By item: the TOP-th best lower bound of all documents; wanted is a broadcast list of (term, weight) lists."""

    def run(batches):
        best: dict[int, np.ndarray] = {}
        for block in blocks(batches):
            for item, terms in enumerate(wanted.value):
                low = block.bounds(terms)[1]
                low = np.concatenate((best.get(item, low[:0]), low[low > 0]))
                best[item] = np.partition(low, len(low) - TOP)[-TOP:] if len(low) > TOP else low
        for item, low in best.items():
            yield pa.record_batch({"item": pa.array([item] * len(low), pa.int32()), "low": pa.array(low, pa.int64())})

    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low")))
    best = idx.mapInArrow(tidy(run), "item int, low long").withColumn("rank", rank).where(f"rank <= {TOP}")
    return dict(map(tuple, best.where(f"rank = {TOP}").select("item", "low").collect()))


def rescored(idx: DataFrame, wanted, floor) -> DataFrame:
    """item, doc_id, score: each task's TOP best documents of each item, exactly."""

    def run(batches):
        best: dict[int, tuple] = {}
        for block in blocks(batches):
            for item, terms in enumerate(wanted.value):
                up = block.bounds(terms)[0]
                chosen = (up > 0) & (up >= floor.value.get(item, 0))
                if not chosen.any():
                    continue
                score = block.scores(terms, chosen)
                at = np.flatnonzero(score)
                score, doc = score[at], block.docs[at]
                if item in best:
                    score, doc = np.concatenate((best[item][0], score)), np.concatenate((best[item][1], doc))
                order = np.lexsort((doc, -score))[:TOP]
                best[item] = score[order], doc[order]
        for item, (score, doc) in best.items():
            yield pa.record_batch({"item": pa.array([item] * len(doc), pa.int32()), "doc_id": pa.array(doc, pa.int64(), mask=doc == LAST), "score": pa.array(score, pa.int64())})

    return idx.mapInArrow(tidy(run), "item int, doc_id long, score long")


def search_set(docs: DataFrame, items: list[tuple]) -> DataFrame:
    """(item, doc_id, score, rank) of items, a bounded list of distinct terms; item is the place in it."""
    sc = docs.sparkSession.sparkContext
    numbers: dict[bytes, int] = {}
    for terms in items:
        for t in terms:
            numbers.setdefault(t, len(numbers))
    vocabulary = sc.broadcast(numbers)
    n, total, df = counted(docs, vocabulary)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for t, k in df.items()}
    idx = stash(index(docs, vocabulary, n, max(total, 1)), "search-index")
    wanted = sc.broadcast([[(numbers[t], weight[numbers[t]]) for t in terms if numbers[t] in weight] for terms in items])
    floor = sc.broadcast(floors(idx, wanted))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    found = stash(rescored(idx, wanted, floor).withColumn("rank", rank).where(f"rank <= {TOP}"), "search-found")
    for b in (vocabulary, wanted, floor):
        b.destroy()
    return found


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms (distinct, as binary) and n, their number; items without a term are left out."""
    schema = items.select("item_id").schema.add("terms", ArrayType(BinaryType())).add("n", "long")

    def run(batches):
        for batch in batches:
            terms = [sorted(set(terms_of(t))) for t in texts_of(batch)]
            yield pa.record_batch([batch.column("item_id"), pa.array(terms, pa.list_(pa.binary())), pa.array([len(t) for t in terms], pa.int64())], ["item_id", "terms", "n"])

    return stash(items.select("item_id", "text").mapInArrow(run, schema).where("n > 0"), "search-items")


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the TOP best documents of each row of items (item_id, text)."""
    spark, asked = docs.sparkSession, item_terms(items)
    sets = -(-(asked.agg(F.sum("n")).first()[0] or 0) // ITEM_TERMS)
    asked = asked.withColumn("set", F.pmod(F.xxhash64("item_id", "terms"), F.lit(max(sets, 1))))
    out = None
    for k in range(sets):
        rows = asked.where(F.col("set") == k).select("item_id", "terms").collect()  # about ITEM_TERMS terms
        if not rows:
            continue
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], items.select(F.lit(0).alias("item"), "item_id").schema)
        found = search_set(docs, [[bytes(t) for t in r["terms"]] for r in rows]).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    return out
