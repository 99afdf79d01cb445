"""Figures in the notes against the same figures in the statements before them.

Items meet if one's key is contained in the other's. A containment join has no equal key of its own; here the longer
key is spread over its grams of LEAST_KEY characters and the shorter one is looked up by its first gram, so that the
join is an equi-join within the document, never all pairs. No side is ever broadcast: grams are many times the rows that
a planner guesses their size from, so all joins are merge joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saldora import schemas as S
from saldora.functions import text as T
from saldora.lineage import cut

LEAST_KEY = 12
TOLERANCE = 0.5


def containing(a: DataFrame, b: DataFrame, least: int = LEAST_KEY) -> DataFrame:
    """(doc_id, a_ord, b_ord) where a's key (doc_id, ord, key) is contained in b's or the other way round."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("key") - least + 1), lambda i: F.xxhash64(F.substring("key", i, F.lit(least)))))

    def inside(short: DataFrame, long: DataFrame) -> DataFrame:
        s = short.where(F.length("key") >= least).select("doc_id", F.col("ord").alias("s"), F.col("key").alias("k"), F.xxhash64(F.left("key", F.lit(least))).alias("gram"))
        g = long.where(F.length("key") >= least).select("doc_id", F.col("ord").alias("l"), "key", F.explode(grams).alias("gram"))
        return s.join(g.hint("merge"), ["doc_id", "gram"]).where(F.contains("key", F.col("k"))).select("doc_id", "s", "l")

    one = inside(a, b).select("doc_id", F.col("s").alias("a_ord"), F.col("l").alias("b_ord"))
    two = inside(b, a).select("doc_id", F.col("l").alias("a_ord"), F.col("s").alias("b_ord"))
    return one.union(two).distinct()


def reconcile(notes: DataFrame, front: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Rows of notes items that have a partner in front: value, partner's value, status, deviations first by rank.

    Both sides: schemas.ITEMS. An item agrees if any pair of its and a partner's columns does, or the sum of several
    partners' first columns; implausible pairs (years, a count against an amount, two counts) give no row."""
    values = F.concat("current_values", "prior_values")
    h = notes.select("doc_id", F.col("item_ord").alias("ord"), T.compact_key(F.col("label")).alias("key"), "label", "page", T.reporting_value(F.col("current_values")).alias("value"), values.alias("values")).where("value is not null")
    v = front.where(F.size("current_values") > 0).select("doc_id", F.col("item_ord").alias("ord"), T.compact_key(F.col("label")).alias("key"), "page", "current_values")
    pairs = containing(cut(h.select("doc_id", "ord", "key")), cut(v.select("doc_id", "ord", "key")))  # keys are worked out once
    told = h.select("doc_id", F.col("ord").alias("a_ord"), "label", "page", "value", "values")
    rows = pairs.join(told.hint("merge"), ["doc_id", "a_ord"]).join(v.select("doc_id", F.col("ord").alias("b_ord"), F.col("page").alias("front_page"), "current_values").hint("merge"), ["doc_id", "b_ord"])
    hit = F.get(F.filter("current_values", lambda w: F.exists("values", lambda x: F.abs(w - x) <= tolerance)), 0)
    best = F.min_by(F.struct(hit.alias("w"), F.col("front_page").alias("p")), F.when(hit.isNotNull(), F.col("b_ord")))
    first = F.min_by(F.struct(F.get("current_values", 0).alias("w"), F.col("front_page").alias("p")), F.col("b_ord"))
    by = rows.groupBy("doc_id", "a_ord").agg(
        F.first("label").alias("label"), F.first("page").alias("notes_page"), F.first("value").alias("value"), best.alias("hit"), first.alias("first"), F.count("*").alias("n"), F.sum(F.get("current_values", 0)).alias("sum"), F.max(hit.isNotNull()).alias("any"))
    summed = (F.col("n") > 1) & (F.abs(F.col("sum") - F.col("value")) <= tolerance)
    a, b = F.col("first.w"), F.col("value")
    odd = T.is_year(a) | T.is_year(b) | T.count_against_amount(a, b) | ((F.abs(a) < 100) & (F.abs(b) < 100))
    by = by.where(F.col("any") | summed | ~odd)
    out = by.select(
        "doc_id", F.col("a_ord").alias("item_ord"), "label", F.when(F.col("any"), F.col("hit.w")).when(summed, F.col("sum")).otherwise(a).alias("front_value"), F.when(F.col("any"), F.col("hit.w")).otherwise(b).alias("notes_value"),
        F.when(F.col("any"), F.col("hit.p")).otherwise(F.col("first.p")).alias("front_page"), "notes_page", F.when(F.col("any") | summed, S.OK).otherwise(S.DEVIATION).alias("status"))
    order = Window.partitionBy("doc_id").orderBy((F.col("status") != S.DEVIATION).cast("int"), "label", "item_ord")
    return out.withColumn("rank", F.row_number().over(order))


def counts(rows: DataFrame) -> DataFrame:
    """Per document: rows of reconcile() that agree, that deviate, and all."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return rows.groupBy("doc_id").agg(of(S.OK), of(S.DEVIATION), F.count("*").alias("total"))
