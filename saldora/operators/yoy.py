"""Year over year: every opening value must be last year's closing value.

Many pairs of statements are compared in one job: pair_id is part of every key. Matches come from a cascade: equal
keys, nearly equal keys, one key ending with the other, a value that occurs once. All steps are joins; the last depends
on what earlier items used and is done in rounds, in which all items decide that no open one before them can hinder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saldora import schemas as S
from saldora.functions import text as T
from saldora.functions.patterns import contained
from saldora.functions.similarity import label_ratio
from saldora.lineage import cut

FUZZY, SUFFIX, BY_VALUE = 0.95, 0.90, 0.80
LEAST_KEY = 10
STEPS = ("ratio", "suffix", "value")


def keyed(items: DataFrame) -> DataFrame:
    """items (with pair_id) with key, opening and closing value, without lines that are no items of their own."""
    v = ("current_values", "prior_values", "double_row")
    return items.where(~T.is_skippable(F.col("label"))).select(
        "pair_id", "item_ord", "label", "page", T.compact_key(F.col("label")).alias("key"),
        T.opening_value(*map(F.col, v)).alias("opening"), T.closing_value(*map(F.col, v)).alias("closing"))


def by_key(cur: DataFrame, pri: DataFrame) -> DataFrame:
    """pair_id, cur_ord, pri_ord, score: equal keys; of several the nearest closing value, the first on ties."""
    p = pri.where("key <> ''").select("pair_id", "key", F.col("item_ord").alias("pri_ord"), "closing")
    both = cur.select("pair_id", "key", F.col("item_ord").alias("cur_ord"), "opening").join(p, ["pair_id", "key"])
    near = Window.partitionBy("pair_id", "cur_ord").orderBy(F.abs(F.col("closing") - F.col("opening")).asc_nulls_last(), "pri_ord")
    return both.withColumn("r", F.row_number().over(near)).where("r = 1").select("pair_id", "cur_ord", "pri_ord", F.lit(1.0).alias("score"))


def _keys(rows: DataFrame) -> DataFrame:
    return rows.where("key <> ''").groupBy("pair_id", "key").agg(F.min("item_ord").alias("first"))


def by_ratio(cur: DataFrame, pri: DataFrame, least: float = FUZZY) -> DataFrame:
    """Nearly equal keys. A ratio of `least` leaves at most (1 - least) of the two lengths' sum unmatched.

    Where that is less than two characters, one key is the other with at most one character taken out: they meet in a
    join of keys with such variants. Longer keys meet by bands of length that can reach the ratio, and must have enough
    letters in common, whatever their order, before the ratio is worked out."""
    la, lb = F.length("a"), F.length("b")
    c, p = _keys(cur).select("pair_id", F.col("key").alias("a")), _keys(pri).select("pair_id", F.col("key").alias("b"), "first")
    short = (1 - least) * (la + lb) < 2
    without = lambda k: F.transform(F.sequence(F.lit(1), F.length(k)), lambda i: F.concat(F.left(k, i - 1), F.substring(k, i + 1, F.length(k))))
    may = lambda k: (1 - least) * (2 * F.length(k) - 1) < 2
    with_variants = lambda x, k: x.where(may(k)).select("*", F.explode(F.array_union(F.array(k), without(k))).alias("v"))
    close = with_variants(c, "a").join(p.withColumn("v", F.col("b")), ["pair_id", "v"]).unionByName(c.withColumn("v", F.col("a")).join(with_variants(p, "b"), ["pair_id", "v"]))
    close = close.where(short).select("pair_id", "a", "b", "first").distinct()

    step = F.log(F.lit((2 - least) / least))
    band = lambda k: F.floor(F.log(F.length(k).cast("double")) / step).cast("int")
    long_enough = lambda k: F.length(k) * (1 - least) * (1 + (2 - least) / least) >= 2
    far_c = c.where(long_enough("a")).select("*", band("a").alias("band"), T.letter_counts(F.col("a")).alias("x"))
    far_p = p.where(long_enough("b")).select("*", F.explode(F.array(band("b") - 1, band("b"), band("b") + 1)).alias("band"), T.letter_counts(F.col("b")).alias("y"))
    far = far_c.join(far_p, ["pair_id", "band"]).where(~short & (2 * F.least(la, lb) >= least * (la + lb)))
    far = far.where(2 * T.shared_letters(F.col("x"), F.col("y")) >= least * (la + lb)).select("pair_id", "a", "b", "first")
    both = close.unionByName(far)
    scored = both.withColumn("score", label_ratio("a", "b")).where(F.col("score") >= least)
    best = Window.partitionBy("pair_id", "a").orderBy(F.desc("score"), "first")
    found = scored.withColumn("r", F.row_number().over(best)).where("r = 1").select("pair_id", F.col("a").alias("key"), F.col("first").alias("pri_ord"), "score")
    return cur.join(found, ["pair_id", "key"]).select("pair_id", F.col("item_ord").alias("cur_ord"), "pri_ord", "score")


def by_suffix(cur: DataFrame, pri: DataFrame) -> DataFrame:
    """Exactly one prior key, of which one ends with the other, the surplus holding a letter. Both sides are joined
    on the last LEAST_KEY characters, which such keys share."""
    end = F.right("key", F.lit(LEAST_KEY)).alias("end")
    long_enough = F.length("key") >= LEAST_KEY
    c = _keys(cur).where(long_enough).select("pair_id", F.col("key").alias("a"), end)
    p = _keys(pri).where(long_enough).select("pair_id", F.col("key").alias("b"), "first", end)
    more = lambda x, y: F.expr(f"endswith({x}, {y})") & F.expr(f"left({x}, length({x}) - length({y}))").rlike("[a-z]")
    both = c.join(p, ["pair_id", "end"]).where(more("a", "b") | more("b", "a"))
    one = both.groupBy("pair_id", F.col("a").alias("key")).agg(F.count("*").alias("n"), F.min("first").alias("pri_ord")).where("n = 1")
    return cur.join(one, ["pair_id", "key"]).select("pair_id", F.col("item_ord").alias("cur_ord"), "pri_ord", F.lit(SUFFIX).alias("score"))


def by_value(open_: DataFrame, pri: DataFrame, used: DataFrame, among_all: bool = False) -> DataFrame:
    """Exactly one prior item, of a key not used before, closes with the item's opening value (not near zero).

    among_all: the prior item must be the only one among all that `used` leaves, also those that earlier items take in
    this step; without it, the only one that is left when it is the item's turn. used: pair_id, key, used_at (the first current item that matched the key). Joined on the whole absolute amount
    and on what is left of it without its leading digit, the only amounts that values_match() can take as equal."""
    cents = lambda c: F.round(F.abs(F.col(c)) * 100).cast("long")
    short = lambda c: F.expr(f"try_cast(substr(cast(round(abs({c}) * 100) as decimal(20,0)), 2) as long)")
    marks = lambda c: F.array_distinct(F.filter(F.array(cents(c), cents(c) - 1, cents(c) + 1, short(c)), lambda x: x.isNotNull()))
    o = open_.where(F.abs("opening") >= 0.01).select("pair_id", F.col("item_ord").alias("cur_ord"), "opening", F.explode(marks("opening")).alias("mark"))
    p = pri.where("closing is not null").select("pair_id", F.col("item_ord").alias("pri_ord"), "key", "closing", F.explode(marks("closing")).alias("mark"))
    # Marks are several a row, more than a planner guesses: no side is broadcast.
    hits = o.join(p.hint("merge"), ["pair_id", "mark"]).where(T.values_match(F.col("opening"), F.col("closing"))).select("pair_id", "cur_ord", "pri_ord", "key").distinct()
    hits = hits.join(used.hint("merge"), ["pair_id", "key"], "left")

    hits = hits.where(F.isnull("used_at") | (F.col("used_at") >= F.col("cur_ord"))).drop("used_at")
    if among_all:
        hits = hits.withColumn("n", F.count("*").over(Window.partitionBy("pair_id", "cur_ord"))).where("n = 1").drop("n")
    hits = cut(hits)
    taken = hits.limit(0).select("pair_id", "cur_ord", "pri_ord")
    while hits.limit(1).count():
        # An item decides once no earlier one that is still open shares a key with it; the first of a pair always can.
        first = F.min("cur_ord").over(Window.partitionBy("pair_id", "key"))
        item = Window.partitionBy("pair_id", "cur_ord")
        rows = hits.withColumn("mine", first == F.col("cur_ord")).select("*", F.min("mine").over(item).alias("ready"), F.count("*").over(item).alias("n"))
        rows = cut(rows)
        won = rows.where("ready and n = 1").select("pair_id", "cur_ord", "pri_ord", "key")
        taken = taken.unionByName(won.drop("key"))
        hits = cut(rows.where("not ready").drop("mine", "ready", "n").join(won.select("pair_id", "key"), ["pair_id", "key"], "left_anti"))
    return taken.withColumn("score", F.lit(BY_VALUE))


def compare(current: DataFrame, prior: DataFrame, current_text: DataFrame | None = None, prior_text: DataFrame | None = None, steps: tuple[str, ...] = STEPS) -> DataFrame:
    """Rows of both sides with their status. steps: what comes after equal keys; none for labels that identify an item
    for certain, where a near label or an equal amount is another item's. current, prior: schemas.ITEMS with pair_id (string) instead of doc_id;
    the texts, pair_id and packed (all of a document as one key), suppress one-sided rows whose label is there."""
    cur, pri = cut(keyed(current)), cut(keyed(prior))
    at = lambda m: m.select("pair_id", F.col("cur_ord").alias("item_ord"))
    m1 = cut(by_key(cur, pri))
    rest = cut(cur.join(at(m1), ["pair_id", "item_ord"], "left_anti"))
    found = m1
    if "ratio" in steps:
        m2 = cut(by_ratio(rest, pri))
        rest, found = rest.join(at(m2), ["pair_id", "item_ord"], "left_anti"), found.unionByName(m2)
    if "suffix" in steps:
        m3 = by_suffix(rest, pri)
        rest, found = rest.join(at(m3), ["pair_id", "item_ord"], "left_anti"), found.unionByName(m3)
    stage1 = cut(found)
    key_of = pri.select("pair_id", F.col("item_ord").alias("pri_ord"), "key")
    used = stage1.join(key_of, ["pair_id", "pri_ord"]).groupBy("pair_id", "key").agg(F.min("cur_ord").alias("used_at"))
    matches = cut(stage1.unionByName(by_value(rest.where("opening is not null"), pri, used))) if "value" in steps else stage1

    c = cur.select("pair_id", F.col("item_ord").alias("cur_ord"), F.col("label").alias("label"), F.col("key"), F.col("page").alias("page_current"), "opening")
    p = pri.select("pair_id", F.col("item_ord").alias("pri_ord"), F.col("label").alias("label_prior"), F.col("page").alias("page_prior"), "closing")
    rows = c.where("opening is not null").join(matches, ["pair_id", "cur_ord"], "left").join(p, ["pair_id", "pri_ord"], "left")
    status = F.when(F.isnull("pri_ord"), S.ONLY_CURRENT).when(F.isnull("closing"), S.MISSING_VALUE).when(T.values_match(F.col("opening"), F.col("closing")), S.OK).otherwise(S.DEVIATION)
    rows = rows.withColumn("status", status)
    all_used = matches.join(key_of, ["pair_id", "pri_ord"]).select("pair_id", "key").distinct()
    left = pri.where("closing is not null").join(all_used, ["pair_id", "key"], "left_anti")
    only = left.select("pair_id", F.lit(None).cast("long").alias("cur_ord"), F.col("item_ord").alias("pri_ord"), "label", "key", F.lit(0).alias("page_current"), F.lit(None).cast("double").alias("opening"), F.lit(None).cast("double").alias("score"), F.col("label").alias("label_prior"), F.col("page").alias("page_prior"), "closing", F.lit(S.ONLY_PRIOR).alias("status"))
    rows = rows.unionByName(only)
    for text, one_sided in ((prior_text, S.ONLY_CURRENT), (current_text, S.ONLY_PRIOR)):
        if text is not None:
            # Only keys of one-sided rows are looked for; rows meet the keys that were found, never a text.
            rows = cut(rows)
            asked = rows.where((F.col("status") == one_sided) & (F.length("key") >= LEAST_KEY)).select("pair_id", "key")
            there = contained(text, "pair_id", "packed", asked).withColumn("status", F.lit(one_sided))
            rows = rows.join(there, ["pair_id", "key", "status"], "left_anti")
    proven = F.max(F.col("status") == S.OK).over(Window.partitionBy("pair_id", "key"))
    rows = rows.withColumn("proven", proven).where(~((F.col("status") == S.DEVIATION) & F.col("proven")))
    return rows.select(
        "pair_id", "cur_ord", "pri_ord", "label", F.col("opening").alias("value_current"), F.col("closing").alias("value_prior"), "page_current", "page_prior",
        F.coalesce("score", F.lit(0.0)).alias("match_score"), "status", F.when(F.col("label_prior") != F.col("label"), F.col("label_prior")).alias("label_prior"), (F.col("opening") - F.col("closing")).alias("difference"))


def packed_text(pages: DataFrame) -> DataFrame:
    """pair_id, packed: a document's text as one key, for the cross-check of one-sided rows."""
    parts = pages.groupBy("pair_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), " ").alias("t"))
    return parts.select("pair_id", T.compact_key(F.col("t")).alias("packed"))


def stats(rows: DataFrame) -> DataFrame:
    """Per pair: rows of each status, all rows, distinct labels."""
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in (S.OK, S.DEVIATION, S.ONLY_CURRENT, S.ONLY_PRIOR, S.MISSING_VALUE)]
    return rows.groupBy("pair_id").agg(*counts, F.count("*").alias("total"), F.count_distinct(T.normalise_label(F.col("label"))).alias("labels"))
