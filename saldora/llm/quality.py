"""Quality rules with risk-controlled thresholds, in Spark SQL functions only.

Features of a text grow with its badness and are cut into STEPS steps. A rule "reject above a cutoff" on each feature,
all features at once, is one number, the level: a feature's cutoff is the largest step that a larger share than the
level of the stratum's good documents reaches. So a document is rejected from the level on that is the least share, over
its features, of good documents that are as bad as it; the higher the level, the more is rejected.

Labelled documents are dealt into two folds by a hash of their id. The learning fold gives the shares. The holdout fold
certifies levels, by stratum (lang): with r of n good holdout documents rejected, the exact binomial tail
P(X <= r | n, RISK) must not exceed DELTA over the number of strata (Bonferroni). Levels are tested from the lowest
up, each only if all before passed, which needs no further correction, as what they reject is nested. So with
probability 1 - DELTA, in every stratum at once, all rules together reject at most RISK of the good documents. Of the
certified levels the one is taken that rejects most bad documents of the learning fold, each good one weighing
GOOD_WEIGHT; the lowest on ties. With no certified level, or none that is worth it, the stratum has no rule. A stratum
needs log(DELTA / strata) / log(1 - RISK) good holdout documents for its first level: 86 for 4 strata.

Defined cases. A null text has no words. Null lang is a stratum of its own. Documents without a label, with a null
label, or failing the base rules are not used to set thresholds; of several labels of a document the lowest counts.
With no labels only the base rules decide. Repeated rows are judged alike, and counted each where they are labelled.
Empty tables give empty results. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saldora.llm.common import SPACE, WORD, drop_ids, join_checked, stash

RISK, DELTA = 0.05, 0.05
STEPS = 64
GOOD_WEIGHT = 4
REPEAT = 8
MIN_WORDS, MAX_REPEAT = 20, 30
FEATURES = ("symbols", "dup_lines", "repeats", "capitals")


def measured(docs: DataFrame, repeat: int = REPEAT) -> DataFrame:
    """Counts of every text: one scan, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("stratum"), text.alias("t"),
        F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)).alias("words"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD))
    rows = rows.select(
        "doc_id", "stratum", F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", SPACE + "+", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        lines.alias("lines"),
        F.when(F.size("words") > repeat, F.transform(F.sequence(F.lit(0), F.size("words") - repeat), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(repeat)]))).alias("windows"))
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.select(
        "doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_capitals", F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        # Only texts in which some window comes twice go on: by hash and place, so that equal windows are neighbours.
        F.when(repeated, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("sorted"))
    same = lambda i, j: F.coalesce(F.get("sorted", j)["h"] == F.get("sorted", i)["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter(F.transform("sorted", lambda x, i: F.struct(x["i"].alias("at"), (same(i, i - 1) | same(i, i + 1)).alias("twice"))), lambda x: x["twice"]), lambda x: x["at"]))
    rows = rows.withColumn("places", places)
    start = F.struct(F.lit(-repeat).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate("places", start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(repeat), p - a["last"])).alias("n")), lambda a: a["n"])
    return rows.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_capitals", "n_lines")


def judged(rows: DataFrame) -> DataFrame:
    """measured() with base_failed and the step of each feature (its value is above (step - 1) / STEPS)."""
    part = lambda a, b: F.least(F.ceil(F.col(a) * STEPS / F.greatest(F.col(b), F.lit(1))), F.lit(STEPS)).cast("int")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return rows.withColumns({
        "base_failed": failed, "symbols": part("n_symbols", "word_chars"), "dup_lines": part("n_dup_lines", "n_lines"),
        "repeats": part("n_repeat_words", "n_words"), "capitals": part("n_capitals", "word_chars")})


def binomial_tail(r, n, p: float):
    """P(X <= r) for X binomial (n, p), exact, for r < n * p; 1 from there on."""
    import math

    odds = math.log(p / (1 - p))
    top = F.aggregate(F.sequence(F.lit(1), r), F.lit(0.0), lambda a, k: a + F.log(((n - k + 1) / k).cast("double")) + odds) + n * math.log1p(-p)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def down(a, i):
        k = r - i + 1
        term = a["term"] * k / (n - k + 1) / math.exp(odds)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    some = F.exp(top) * F.aggregate(F.sequence(F.lit(1), r), start, down, lambda a: a["sum"])
    return F.when(r >= n * p, 1.0).when(r == 0, F.exp(n * math.log1p(-p))).otherwise(some)


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """s (stratum), steps (of FEATURES), holdout, g and b: good and bad labelled documents, counted."""
    good = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).alias("good"))
    known = rows.where("not base_failed").join(good, "doc_id")
    holdout = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    key = [F.struct("stratum").alias("s"), F.struct(*FEATURES).alias("steps"), holdout.alias("holdout")]
    return known.groupBy(*key).agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))


def cutoffs(rows: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, good_weight: int = GOOD_WEIGHT) -> DataFrame:
    """stratum, level and, for each feature, its cutoff in steps; strata without a rule are left out."""
    known = stash(labelled(rows, labels), "quality-known")
    by_feature = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"steps.{f}").alias("step")) for f in FEATURES])).alias("x")
    # The share of good documents that reach a step, over the whole grid of steps: STEPS + 1 rows a stratum and feature.
    seen = known.where("not holdout").select("s", "g", by_feature).groupBy("s", "x.feature", "x.step").agg(F.sum("g").alias("g"))
    strata = known.select("s").distinct()
    grid = strata.select("s", F.explode(F.array(*map(F.lit, FEATURES))).alias("feature")).select("s", "feature", F.explode(F.sequence(F.lit(0), F.lit(STEPS))).alias("step"))
    by = Window.partitionBy("s", "feature")
    up = by.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = grid.join(seen, ["s", "feature", "step"], "left").fillna(0, ["g"])
    shares = full.select("s", "feature", "step", F.try_divide(F.sum("g").over(up), F.sum("g").over(by)).alias("share")).where("share is not null")
    shares = stash(shares, "quality-shares")
    # A document's level is the least share of its features; documents of equal steps go together.
    levels = known.select("s", "steps", "holdout", "g", "b", by_feature).select("*", "x.feature", "x.step").join(shares, ["s", "feature", "step"])
    levels = levels.groupBy("s", "steps", "holdout").agg(F.first("g").alias("g"), F.first("b").alias("b"), F.min("share").alias("level"))
    at = levels.groupBy("s", "level").agg(*[F.sum(F.when(F.col("holdout") if h else ~F.col("holdout"), F.col(c)).otherwise(0)).alias(n) for c, h, n in (("g", True, "r"), ("g", False, "good"), ("b", False, "bad"))])
    run = Window.partitionBy("s").orderBy("level")  # at most (STEPS + 1) * features rows
    tests = F.lit(delta) / F.greatest(F.lit(1), F.lit(strata.count()))
    at = at.select("s", "level", F.sum("r").over(Window.partitionBy("s")).alias("n"), *[F.sum(c).over(run).alias(c) for c in ("r", "good", "bad")])
    certified = at.where((F.col("n") > 0) & (F.col("level") < 1)).where(binomial_tail(F.col("r"), F.col("n"), risk) <= tests)
    worth = F.col("bad") - good_weight * F.col("good")
    chosen = certified.where(worth > 0).groupBy("s").agg(F.max_by("level", F.struct(worth, -F.col("level"))).alias("level"))
    cut = chosen.join(shares, "s").groupBy("s", "level").pivot("feature", list(FEATURES)).agg(F.max(F.when(F.col("share") > F.col("level"), F.col("step"))))
    return cut.select(F.col("s.stratum").alias("stratum"), "level", *[F.col(f).alias(f"max_{f}") for f in FEATURES])


def assess(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per row of docs: doc_id, the counts, base_failed and kept."""
    rows = stash(judged(measured(docs)), "quality-rows")
    limits = stash(cutoffs(rows, labels, risk, delta), "quality-cutoffs").withColumnRenamed("stratum", "of")
    out = join_checked(rows, limits, rows["stratum"].eqNullSafe(limits["of"]), "left")
    fine = F.lit(True)
    for f in FEATURES:
        fine &= F.coalesce(F.col(f) <= F.col(f"max_{f}"), F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & fine).alias("kept"))


def good_only(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, columns unchanged; a doc_id in several rows stays if one of them is kept."""
    gone = assess(docs, labels).groupBy("doc_id").agg(F.max("kept").alias("k")).where("not k and doc_id is not null")
    return drop_ids(docs, gone.select(F.col("doc_id").alias("__id")))
