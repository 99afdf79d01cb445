"""Mixing sources to target weights by hash-threshold histograms.

Every row has a fixed 60-bit hash of its doc_id and text. A source that needs a part of its tokens takes the rows
whose hash is below a threshold. The threshold is found from a histogram of tokens by source and hash bucket
(2**12 buckets): the bucket in which the running sum crosses the budget is refined by the next 12 bits, all others
are settled. Nothing is sorted, a budget's rows are always among those of a larger budget (nested), and the
histogram is summed before the shuffle, so that a source holding a third of all rows is no hot key.

Defined cases. A null text has size 0 and is never taken. A null source is a source of its own, ordered last. If
all sizes are 0 every target is 0. Rows of equal doc_id and text share their hash and are taken or left together.
An empty table gives an empty result. Columns other than doc_id, text and source are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saldora.llm.common import WORD, join_checked, stash

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BITS, LEVELS = 12, 5


def keyed(docs: DataFrame) -> dict:
    """Columns of a row of docs: __key (source, null last in order), __size in words, __hash of 60 bits."""
    return {
        "__key": F.when(F.isnull("source"), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source"))),
        "__size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
        "__hash": F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - BITS * LEVELS)}


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, key, size, hash: one scan, stashed."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(n[2:]) for n, c in keyed(docs).items()])
    return stash(rows, "mix-sized")


def ranked(sources: DataFrame, parts: int = 8) -> DataFrame:
    """sources with rank, its position by code point from 0; no single task sees them all."""
    dealt = stash(sources.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()), "mix-sources")
    before = dealt.groupBy("part").count()
    before = before.alias("a").join(before.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy(F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.count"), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    return dealt.withColumn("inside", inside).join(F.broadcast(before), "part").select("key", "total", (F.col("before") + F.col("inside")).alias("rank"))


def with_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """key, total, target: the weighted share of the budget, the excess over cap times total reshared by weight."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    src = stash(ranked(sources).withColumn("w", w), "mix-ranked")
    total = src.agg(F.sum("total")).first()[0] or 0
    level, last = 0.0, -1.0
    while level != last:  # rises as more sources reach their cap, at most once per source
        over = F.col("w") * level > cap * F.col("total")
        full, free = src.agg(F.sum(F.when(over, cap * F.col("total")).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("w")))).first()
        if not free:
            break
        last, level = level, max(level, (share * total - full) / free)
    return src.select("key", "total", F.least(F.col("w") * level, (cap * F.col("total")).cast("double")).alias("target"))


def thresholds(rows: DataFrame, sources: DataFrame, bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """sources with passes (whole times every row is taken) and limit: rows of hash below it are taken once more."""
    passes = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0).cast("long")
    state = sources.withColumn("passes", passes).select("*", (F.col("target") - F.col("passes") * F.col("total")).alias("need"), F.lit(0).cast("long").alias("low"))
    state = stash(state, "mix-level")
    for k in range(levels):
        width = bits * (levels - k - 1)
        open_ = state.where("need > 0").select("key", "need", "low")
        inside = join_checked(rows.select("key", "size", "hash"), open_, "key").where(F.shiftright("hash", width + bits) == F.shiftright("low", width + bits))
        hist = inside.groupBy("key", F.shiftright("hash", width).alias("bucket")).agg(F.sum("size").alias("n"), F.countDistinct("hash").alias("hashes") if k else F.count("*").alias("hashes"))
        run = F.sum("n").over(Window.partitionBy("key").orderBy("bucket"))  # at most 2**bits rows of a source
        crossed = hist.withColumn("run", run).join(open_.select("key", "need"), "key").where("run >= need and run - n < need")
        step = crossed.select("key", F.shiftleft("bucket", width).alias("at"), (F.col("need") - F.col("run") + F.col("n")).alias("left"), F.col("n").alias("here"), "hashes")
        joined = state.drop("here", "hashes", "width").join(step, "key", "left")
        state = stash(joined.select("key", "total", "target", "passes", F.coalesce("left", "need").alias("need"), F.coalesce("at", "low").alias("low"), "here", "hashes", F.lit(width).alias("width")), "mix-level")
        if state.where("hashes > 1").limit(1).count() == 0:
            break
    # What is left of the boundary bucket is taken if that comes nearer to the target.
    near = F.coalesce(F.col("here") - F.col("need") <= F.col("need"), F.lit(False))
    return state.select("key", "total", "target", "passes", (F.col("low") + F.when(near, F.shiftleft(F.lit(1).cast("long"), width)).otherwise(0)).alias("limit"))


def times(size: str, hash_: str):
    """How often the mix takes a row."""
    extra = F.when(F.col(hash_) < F.col("limit"), 1).otherwise(0)
    return F.when(F.col(size) > 0, F.col("passes") + extra).otherwise(0).cast("long")


def source_limits(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    return thresholds(rows, with_targets(rows.groupBy("key").agg(F.sum("size").alias("total")), weights, share, cap))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken (words taken, repeats counted), times."""
    rows = sized(docs)
    out = join_checked(rows, source_limits(rows, weights, share, cap), "key").withColumn("times", times("size", "hash"))
    return out.select("doc_id", "size", F.col("total").alias("source_size"), "target", (F.col("times") * F.col("size")).alias("taken"), "times")


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Each row of docs as often as the mix takes it, columns unchanged; rows without words once.

    Texts are not shuffled: the thresholds, one row a source, are brought to the scan (unless there are too many
    sources to broadcast)."""
    limits = source_limits(sized(docs), weights, share, cap).select(F.col("key").alias("__key"), "passes", "limit")
    limits = limits.select("__key", F.struct("passes", "limit").alias("__l"))
    extra = F.when(F.col("__hash") < F.col("__l.limit"), 1).otherwise(0)
    often = F.when(F.col("__size") > 0, F.col("__l.passes") + extra).otherwise(1).cast("int")
    out = join_checked(docs.withColumns(keyed(docs)), limits, "__key").withColumn("__times", F.explode(F.array_repeat(F.lit(0), often)))
    return out.select(*docs.columns)
