"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

One scan takes the length and the hash of the first PREFIX characters of every normalised text, and counts each
(length, prefix hash). Only texts of groups with more than one member are hashed in full by a second scan; rows of
equal full hash are copies. Only lengths, hashes and ids are ever shuffled, never texts, and counts are summed
before the shuffle, so that a group holding a third of all rows costs no more than any other.

Defined cases. A null text counts as empty. All empty texts are copies of each other. Of copies, the row with the
most code points in the original text stays, on ties the smallest doc_id (null last), then the first row as read:
exactly one row of a group stays, even among repeated rows. An empty table gives an empty result. Columns other
than doc_id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldora.llm.common import SPACE, drop_ids, fits, join_checked, stash

PREFIX = 256


def normalised(text="text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE + "+", "")


def surviving_keys(docs: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """(len, head) of every group that length and prefix hash leave with two rows or more."""
    scanned = docs.select(normalised().alias("__t"))
    keys = scanned.select(F.length("__t").alias("len"), F.xxhash64(F.left("__t", F.lit(prefix))).alias("head"))
    heads = stash(keys.groupBy("len", "head").agg(F.count("*").alias("n")), "dedup-heads")
    lengths = heads.groupBy("len").agg(F.sum("n").alias("__n")).where("__n > 1").select("len")
    return join_checked(heads.where("n > 1").select("len", "head"), lengths, "len", "left_semi")


def exact_dedup(docs: DataFrame, prefix: int = PREFIX, digest_all: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_points, keep_id, group_size, kept, row_no, digest.

    digest is the SHA-256 of the normalised text; with digest_all it is also given for rows that the length or
    the prefix hash already tells from all others (None there otherwise)."""
    keys = surviving_keys(docs, prefix)
    rows = docs.select("doc_id", "text", normalised().alias("__t"))
    rows = rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_points"),
        F.length("__t").alias("len"), F.xxhash64(F.left("__t", F.lit(prefix))).alias("head"), "__t", F.monotonically_increasing_id().alias("row_no"))
    if fits(keys):
        marked = rows.join(F.broadcast(keys.withColumn("__s", F.lit(True))), ["len", "head"], "left")
    else:  # nearly every row would survive: hash all rather than shuffle texts
        marked = rows.withColumn("__s", F.lit(True))
    marked = marked.select("doc_id", "n_points", "row_no", F.coalesce("__s", F.lit(False)).alias("again"), "__t")
    digest = F.sha2("__t", 256)
    thin = stash(marked.select("doc_id", "n_points", "row_no", "again", (digest if digest_all else F.when(F.col("again"), digest)).alias("digest")), "dedup-rows")

    best = F.min(F.struct(-F.col("n_points"), F.isnull("doc_id"), F.col("doc_id").alias("id"), F.col("row_no").alias("row")))
    groups = thin.where("again").groupBy("digest").agg(F.count("*").alias("n"), best.alias("b"))
    groups = stash(groups.where("n > 1").select("digest", "n", F.col("b.id").alias("id"), F.col("b.row").alias("row")), "dedup-groups")
    # Groups of over a two-thousandth of the rows, at most 2,000 of them, are broadcast; the rest are joined by digest.
    big = max(1000, thin.count() // 2000)
    hot = F.broadcast(groups.where(F.col("n") > big))
    some = thin.where("again")
    alone = thin.where("not again").select("*", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("row"))
    cold = some.join(hot.select("digest"), "digest", "left_anti").join(groups.where(F.col("n") <= big), "digest", "left")
    found = some.join(hot, "digest").select(*alone.columns).unionByName(cold.select(*alone.columns)).unionByName(alone)
    single = F.isnull("n")
    return found.select(
        "doc_id", "n_points", F.when(single, F.col("doc_id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (single | (F.col("row") == F.col("row_no"))).alias("kept"), "row_no", "digest")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of copies, columns unchanged.

    Rows are dropped by doc_id. Where one doc_id stands in several rows, some kept and some not, those rows alone
    are told apart by their content and repeated rows among them are reduced to one."""
    decided = stash(exact_dedup(docs).select("doc_id", "n_points", "kept"), "dedup-kept")
    by_id = decided.groupBy("doc_id").agg(F.max("kept").alias("any"), F.min("kept").alias("all"))
    out = drop_ids(docs, by_id.where("not any and doc_id is not null").select(F.col("doc_id").alias("__id")))
    mixed = by_id.where("(any and not all) or (doc_id is null and not all)").select(F.col("doc_id").alias("__id"))
    if mixed.limit(1).count() == 0:
        return out
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    cols = docs.columns
    apart = join_checked(out, mixed, same, "left_semi")
    rest = join_checked(out, mixed, same, "left_anti")
    key = [F.col("doc_id").alias("__d"), F.sha2(normalised(), 256).alias("__k")]
    first = F.min_by(F.struct(*cols), F.struct(-F.coalesce(F.length("text"), F.lit(0)), F.coalesce(F.col("text"), F.lit(""))))
    one = apart.groupBy(*key).agg(first.alias("__r"))
    # A copy whose group keeps another doc_id goes as well.
    keeper = exact_dedup(docs, digest_all=True).where("kept").select("doc_id", "digest")
    one = one.join(keeper.hint("merge"), F.col("__d").eqNullSafe(keeper["doc_id"]) & (F.col("__k") == keeper["digest"]), "left_semi")
    return rest.unionByName(one.select("__r.*"))
