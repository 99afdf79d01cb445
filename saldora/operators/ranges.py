"""Which pages of a document an operator reads, and whether its text can be read at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldora.functions import text as T

TERMS_PAGE_CHARS = 4000


def text_yield(pages: DataFrame) -> DataFrame:
    """doc_id, pages, chars, per_page, empty (at most 25 characters a page), sparse (under 250)."""
    out = pages.groupBy("doc_id").agg(F.count("page").alias("pages"), F.sum(F.coalesce(F.length(F.trim("text")), F.lit(0))).alias("chars"))
    per = F.when(F.col("pages") > 0, F.col("chars") / F.col("pages")).otherwise(0.0)
    empty = (F.col("pages") == 0) | (per <= 25)
    return out.select("doc_id", "pages", "chars", per.alias("per_page"), empty.alias("empty"), (~empty & (per < 250)).alias("sparse"))


def _lines(pages: DataFrame) -> DataFrame:
    return pages.select("doc_id", "page", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))


def notes_range(pages: DataFrame) -> DataFrame:
    """doc_id, first, last: pages of the notes; the whole document if no start is found."""
    marks = _lines(pages).groupBy("doc_id", "page").agg(F.max(T.is_notes_start(F.col("line"))).alias("starts"), F.max(T.is_notes_end(F.col("line"))).alias("ends"))
    first = marks.groupBy("doc_id").agg(F.min(F.when(F.col("starts"), F.col("page"))).alias("start"), F.max("page").alias("pages"), F.sort_array(F.collect_list(F.when(F.col("ends"), F.col("page")))).alias("ends"))
    end = F.array_min(F.filter("ends", lambda p: p > F.col("start")))
    return first.select("doc_id", F.coalesce("start", F.lit(1)).alias("first"), F.when(F.isnull("start"), F.col("pages")).otherwise(F.coalesce(end - 1, F.col("pages"))).alias("last"))


def terms_page(pages: DataFrame) -> DataFrame:
    """doc_id, page: the first long page of the general terms; one past the end if there is none."""
    t = F.coalesce(F.col("text"), F.lit(""))
    hit = (F.length(t) >= TERMS_PAGE_CHARS) & (t.rlike("(?i)auftragsbedingungen") | t.rlike(r"(?Um)^\s*AAB\b"))
    return pages.groupBy("doc_id").agg(F.coalesce(F.min(F.when(hit, F.col("page"))), F.max("page") + 1).alias("page"))


def statement_range(pages: DataFrame) -> DataFrame:
    """doc_id, first, last: from the start to before the terms."""
    return terms_page(pages).select("doc_id", F.lit(1).alias("first"), (F.col("page") - 1).alias("last"))


def clamp_range(start: Column, end: Column, pages: Column) -> tuple[Column, Column]:
    """A caller's zero-based range [start, end) inside the document; a null end is the document's."""
    return F.greatest(start, F.lit(0)), F.least(F.coalesce(end, pages), pages)


def within(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """The pages inside each document's range."""
    return pages.join(ranges, "doc_id").where(F.col("page").between(F.col("first"), F.col("last"))).select(*pages.columns)
