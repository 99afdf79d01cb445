"""Disclosed positions against the facts in supporting files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldora import schemas as S
from saldora.functions import text as T

#: Sections of the notes and the type of fact that proves them.
SECTION_TYPES = {"Haftungsverhaeltnisse": "bank_guarantees", "Arbeitnehmer": "hr_employees"}
TOLERANCE = 0.02
#: Words of a head count table, and of a bank's total line.
STAFF = "arbeitnehmer|angestellte|arbeiter|dienstnehmer|durchschnittlich"
BANK_TOTAL = r"SUMME EURGGW|SUMME EUR |GESAMT-SUMME|GESAMTOBLIGO|SUMME OBLIGO|SUMME HAFTUNG|SUMME GARANTIE|SUMME BANKGARANTIE"
STAFF_NOTE = "average in the notes, head count at the closing date in the file: may differ by method"


def positions(pages: DataFrame) -> DataFrame:
    """schemas.POSITIONS: liabilities and head count, the first of each document.

    A line meets its neighbours within its page's row; only the lines that disclose something are shuffled, as numbers."""
    staff = F.coalesce(F.lower("text").rlike(STAFF + "|mitarbeiter"), F.lit(False))
    rows = pages.select("doc_id", "page", staff.alias("staff"), F.split(F.coalesce("text", F.lit("")), "\n").alias("l"))
    before = lambda i: F.lower(F.array_join(F.slice("l", F.greatest(i - 14, F.lit(1)), F.least(i, F.lit(15))), "\n"))
    is_liable = lambda x: x.rlike(r"(?Ui)Gesamtbetrag\s+der\s+Haftungsverh")
    is_total = lambda x, i: x.rlike(r"(?Ui)^\s*Gesamt\b") & F.col("staff") & before(i).rlike(STAFF)
    told = F.filter(F.transform("l", lambda x, i: F.struct(i.alias("n"), x.alias("line"), is_liable(x).alias("liable"), is_total(x, i).alias("total"))), lambda x: x["liable"] | x["total"])
    rows = rows.select("*", F.explode(told).alias("x")).select("doc_id", "page", "x.*", F.get("l", F.col("x.n") + 1).alias("next"))
    rows = rows.withColumn("own", T.trailing_numbers(F.col("line")))
    below = lambda other: T.bind(F.when(F.size("own") > 0, F.col("own")).otherwise(other), lambda v: v)
    liable = F.when(F.col("liable"), F.struct(F.lit(True).alias("liable"), below(F.coalesce(T.trailing_numbers(F.col("next")), T.no_values())).alias("nums")))
    total = F.when(F.col("total"), F.struct(F.lit(False).alias("liable"), below(T.all_numbers(F.col("line"))).alias("nums")))
    found = rows.select("doc_id", "page", "n", "line", F.explode(F.array_compact(F.array(liable, total))).alias("x")).select("doc_id", "page", "n", "line", "x.*")
    found = found.select("doc_id", "page", "n", "line", "liable", F.size("nums").alias("k"), F.get("nums", 0).alias("current_value"), F.get("nums", 1).alias("prior_value"))
    found = found.where((F.col("k") > 0) & (F.col("liable") | (F.col("current_value") > 0)))
    # The row that none comes before. A row number of 1 would make Spark sort each task's rows before the shuffle, too.
    first = Window.partitionBy("doc_id", "liable").orderBy("page", "n")
    found = found.withColumn("earlier", F.lag("n").over(first)).where("earlier is null")
    either = lambda a, b: F.when(F.col("liable"), a).otherwise(b)
    return found.select(
        "doc_id", either("Haftungsverhaeltnisse", "Arbeitnehmer").alias("section"), either("Gesamtbetrag der Haftungsverhältnisse", "Durchschnittliche Arbeitnehmer (Gesamt)").alias("label"),
        "current_value", "prior_value", "page", F.trim("line").alias("source_line"), either("", STAFF_NOTE).alias("note"))


def bank_totals(pages: DataFrame) -> DataFrame:
    """schemas.FACTS: the largest total line of each bank statement; pages with a filename."""
    rows = pages.select("doc_id", "filename", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    up = F.upper("line")
    rows = rows.where(up.rlike(BANK_TOTAL) | F.trim(up).isin("SUMME EUR", "TOTAL EUR")).select("*", F.try_element_at(T.trailing_numbers(F.col("line")), F.lit(-1)).alias("value")).where("value > 0")
    best = rows.groupBy("doc_id", "filename").agg(F.max_by(F.struct("value", "line"), "value").alias("b"))
    return best.select("doc_id", F.lit("bank_guarantees").alias("source_type"), F.lit("guarantees, total").alias("label"), F.col("b.value").alias("value"), "filename", F.trim("b.line").alias("source_line"), F.lit("").alias("sheet"))


def head_counts(cells: DataFrame, entity_codes: tuple[str, ...] = ()) -> DataFrame:
    """Head count of a staff workbook: the entity's row before the total row; summary sheets before others, detail
    sheets last. cells: schemas.CELLS with doc_id; sheets of over 50 rows are lists of persons, not totals."""
    size = Window.partitionBy("path", "sheet")
    rows = cells.withColumn("rows", F.max("row").over(size)).where("rows <= 50").groupBy("doc_id", "path", "sheet", "sheet_ord", "row").agg(F.sort_array(F.collect_list(F.struct("col", "value"))).alias("c"))
    texts = F.lower(F.array_join(F.transform("c", lambda x: x["value"]), " "))
    numbers = F.filter(F.transform("c", lambda x: x["value"].try_cast("double")), lambda v: v.isNotNull() & (v > 0) & (v == F.floor(v)) & (v < 10000))
    rank = F.when(F.lower("sheet").rlike("zusammen|übersicht|summary"), 0).when(F.lower("sheet").rlike("detail|liste"), 2).otherwise(1)
    code = F.lit(False)
    for e in entity_codes:
        code = code | F.contains(texts, F.lit(e.lower()))
    kind = F.when(code, 0).when(texts.rlike("gesamt|summe|total"), 1).otherwise(2)
    rows = rows.select("*", rank.alias("rank"), kind.alias("kind"), F.try_element_at(numbers, F.lit(-1)).alias("value")).where("value is not null")
    first = Window.partitionBy("path").orderBy("kind", "rank", "sheet_ord", F.when(F.col("kind") < 2, F.col("row")).otherwise(-F.col("row")))
    rows = rows.withColumn("r", F.row_number().over(first)).where("r = 1")
    return rows.select("doc_id", F.lit("hr_employees").alias("source_type"), F.lit("head count").alias("label"), "value", F.col("path").alias("filename"), F.lit("").alias("source_line"), "sheet")


def check(positions_: DataFrame, facts: DataFrame, tolerance: Column | float = TOLERANCE, section_types: dict[str, str] = SECTION_TYPES) -> DataFrame:
    """Positions with the sum of their facts and a status. Facts are summed before the join."""
    kind = F.create_map(*[F.lit(x) for kv in section_types.items() for x in kv])
    total = facts.groupBy("doc_id", "source_type").agg(F.sum("value").alias("voucher_value"), F.sort_array(F.collect_list(F.struct("filename", "label", "value"))).alias("vouchers"))
    rows = positions_.withColumn("source_type", F.try_element_at(kind, F.col("section"))).join(total, ["doc_id", "source_type"], "left")
    diff = F.col("current_value") - F.col("voucher_value")
    status = (
        F.when(F.isnull("voucher_value"), S.NO_VOUCHER).when(F.isnull("current_value"), S.NO_VALUE)
        .when(F.abs(diff) <= tolerance, F.when(F.coalesce("note", F.lit("")) != "", S.NOTE).otherwise(S.OK)).otherwise(S.DEVIATION))
    return rows.select("doc_id", "section", "label", "current_value", "voucher_value", diff.alias("difference"), status.alias("status"), "page", "note", "vouchers")


def counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id").agg(
        F.count_if(F.col("status").isin(S.OK, S.NOTE)).alias("ok"), F.count_if(F.col("status") == S.DEVIATION).alias("deviation"), F.count_if(F.col("status") == S.NO_VOUCHER).alias("no_voucher"))


def recognised(facts: DataFrame) -> DataFrame:
    """doc_id, source_types: the distinct kinds of supporting files that gave a fact, sorted; unknown ones are left out."""
    return facts.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(F.col("source_type") != "unknown", F.col("source_type")))).alias("source_types"))


def voucher_type(head: Column) -> Column:
    """The type of a supporting file from its first pages or rows, the first rule that holds."""
    s = F.lower(head)
    return (
        F.when(s.rlike("garantie|obligo|bürgschaft"), "bank_guarantees").when(s.rlike("dienstnehmer|personalstand|mitarbeiter|headcount"), "hr_employees")
        .when(s.rlike("rückstellung"), "provisions").when(s.rlike("forderung|debitor"), "receivables").when(s.rlike("verbindlichkeit|kreditor"), "payables").otherwise("unknown"))
