"""Results as tables and reports. Tables are written by Spark; reports are made of counts and top lists only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saldora import schemas as S
from saldora.functions import text as T


def write_sheets(sheets: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """One folder a sheet; fmt parquet, json or csv."""
    for name, df in sheets.items():
        writer = df.write.mode("overwrite")
        (writer.option("header", "true").csv if fmt == "csv" else getattr(writer, fmt))(f"{folder}/{name}")


def yoy_sheets(rows: DataFrame, text_rows: DataFrame) -> dict[str, DataFrame]:
    pick = lambda df, s: df.where(F.col("status") == s)
    return {
        "overview": rows.groupBy("pair_id", "status").agg(F.count("*").alias("n")), "all": rows, "deviations": pick(rows, S.DEVIATION), "only_current": pick(rows, S.ONLY_CURRENT), "only_prior": pick(rows, S.ONLY_PRIOR),
        "text_new": pick(text_rows, S.NEW), "text_missing": pick(text_rows, S.MISSING), "text_changed": pick(text_rows, S.CHANGED)}


def voucher_sheets(rows: DataFrame) -> dict[str, DataFrame]:
    """rows of vouch.check(): an overview of counts by document and status, and all rows with the vouchers as text."""
    shown = F.array_join(F.transform("vouchers", lambda v: F.concat_ws(": ", v["filename"], T.german_number(v["value"]))), "; ")
    return {"overview": german_status(rows.groupBy("doc_id", "status").agg(F.count("*").alias("n"))), "detail": german_status(rows.withColumn("vouchers", shown))}


def german_status(df: DataFrame, column: str = "status") -> DataFrame:
    """The status in German words; a status that has none is an error, a null stays null."""
    names = F.create_map(*[F.lit(x) for kv in S.GERMAN.items() for x in kv])
    unknown = F.raise_error(F.concat(F.lit("unknown status: "), F.col(column))).cast("string")
    return df.withColumn(column, F.when(F.col(column).isNotNull(), F.coalesce(F.try_element_at(names, F.col(column)), unknown)))


def blank_repeats(df: DataFrame, column: str, *order: str, by: str = "pair_id") -> DataFrame:
    """The column emptied where the row before has the same value, for display."""
    before = F.lag(column).over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn(column, F.when(F.col(column).eqNullSafe(before), "").otherwise(F.col(column)))


def final_status(df: DataFrame) -> DataFrame:
    """A reviewer's word over the tool's."""
    return df.withColumn("final", F.coalesce(F.nullif(F.trim("reviewer"), F.lit("")), "tool"))


def status_bars(df: DataFrame, width: int = 20) -> DataFrame:
    """status, n, bar: a share in blocks."""
    by = df.groupBy("status").agg(F.count("*").alias("n"))
    return by.select("status", "n", F.repeat(F.lit("█"), F.round(width * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).cast("int")).alias("bar"))


def markdown(rows: DataFrame, top: int = 50) -> str:
    """Counts and the first deviations of a comparison as Markdown; at most `top` rows and the counts are collected."""
    counts = rows.groupBy("status").count().orderBy("status").collect()
    some = rows.where(F.col("status") == S.DEVIATION).orderBy("pair_id", "cur_ord").limit(top + 1)
    shown = some.select("label", T.german_number(F.col("value_current")).alias("a"), T.german_number(F.col("value_prior")).alias("b")).collect()
    out = ["# Year over year", "", "| status | rows |", "| --- | --- |", *[f"| {r['status']} | {r['count']} |" for r in counts], "", "| item | opening | closing before |", "| --- | --- | --- |"]
    out += [f"| {r['label']} | {r['a']} | {r['b']} |" for r in shown[:top]]
    total = next((r["count"] for r in counts if r["status"] == S.DEVIATION), 0)
    return "\n".join(out + ([f"… {total - top} more"] if total > top else [])) + "\n"


def latest_progress(log: DataFrame) -> DataFrame:
    """The last record of each client and stage, from an append-only log (client, stage, ts, ord, …)."""
    w = Window.partitionBy("client", "stage").orderBy(F.desc("ts"), F.desc("ord"))
    return log.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def checklist_sheet(findings: DataFrame) -> DataFrame:
    """The reviewer's sheet: evidence of at most 220 characters with its page, the tool's word, a note, the final word."""
    seen = F.when(F.col("quote").isNotNull(), F.concat(F.left("quote", F.lit(220)), F.when(F.col("page").isNotNull(), F.concat(F.lit(" (p. "), F.col("page"), F.lit(")"))).otherwise("")))
    note = F.when(F.col("missing").isNotNull(), F.concat(F.lit("missing: "), F.col("missing"))).otherwise(F.col("reason"))
    return final_status(findings.select("doc_id", "item_id", "category", "description", seen.alias("evidence"), F.col("status").alias("tool"), note.alias("note"), F.col("reviewer") if "reviewer" in findings.columns else F.lit("").alias("reviewer")))


def protocol(findings: DataFrame, top: int = 200) -> str:
    """Findings of one document as Markdown, by category; at most `top` rows are collected."""
    rows = findings.orderBy("category", "item_id").limit(top + 1).select("category", "item_id", "description", "status", "reason").collect()
    counts = findings.groupBy("status").count().orderBy("status").collect()
    out, last = ["# Review", "", *[f"- {r['status']}: {r['count']}" for r in counts]], None
    for r in rows[:top]:
        if r["category"] != last:
            last = r["category"]
            out += ["", f"## {last}"]
        out.append(f"- **{r['item_id']}** {r['description']} — {r['status']}" + (f" ({r['reason']})" if r["reason"] else ""))
    return "\n".join(out + (["", f"only the first {top} findings are shown"] if len(rows) > top else [])) + "\n"


def critical(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("status").isin(S.NOT_COMPLIANT, S.NOT_ASSESSABLE))


ELEMENTS = ("share", "seat", "equity", "result")


def participation_table(elements: DataFrame) -> DataFrame:
    """doc_id, n, name and a column for each element that is to be said of a participation (rules.participation_elements)."""
    return elements.groupBy("doc_id", "n", "name").pivot("element", list(ELEMENTS)).agg(F.first("state"))


def missing_elements(elements: DataFrame) -> DataFrame:
    """doc_id, element, names: for which participations an element is not said."""
    rows = elements.where(F.col("state") != "PRESENT").groupBy("doc_id", "element")
    return rows.agg(F.transform(F.array_sort(F.collect_set(F.struct("n", "name"))), lambda x: x["name"]).alias("names"))


def participation_markdown(elements: DataFrame, statuses: DataFrame, doc_id: str, top: int = 50) -> str:
    """The finding on one document's participations as Markdown; at most `top` participations are collected."""
    said = statuses.where(F.col("doc_id") == doc_id).select("status").first()
    rows = participation_table(elements.where(F.col("doc_id") == doc_id)).orderBy("n").limit(top + 1).collect()
    mark = lambda state: "yes" if state == "PRESENT" else "no"
    out = ["# Participations", "", f"Status: {said['status'] if said else S.NOT_ASSESSABLE}", ""]
    if not rows:
        return "\n".join([*out, "No participation is named."]) + "\n"
    out += [f"| name | {' | '.join(ELEMENTS)} |", "| --- |" + " --- |" * len(ELEMENTS)]
    out += [f"| {r['name']} | {' | '.join(mark(r[e]) for e in ELEMENTS)} |" for r in rows[:top]]
    return "\n".join(out + (["", f"only the first {top} are shown"] if len(rows) > top else [])) + "\n"


def review_message(open_: DataFrame) -> DataFrame:
    """doc_id, message: what is left to do after a review, from checklist.open_summary()."""
    part = lambda c, words: F.when(F.col(c) > 0, F.concat_ws(" ", F.col(c), F.lit(words)))
    said = F.concat_ws(", ", part("to_confirm", "to confirm"), part("no_hint", "without a hint"), part("missing", "missing"))
    done = F.concat(F.lit("nothing is open"), F.when(F.col("not_applicable") > 0, F.concat(F.lit(" ("), "not_applicable", F.lit(" not applicable)"))).otherwise(""))
    return open_.select("doc_id", F.when(said == "", done).otherwise(F.concat(said, F.lit(" of "), "total", F.lit(" questions"))).alias("message"))
