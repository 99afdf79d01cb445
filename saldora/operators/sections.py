"""Sections of a document by its headings, document types, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Section types by words of their title, the first that fits.
TYPES = (("PARTICIPATIONS", "beteiligung|anteilsbesitz"), ("EMPLOYEES", "arbeitnehmer|personal"), ("LIABILITIES", "verbindlichkeit"), ("PROVISIONS", "rückstellung"), ("RECEIVABLES", "forderung"), ("ASSETS", "anlagevermögen|sachanlagen"), ("METHODS", "bilanzierung|bewertung"), ("GENERAL", "allgemein"))


def is_numbered(line: Column) -> Column:
    """A heading with a number: Roman, decimal with a point behind, or a letter with a point or bracket."""
    return line.rlike(r"(?U)^(?:[IVXLC]+\.|[0-9]+(?:\.[0-9]+)*+\.|[A-Za-z][.)])\s+\S")


def is_capitals(line: Column) -> Column:
    return line.rlike(r"(?U)^[A-ZÄÖÜ][A-ZÄÖÜ\s]{5,}$")


def detect_sections(documents: DataFrame, least: int = 50, words: str = "|".join(p for _, p in TYPES)) -> DataFrame:
    """doc_id, section_no, title, type, content: from each heading to the next. A heading is numbered or in capitals, or
    holds one of the words (a pattern in lower case; none if empty). Sections under `least` characters are left out but
    keep their number; a document without headings is one section."""
    rows = documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    line = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    head = is_numbered(line) | is_capitals(line)
    if words:
        head = head | F.lower(line).rlike(words)
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("head", head).withColumn("section_no", F.sum(F.col("head").cast("int")).over(w))
    by = rows.groupBy("doc_id", "section_no").agg(F.max(F.when(F.col("head"), line)).alias("title"), F.sort_array(F.collect_list(F.struct("n", "line"))).alias("l"), F.max("head").alias("headed"))
    any_ = F.max("headed").over(Window.partitionBy("doc_id"))
    by = by.withColumn("any", any_).withColumn("content", F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    by = by.where(F.when(F.col("any"), F.col("headed") & (F.length("content") >= least)).otherwise(F.lit(True)))
    kind = F.lit("OTHER")
    for name, pattern in reversed(TYPES):
        kind = F.when(F.lower("title").rlike(pattern), name).otherwise(kind)
    return by.select("doc_id", "section_no", "title", kind.alias("type"), "content")


def for_topic(sections: DataFrame, topic: str) -> DataFrame:
    """Sections with a score for a topic: 0.5 for the title, 0.1 for each mention up to 0.5."""
    t, low = topic.lower(), F.lower("content")
    n = (F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)
    score = F.when(F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(t)), 0.5).otherwise(0.0) + F.least(F.lit(0.5), 0.1 * n)
    return sections.withColumn("score", score).where("score > 0")


def document_type(path: Column, head: Column) -> Column:
    """By the file's name, else by how the text begins."""
    def rule(s: Column) -> Column:
        return F.when(s.rlike("anhang"), "NOTES").when(s.rlike("checklist|checkliste"), "CHECKLIST").when(s.rlike("gesetz|ugb"), "LAW")

    return F.coalesce(rule(F.lower(path)), rule(F.lower(F.left(head, F.lit(1000)))), F.lit("UNKNOWN"))


def search(documents: DataFrame, query: str, case_sensitive: bool = False) -> DataFrame:
    """doc_id, line_no (from 1), line of every line that holds the query."""
    rows = documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    hit = F.contains("line", F.lit(query)) if case_sensitive else F.contains(F.lower("line"), F.lit(query.lower()))
    return rows.where(hit).select("doc_id", (F.col("n") + 1).alias("line_no"), "line")


def statute_paragraphs(documents: DataFrame) -> DataFrame:
    """doc_id, number, content of a statute's paragraphs; of a repeated number the last counts."""
    rows = documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    number = F.nullif(F.regexp_extract("line", r"(?U)^\s*§\s*(\d+[a-z]?)", 1), F.lit(""))
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("number", number).withColumn("g", F.count("number").over(w)).where("g > 0")
    by = rows.groupBy("doc_id", "g").agg(F.max("number").alias("number"), F.sort_array(F.collect_list(F.struct("n", "line"))).alias("l"))
    last = Window.partitionBy("doc_id", "number").orderBy(F.desc("g"))
    return by.withColumn("r", F.row_number().over(last)).where("r = 1").select("doc_id", "number", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content"))


def scan_lines(boxes: DataFrame, band: int = 18) -> DataFrame:
    """doc_id, page, line_no, text from recognised boxes (x, y, text): sorted by bands of y, then x; a line takes all
    within `band` of its first box, so the chain is a fold over each page's sorted boxes."""
    key = F.struct((F.round(F.col("y") / band) * band).alias("k"), "x", "y", "text")
    pages = boxes.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(key)).alias("b"))
    start = F.expr("named_struct('y', cast(null as double), 'lines', cast(array() as array<array<string>>))")

    def add(a: Column, x: Column) -> Column:
        same = a["y"].isNotNull() & (F.abs(x["k"].cast("double") - a["y"]) <= band)
        grown = F.concat(F.slice(a["lines"], F.lit(1), F.size(a["lines"]) - 1), F.array(F.concat(F.element_at(a["lines"], -1), F.array(x["text"]))))
        return F.struct(F.when(same, a["y"]).otherwise(x["k"].cast("double")).alias("y"), F.when(same, grown).otherwise(F.concat(a["lines"], F.array(F.array(x["text"])))).alias("lines"))

    lines = F.aggregate("b", start, add, lambda a: a["lines"])
    return pages.select("doc_id", "page", F.posexplode(lines).alias("line_no", "words")).select("doc_id", "page", "line_no", F.array_join("words", " ").alias("text"))


def page_of_quote(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """quotes (doc_id, quote) with the first page that holds the quote's first 50 characters."""
    p = pages.select("doc_id", F.col("page").alias("__p"), F.col("text").alias("__t"))
    hit = F.min(F.when(F.contains("__t", F.left("quote", F.lit(50))), F.col("__p")))
    return quotes.join(p, "doc_id", "left").groupBy(*quotes.columns).agg(hit.alias("page"))
