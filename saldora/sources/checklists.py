"""Checklists from JSON, workbooks and page texts, in the columns of schemas.CHECKLIST."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Header words of a workbook by column.
HEADERS = {
    "item_id": ("id", "nr", "nummer"), "category": ("kategorie", "category"), "description": ("frage", "beschreibung", "description", "question"), "references": ("rechtsgrundlage", "reference"),
    "keywords": ("stichworte", "keywords"), "mandatory": ("pflicht", "mandatory"), "applicable_to": ("anwendbar", "applicable"), "size_classes": ("größenklasse", "size class")}


def split_multi(value: Column) -> Column:
    """Parts between semicolons or line breaks, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), "[;\n]"), lambda t: F.trim(t)), lambda x: x != "")


def truthy(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit("")))).isin("ja", "j", "yes", "y", "true", "wahr", "1", "x")


def from_json(spark: SparkSession, path: str) -> DataFrame:
    schema = "name string, version string, items array<struct<item_id: string, category: string, description: string, references: array<string>, keywords: array<string>, applicable_to: array<string>, size_classes: array<string>, mandatory: boolean, relevant: boolean, guidance: string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("items").alias("i")).select("i.*")
    none = F.expr("cast(array() as array<string>)")
    return rows.withColumns({**{c: F.coalesce(c, none) for c in ("references", "keywords", "applicable_to", "size_classes")}, "mandatory": F.coalesce("mandatory", F.lit(True)), "relevant": F.coalesce("relevant", F.lit(True))})


def from_cells(cells: DataFrame) -> DataFrame:
    """The sheet with a matching header and most rows; categories from sheets named after them, relevance from the
    overview sheet (a category and yes or no in a row)."""
    head = cells.where("row = 1").withColumn("h", F.lower(F.trim("value")))
    name = F.lit(None).cast("string")
    for col, words in HEADERS.items():
        name = F.when(F.col("h").isin(*words) | F.col("h").rlike("^(" + "|".join(words) + r")\b"), F.coalesce(name, F.lit(col))).otherwise(name)
    head = head.select("path", "sheet", "col", name.alias("name")).where("name is not null")
    good = head.groupBy("path", "sheet").agg(F.collect_set("name").alias("names")).where(F.array_contains("names", "item_id") & F.array_contains("names", "description"))
    size = cells.join(good, ["path", "sheet"]).groupBy("path", "sheet", "sheet_ord").agg(F.max("row").alias("rows"))
    main = size.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("rows"), "sheet_ord"))).where("r = 1").select("path", "sheet")
    rows = cells.where("row > 1").join(head, ["path", "sheet", "col"]).groupBy("path", "sheet", "row").pivot("name", list(HEADERS)).agg(F.first("value"))
    named = rows.join(good.select("path", "sheet"), ["path", "sheet"], "left_semi").join(main, ["path", "sheet"], "left_anti").where("item_id is not null").groupBy("path", "item_id").agg(F.min("sheet").alias("sheet_category"))
    over = cells.where(F.lower("sheet").isin("start", "overview", "übersicht")).groupBy("path", "row").agg(F.max(F.when(F.col("col") == 2, F.col("value"))).alias("category"), F.max(F.when(F.col("col") == 4, F.lower(F.trim("value")))).alias("yes"))
    over = over.where("category is not null").select("path", "category", (~F.col("yes").isin("nein", "no")).alias("relevant"))
    out = rows.join(main, ["path", "sheet"]).join(named, ["path", "item_id"], "left").withColumn("category", F.coalesce("category", "sheet_category")).join(over, ["path", "category"], "left")
    return out.where("item_id is not null and description is not null").select(
        "item_id", "category", "description", *[split_multi(F.col(c)).alias(c) for c in ("references", "keywords", "applicable_to", "size_classes")], truthy(F.col("mandatory")).alias("mandatory"), F.coalesce("relevant", F.lit(True)).alias("relevant"), F.lit("").alias("guidance"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Numbered questions of a text, with up to five long words as keywords."""
    pattern = r"(?Um)^\s*(\d+(?:\.\d+)*)[.)]?\s+(\S.{10,})$"
    rows = pages.select("doc_id", F.posexplode(F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("id"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("q"))).alias("n", "x"))
    words = F.slice(F.array_distinct(F.regexp_extract_all(F.lower("x.q"), F.lit("[a-zäöüß]{6,}"), F.lit(0))), 1, 5)
    return rows.select("doc_id", F.col("x.id").alias("item_id"), F.col("x.q").alias("description"), words.alias("keywords"))


def default_checklist(spark: SparkSession) -> DataFrame:
    """A short list of our own, for runs without a checklist."""
    rows = [
        ("001", "Methoden", "Sind die Bilanzierungsmethoden beschrieben?", ["§ 1"], ["methoden"], ["alle"]), ("010", "Anlagevermögen", "Ist die Entwicklung des Anlagevermögens dargestellt?", ["§ 2"], ["anlagenspiegel"], ["alle"]),
        ("020", "Verbindlichkeiten", "Sind Restlaufzeiten der Verbindlichkeiten angegeben?", ["§ 3"], ["restlaufzeit"], ["mittel", "gross"]), ("030", "Personal", "Ist die durchschnittliche Zahl der Arbeitnehmer angegeben?", ["§ 4"], ["arbeitnehmer"], ["alle"]),
        ("040", "Haftungen", "Ist der Gesamtbetrag der Haftungsverhältnisse angegeben?", ["§ 5"], ["haftungsverhältnisse"], ["alle"])]
    schema = "item_id string, category string, description string, references array<string>, keywords array<string>, applicable_to array<string>"
    none = F.expr("cast(array() as array<string>)")
    return spark.createDataFrame(rows, schema).select("*", none.alias("size_classes"), F.lit(True).alias("mandatory"), F.lit(True).alias("relevant"), F.lit("").alias("guidance"))
