"""A small knowledge base of disclosure requirements, and an inverted index over any such table.

The rows are our own short notes on what a reader may look for; a firm's own table in the same columns takes their place.
The index is a table of (kind, value, ids): one row for each paragraph, size, form and keyword, so that lookups are
equi-joins, whatever is asked and however many are asked at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "item_id string, paragraph string, title string, keywords array<string>, size_classes array<string>, forms array<string>"
_ALL, _BIG = ["klein", "mittel", "gross"], ["mittel", "gross"]
_ROWS = [
    ("R01", "§ 1", "Angewandte Methoden", ["methode", "stetigkeit"], _ALL), ("R02", "§ 2", "Entwicklung der Anlagen", ["anlagenspiegel", "zugang", "abgang"], _ALL),
    ("R03", "§ 3", "Fristen der Schulden", ["restlaufzeit", "schulden"], _ALL), ("R04", "§ 3", "Sicherheiten für Schulden", ["pfand", "sicherheit"], _ALL),
    ("R05", "§ 4", "Zahl der Beschäftigten", ["beschäftigte", "durchschnitt"], _ALL), ("R06", "§ 5", "Haftungen außerhalb der Bilanz", ["haftung", "bürgschaft"], _ALL),
    ("R07", "§ 6", "Anteile an anderen Firmen", ["anteil", "beteiligung"], _BIG), ("R08", "§ 7", "Zusammensetzung der Vorsorgen", ["rückstellung", "vorsorge"], _BIG),
    ("R09", "§ 8", "Umsätze nach Bereichen", ["umsatz", "bereich"], ["gross"]), ("R10", "§ 9", "Bezüge der Leitung", ["bezug", "leitung"], _BIG),
    ("R11", "§ 9", "Vorschüsse an die Leitung", ["vorschuss", "kredit"], _ALL), ("R12", "§ 10", "Geschäfte mit Nahestehenden", ["nahestehend"], _BIG),
    ("R13", "§ 11", "Latente Steuern", ["steuer", "latent"], _BIG), ("R14", "§ 12", "Ereignisse nach dem Stichtag", ["ereignis", "stichtag"], _ALL), ("R15", "§ 13", "Verwendung des Ergebnisses", ["ergebnis", "ausschüttung"], _BIG)]


def default(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, ["gmbh", "ag"]) for r in _ROWS], SCHEMA)


def index(requirements: DataFrame) -> DataFrame:
    """kind, value, ids of a table with item_id and any of paragraph, size_classes, forms, keywords."""
    kinds = {"paragraph": "paragraph", "size": "size_classes", "form": "forms", "keyword": "keywords"}
    parts = None
    for kind, column in kinds.items():
        if column in requirements.columns:
            many = requirements.schema[column].dataType.typeName() == "array"
            value = F.explode(column) if many else F.col(column)
            part = requirements.select(F.lit(kind).alias("kind"), value.alias("value"), "item_id").select("kind", F.lower(F.trim("value")).alias("value"), "item_id").where("value <> ''")
            parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("kind", "value").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))


def lookup(index_: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (its own columns, kind, value) with item_id of every requirement that the index has for the value."""
    rows = asked.withColumn("__v", F.lower(F.trim("value")))
    found = rows.join(index_.withColumnRenamed("value", "__v"), ["kind", "__v"])
    return found.select(*asked.columns, F.explode("ids").alias("item_id"))


def lookup_all(index_: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """by, item_id: requirements that meet every one of a group's conditions (kind, value)."""
    n = asked.groupBy(*by).agg(F.count_distinct("kind", F.lower(F.trim("value"))).alias("__n"))
    hits = lookup(index_, asked).groupBy(*by, "item_id").agg(F.count_distinct("kind", F.lower(F.trim("value"))).alias("__h"))
    return hits.join(n, by).where("__h = __n").select(*by, "item_id")


def as_checklist(requirements: DataFrame) -> DataFrame:
    """The requirements as questions, in the columns of schemas.CHECKLIST."""
    return requirements.select(
        "item_id", F.col("title").alias("category"), F.concat(F.lit("Ist angegeben: "), "title", F.lit("?")).alias("description"), F.array("paragraph").alias("references"), "keywords", F.col("size_classes").alias("applicable_to"),
        F.expr("cast(array() as array<string>)").alias("size_classes"), F.lit(True).alias("mandatory"), F.lit(True).alias("relevant"), F.lit("").alias("guidance"))
