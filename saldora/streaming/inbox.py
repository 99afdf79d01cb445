"""An extension, not parity: a folder of incoming documents as a stream of pages and of their text yield."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldora.sources.files import simple_pages


def inbox(spark: SparkSession, path: str, glob: str = "*", files_per_batch: int = 100) -> DataFrame:
    """doc_id, page, text, error of every file that arrives; PDF files, whose lines are put together from runs, come
    through the data source "page_runs" and pdf.page_texts in foreachBatch()."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch)
    return simple_pages(stream.load(path))


def arrivals(pages_: DataFrame) -> DataFrame:
    """Running number of pages and characters by document; complete or update mode."""
    return pages_.groupBy("doc_id").agg(F.count("page").alias("pages"), F.sum(F.length("text")).alias("chars"))
