"""Open questions put to an outside reviewer, a model or a service, in runs that can be broken off and taken up again.

A provider is any object with answer(questions) -> answers; questions are dicts of doc_id, item_id, par_ord, question and
paragraph, answers dicts of verdict (ja, nein, unklar), quote and missing, in the same order. None, the default, asks
nobody. Answers go to an append-only table, a wave of questions at a time; what is answered there is never asked again, so
that a run that was broken off, or whose time was up, goes on where it stopped and ends with the same result."""

from __future__ import annotations

import time
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from saldora import schemas as S
from saldora.functions import text as T
from saldora.operators import checklist

KEY = ["doc_id", "item_id", "par_ord"]
LEAST_QUOTE = 15
WAVES, BATCH, SECONDS = 8, 16, 180.0


class Provider(Protocol):
    def answer(self, questions: list[dict]) -> list[dict]: ...


def candidates(findings: DataFrame, paragraphs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, item_id, par_ord, rank, question, paragraph: the k best paragraphs of each question that is still open."""
    open_ = findings.where(F.col("status") == S.NOT_ASSESSABLE)
    best = checklist.evidence(open_, paragraphs, k).select(*KEY, "rank", F.col("text").alias("paragraph"))
    return best.join(open_.select("doc_id", "item_id", F.col("description").alias("question")), ["doc_id", "item_id"])


def _schema(asked: DataFrame) -> StructType:
    return StructType([asked.schema[c] for c in KEY] + [StructField(c, StringType()) for c in ("verdict", "quote", "missing")])


def answers(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The answers so far, the first of each question; none if there is no table yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).dropDuplicates(KEY)


def ask(asked: DataFrame, provider: Provider | None, path: str, seconds: float = SECONDS, waves: int = WAVES, size: int = BATCH) -> DataFrame:
    """Asks what is not answered in the table at path, for about so many seconds, and gives all answers.

    A task stops when the time is up; a batch whose provider fails is left open for the next run."""
    spark, schema = asked.sparkSession, _schema(asked)
    if provider is None:
        return answers(spark, path, schema)
    until = time.time() + seconds

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, size):
                rows = batch.slice(k, size).to_pylist()
                if time.time() >= until:
                    return
                try:
                    said = provider.answer(rows)
                except Exception:  # asked again in the next run
                    continue
                out = [{**{c: q[c] for c in KEY}, **{c: a.get(c) for c in ("verdict", "quote", "missing")}} for q, a in zip(rows, said) if a]
                if out:
                    fields = [*[batch.schema.field(c) for c in KEY], *[pa.field(c, pa.string()) for c in ("verdict", "quote", "missing")]]
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema(fields))

    for k in range(waves):
        if time.time() >= until:
            break
        wave = asked.where(F.pmod(F.xxhash64(*KEY), F.lit(waves)) == k).join(answers(spark, path, schema).select(*KEY), KEY, "left_anti")
        wave.select(*KEY, "question", "paragraph").mapInArrow(run, schema).write.mode("append").parquet(path)
    return answers(spark, path, schema)


def resolve(findings: DataFrame, said: DataFrame, asked: DataFrame) -> DataFrame:
    """findings with status and quote after all candidates: the best paragraph for which the reviewer said yes, with a
    quote that stands in it, makes a question compliant; if all were answered and none so, but one with no, it is partial;
    else it stays open. Quotes of under 15 letters, or that are not in the paragraph, prove nothing."""
    rows = asked.join(said, KEY, "left")
    quote = T.letters_only(F.coalesce("quote", F.lit("")))
    real = (F.length(quote) >= LEAST_QUOTE) & F.contains(T.letters_only(F.col("paragraph")), quote)
    yes = F.coalesce((F.col("verdict") == "ja") & real, F.lit(False))
    best = F.min_by(F.struct("quote", "par_ord"), F.when(yes, F.col("rank")))
    by = rows.groupBy("doc_id", "item_id").agg(
        F.max(yes).alias("yes"), best.alias("b"), F.max(F.coalesce(F.col("verdict") == "nein", F.lit(False))).alias("no"), F.min(F.col("verdict").isNotNull()).alias("all"))
    state = F.when(F.col("yes"), S.COMPLIANT).when(F.col("no") & F.col("all"), S.PARTIAL)
    by = by.select("doc_id", "item_id", state.alias("__state"), F.when(F.col("yes"), F.col("b.quote")).alias("__quote"))
    out = findings.join(by, ["doc_id", "item_id"], "left")
    open_ = (F.col("status") == S.NOT_ASSESSABLE) & F.col("__state").isNotNull()
    kept = F.col("quote") if "quote" in findings.columns else F.lit(None).cast("string")
    return out.withColumns({"quote": F.when(open_ & F.col("__quote").isNotNull(), F.col("__quote")).otherwise(kept), "status": F.when(open_, F.col("__state")).otherwise(F.col("status"))}).drop("__state", "__quote")


def progress(asked: DataFrame, said: DataFrame) -> DataFrame:
    """doc_id, asked, answered: how far a review is."""
    rows = asked.select(*KEY).join(said.select(*KEY, F.lit(1).alias("a")), KEY, "left")
    return rows.groupBy("doc_id").agg(F.count("*").alias("asked"), F.count("a").alias("answered"))


def first_open(asked: DataFrame, said: DataFrame, k: int = 1) -> DataFrame:
    """The k best candidates of each question that are not answered yet."""
    rows = asked.join(said.select(*KEY), KEY, "left_anti")
    order = Window.partitionBy("doc_id", "item_id").orderBy("rank")
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")
