"""From documents to pieces: language, exact copies, near copies, mix of sources, segmentation.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.

    language_id    drops documents whose language is und or scores below 0.5
    exact_dedup    keeps one document of each group of equal texts (white space aside)
    ngram_jaccard  keeps the smallest doc_id of each component of linked documents
    mix_sources    gives each document as often as the mix takes it; documents without words once
    nbest_pieces   the best segmentations of every text that is left

An empty documents table passes through all stages. Nulls in any column are allowed: see each operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from saldora.llm.common import documents, stash
from saldora.llm.dedup import keep_one
from saldora.llm.jaccard import one_of_each
from saldora.llm.langid import known_language
from saldora.llm.mixing import mixed
from saldora.llm.nbest import segmented
from saldora.llm.queries import tokenizer

PIECES = "piece_bpe_32k.model"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return known_language(docs, tokenizer(PIECES))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def nbest_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return segmented(docs, tokenizer(PIECES))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("mix_sources", mix_sources),
    ("nbest_pieces", nbest_pieces),
]

#: The model of language_id and the segmentations have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
