"""Many patterns looked for in many texts: one pass over a text finds all of them, with an Aho-Corasick automaton.

What is found is a table of ids and patterns; texts are neither joined nor shuffled, and no row carries a text once for
each question that is asked of it."""

from __future__ import annotations

from collections import Counter
from uuid import uuid4

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Characters of the patterns that are brought to the tasks at once; more patterns make more passes over the texts.
SET_CHARS = 4_000_000
#: Passes over the texts at most; patterns of a group beyond that go to the group's texts instead.
PASSES = 8
_built: dict = {}


def automaton(patterns) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for p in patterns:
        out.add_word(p, p)
    out.make_automaton()
    return out


def _found(automaton, batch: pa.RecordBatch, by: list[str], text: str) -> pa.RecordBatch | None:
    rows, names, times = [], [], []
    for k, t in enumerate(batch.column(batch.schema.get_field_index(text)).to_pylist()):
        if t:
            for name, n in Counter(p for _, p in automaton.iter(t)).items():
                rows.append(k)
                names.append(name)
                times.append(n)
    if not rows:
        return None
    kept = [batch.column(batch.schema.get_field_index(c)).take(pa.array(rows)) for c in by]
    return pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(times, pa.int64())], [*by, "pattern", "times"])


def _search(sent, by: list[str], text: str):
    mark = uuid4().hex

    def run(batches):
        if mark not in _built:  # a worker builds an automaton once and keeps one
            _built.clear()
            _built[mark] = automaton(sent.value)
        for batch in batches:
            if (made := _found(_built[mark], batch, by, text)) is not None:
                yield made

    return run


def _schema(texts: DataFrame, by: list[str]) -> StructType:
    return StructType([texts.schema[c] for c in by] + [StructField("pattern", StringType()), StructField("times", LongType())])


def found_in(texts: DataFrame, by: list[str], text: str, patterns: DataFrame) -> DataFrame:
    """The columns `by` of texts, pattern, times: every pattern that occurs in the column `text`, and how often, counting
    occurrences that overlap. Empty and null patterns occur nowhere. patterns: a column pattern.

    Patterns are brought to the tasks in sets of about SET_CHARS characters."""
    spark, schema = texts.sparkSession, _schema(texts, by)
    known = patterns.where("pattern <> ''").select("pattern").distinct()
    chars = known.agg(F.sum(F.length("pattern"))).first()[0] or 0
    sets = -(-chars // SET_CHARS)
    out = None
    for k in range(sets):
        some = [r.pattern for r in known.where(F.pmod(F.xxhash64("pattern"), F.lit(sets)) == k).collect()]  # about SET_CHARS characters
        if not some:
            continue
        got = texts.select(*by, text).mapInArrow(_search(spark.sparkContext.broadcast(some), by, text), schema)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], schema)


def contained(texts: DataFrame, group: str, text: str, keys: DataFrame) -> DataFrame:
    """group, key: the rows of keys (group, key) whose key occurs in a text of the group.

    Keys of all groups are looked for in all texts at once, unless that would take more than PASSES passes; then a
    group's keys and texts are brought together, which shuffles the texts once."""
    asked = keys.where("key <> ''").select(group, F.col("key").alias("pattern")).distinct()
    chars = asked.select("pattern").distinct().agg(F.sum(F.length("pattern"))).first()[0] or 0
    if chars <= PASSES * SET_CHARS:
        hits = found_in(texts, [group], text, asked).select(group, "pattern").distinct()
        return asked.join(hits, [group, "pattern"]).select(group, F.col("pattern").alias("key"))

    def of_group(held: pa.Table, wanted: pa.Table) -> pa.Table:
        built, seen = automaton(wanted.column("pattern").to_pylist()), set()
        for t in held.column(text).to_pylist() if wanted.num_rows else []:
            seen |= {p for _, p in built.iter(t or "")}
        name = wanted.column(group).slice(0, 1).to_pylist() if seen else []
        return pa.table({group: pa.array(name * len(seen), wanted.schema.field(group).type), "key": pa.array(sorted(seen), pa.string())})

    schema = StructType([asked.schema[group], StructField("key", StringType())])
    return texts.select(group, text).groupBy(group).cogroup(asked.groupBy(group)).applyInArrow(of_group, schema)
