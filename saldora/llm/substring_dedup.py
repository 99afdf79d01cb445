"""Substring dedup: windows of 20 words that start earlier elsewhere, found through difference-cover anchors.

Anchors are the ANCHOR-word windows that start at cover positions: those whose number modulo PERIOD is in COVER, a
perfect difference set. Whatever two places a common window has, some shift of less than PERIOD puts both on cover
positions, so that the two share an aligned anchor; 4 of 13 positions are hashed instead of all. Three rounds follow,
in each of which the chunks of the corpus ask the buckets of a hash space, one bit an answer:

1. anchors: does it occur anywhere else? Text whose anchors are unique is done with.
2. reaches: a repeated anchor is extended by all the words that windows over it can hold. If the whole reach starts
   earlier elsewhere, so do all windows over the anchor, and none of them is looked at by itself.
3. windows: those that hold a repeated anchor and none that round 2 settled. The earliest window of a sequence is
   always among them, so that "is this the first?" is answered right.

A chunk asks for a hash once however often it has it, so that a passage in a third of all documents costs its bucket
one entry a chunk. No pairs are formed. Documents are dealt to chunks by a hash, written once as a table bucketed by
chunk, and every round reads that table and its answers without shuffling a text again. Rounds 2 and 3 compare 128
bits of hash; the anchors of round 1 only choose candidates.

Defined cases. A null or blank text has no words. A document of fewer than 20 words has no window. Where a doc_id
stands in several rows they count in a fixed order (by chunk, then by text), a null doc_id after all others. An empty
table gives an empty result. Columns other than doc_id and text are not looked at. A chunk holds whole documents, so
that the longest document (about 100 bytes of memory a word) must fit into one task.
"""

from __future__ import annotations

import functools
import itertools
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldora.llm.common import new_path, stash

WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)
COVERED = np.isin(np.arange(PERIOD), COVER)
ANCHOR = WINDOW - PERIOD + 1
REACH = WINDOW - ANCHOR  # words on either side of an anchor that a window over it can hold
MB = 2**20
LEAST_BUCKETS = 32
LAST = np.iinfo(np.int64).max
ASKS = "chunk long, bucket long, asked binary"
REPLIES = "chunk long, round int, bucket long, bits binary"


LONG = 64
BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: What is kept of a little-endian 8-byte block of which only the first k bytes belong to the word.
KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of all words of the texts, and how many each text has. A key is made of the word's 8-byte blocks;
    words of over LONG bytes are hashed one by one."""
    joined = b" ".join([*texts, b" " * 8])
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate(([0], np.cumsum(size + 1)))
    inside = ~BLANK[np.frombuffer(joined, np.uint8)]
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        change = np.concatenate(([0], change))
    start, length = change[::2], change[1::2] - change[::2]
    blocks = np.ndarray((len(joined) - 7,), "<u8", joined, strides=(1,))
    key = paired(blocks[start] & KEEP[np.minimum(length, 8)], length.astype(np.uint64), 0)
    rest = np.flatnonzero((length > 8) & (length <= LONG))
    for k in range(8, LONG, 8):
        if not len(rest):
            break
        key[rest] = paired(key[rest], blocks[start[rest] + k] & KEEP[np.minimum(length[rest] - k, 8)], 0)
        rest = rest[length[rest] > k + 8]
    for i in np.flatnonzero(length > LONG).tolist():
        key[i] = xxhash.xxh3_64_intdigest(joined[start[i] : start[i] + length[i]])
    return key, np.diff(np.searchsorted(start, begin))


def paired(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """A hash of two neighbouring hashes that knows their order."""
    x = a * np.uint64(0x9E3779B97F4A7C15 + 2 * seed) + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(31)
    return x


def eights(keys: np.ndarray) -> np.ndarray:
    """Hashes of ANCHOR (8) keys from every place, by doubling."""
    h, size = keys, 1
    while size < ANCHOR:
        h, size = paired(h[:-size], h[size:], 0), 2 * size
    return h


def spans_of(h8: np.ndarray, at: np.ndarray, shifts: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash, as two arrays, of what the anchors at these distances cover, from the places given."""
    parts = [h8[at + k] for k in shifts]
    return functools.reduce(lambda x, y: paired(x, y, 1), parts), functools.reduce(lambda x, y: paired(x, y, 2), parts)


class Chunk:
    """The documents of a chunk in order, as one array of word keys with REACH zeros around each document."""

    def __init__(self, table: pa.Table):
        ids, texts = table.column("doc_id"), table.column("text").cast(pa.binary()).to_pylist()
        null = np.asarray(ids.is_null().to_numpy())
        doc = ids.fill_null(LAST).to_numpy()
        order = sorted(range(len(texts)), key=lambda i: (doc[i], null[i], texts[i]))
        self.doc, self.null = doc[order], null[order]
        self.texts = [texts[i] for i in order]
        keys, self.n = word_keys(self.texts)
        self.start = REACH + np.concatenate(([0], np.cumsum(self.n + REACH)))[:-1].astype(np.int64)
        self.size = int(REACH + np.sum(self.n + REACH))
        self.keys = np.zeros(self.size, np.uint64)
        self.room = np.zeros(self.size, np.int32)  # words from here to the end of the document, none in short ones
        first = np.cumsum(self.n) - self.n
        at = np.arange(len(keys)) + np.repeat(self.start - first, self.n)
        self.keys[at] = keys
        left = np.repeat(first + self.n, self.n) - np.arange(len(keys))
        self.room[at] = np.where(np.repeat(self.n >= WINDOW, self.n), left, 0)

    @functools.cached_property
    def h8(self) -> np.ndarray:
        return eights(self.keys) if self.size > ANCHOR else np.zeros(0, np.uint64)

    @functools.cached_property
    def anchors(self) -> np.ndarray:
        return np.flatnonzero((self.room >= ANCHOR) & np.resize(COVERED, self.size))

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The doc_ids of places."""
        return self.doc[np.searchsorted(self.start, at, side="right") - 1]

    def near(self, flagged: np.ndarray) -> np.ndarray:
        """For every place: whether one of the flagged anchors lies in the window from there."""
        mark = np.zeros(self.size + PERIOD + 1, np.int32)
        mark[flagged + 1] = 1
        run = np.cumsum(mark, dtype=np.int32)
        return run[PERIOD : PERIOD + self.size] > run[: self.size]


def first_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of hashes: places of the first of each kind, in order of the hashes, and every pair's kind."""
    order = np.lexsort((b, a))  # stable: equal pairs stay in order of place
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    kind = np.empty(len(a), np.int64)
    kind[order] = np.cumsum(new) - 1
    return order[new], kind


class Rounds:
    """What a chunk asks in each round, given the answers to those before."""

    def __init__(self, chunk: Chunk, replies: dict[int, np.ndarray]):
        self.chunk, self.replies = chunk, replies

    @functools.cached_property
    def anchors(self):
        return np.unique(self.chunk.h8[self.chunk.anchors], return_inverse=True, return_counts=True)

    @functools.cached_property
    def repeated(self) -> np.ndarray:
        """Places of anchors that occur more than once."""
        _, kind, count = self.anchors
        return self.chunk.anchors[((count > 1) | self.replies[1][: len(count)])[kind]]

    @functools.cached_property
    def reach_hashes(self):
        return spans_of(self.chunk.h8, self.repeated - REACH, (0, 8, 16, 24))

    @functools.cached_property
    def reaches(self):
        return first_of(*self.reach_hashes)

    @functools.cached_property
    def settled(self) -> np.ndarray:
        """For every place: whether the window from there holds an anchor whose reach starts earlier elsewhere."""
        first, kind = self.reaches
        later = np.ones(len(kind), bool)
        later[first[self.replies[2][: len(first)]]] = False
        return self.chunk.near(self.repeated[later])

    @functools.cached_property
    def open(self) -> np.ndarray:
        """Places of windows that must be asked for by themselves."""
        return np.flatnonzero((self.chunk.room >= WINDOW) & self.chunk.near(self.repeated) & ~self.settled)

    @functools.cached_property
    def window_hashes(self):
        return spans_of(self.chunk.h8, self.open, (0, 8, WINDOW - ANCHOR))

    @functools.cached_property
    def windows(self):
        return first_of(*self.window_hashes)

    def removed(self) -> np.ndarray:
        """For every place: whether its word is covered by a window that starts earlier elsewhere."""
        first, kind = self.windows
        later = np.ones(len(kind), bool)
        later[first[self.replies[3][: len(first)]]] = False
        starts = (self.chunk.room >= WINDOW) & self.settled
        starts[self.open[later]] = True
        at = np.flatnonzero(starts)
        change = np.zeros(self.chunk.size + 1, np.int32)
        change[at] += 1
        np.subtract.at(change, at + WINDOW, 1)
        return np.cumsum(change)[:-1] > 0

    def asked(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes and, a row each, the bytes that the bucket compares (and from round 2 on the doc_id)."""
        if number == 1:
            h = self.anchors[0]
            return h, h.view(np.uint8).reshape(-1, 8)[:, :6]
        (a, b), (first, _), places = (self.reach_hashes, self.reaches, self.repeated) if number == 2 else (self.window_hashes, self.windows, self.open)
        rows = np.stack((a[first], b[first], self.chunk.owner(places[first]).astype(np.uint64)), axis=1)
        return a[first], np.ascontiguousarray(rows).view(np.uint8).reshape(-1, 24)


def bits_of(replies: pa.Table | None) -> dict[int, np.ndarray]:
    """The answers of each round in order of the buckets, which is the order of the hashes."""
    found: dict[int, list] = {1: [], 2: [], 3: []}
    if replies is not None:
        for r in sorted(replies.to_pylist(), key=lambda r: (r["round"], r["bucket"])):
            n = int.from_bytes(r["bits"][:4], "little")
            found[r["round"]].append(np.unpackbits(np.frombuffer(r["bits"], np.uint8, offset=4), count=n).astype(bool))
    return {k: np.concatenate(v) if v else np.zeros(0, bool) for k, v in found.items()}


def asks_of(number: int, buckets: int, key: int, table: pa.Table, replies: pa.Table | None) -> pa.Table:
    hashes, rows = Rounds(Chunk(table), bits_of(replies)).asked(number)
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    asked = [rows[a:b].tobytes() for a, b in itertools.pairwise([*edge.tolist(), len(bucket)])]
    return pa.table({"chunk": pa.array([key] * len(asked), pa.int64()), "bucket": bucket[edge].astype(np.int64), "asked": pa.array(asked, pa.binary())})


def answers_of(number: int, table: pa.Table) -> pa.Table:
    """A bucket's answers. Round 1: is the hash another chunk's as well? Later: is this the first by doc_id and chunk?"""
    blocks, chunk = table.column("asked").to_pylist(), table.column("chunk").to_numpy()
    width = 6 if number == 1 else 24
    sizes = [len(b) // width for b in blocks]
    rows = np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, width)
    if number == 1:
        wide = np.zeros((len(rows), 8), np.uint8)
        wide[:, :6] = rows
        _, kind, count = np.unique(wide.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
        yes = (count > 1)[kind]
    else:
        a, b, doc = np.ascontiguousarray(rows).view(np.uint64).T
        order = np.lexsort((np.repeat(chunk, sizes), doc.astype(np.int64), b, a))
        new = np.ones(len(rows), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        yes = np.empty(len(rows), bool)
        yes[order] = new
    cuts = np.cumsum([0, *sizes])
    bits = [(j - i).to_bytes(4, "little") + np.packbits(yes[i:j]).tobytes() for i, j in itertools.pairwise(cuts.tolist())]
    out = pa.table({"chunk": chunk, "round": pa.array([number] * len(bits), pa.int32()), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})
    return out


def kept_of(table: pa.Table, replies: pa.Table) -> pa.Table:
    chunk = Chunk(table)
    gone = Rounds(chunk, bits_of(replies)).removed()
    n_gone, kept = [], []
    for text, a, n in zip(chunk.texts, chunk.start.tolist(), chunk.n.tolist()):
        words, drop = text.split(), gone[a : a + n]
        n_gone.append(int(np.count_nonzero(drop)))
        kept.append(b" ".join(itertools.compress(words, (~drop).tolist()) if n_gone[-1] else words).decode())
    return pa.table({"doc_id": pa.array(chunk.doc, pa.int64(), mask=chunk.null), "n_words": chunk.n, "n_removed": pa.array(n_gone, pa.int64()), "kept": pa.array(kept, pa.string())})


def dealt(docs: DataFrame, parts: int, chunks: int) -> DataFrame:
    """chunk, doc_id, text as a table bucketed by chunk, in the shared folder."""
    spark, name = docs.sparkSession, f"substring_dedup_{uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"), "doc_id", "text").repartition(parts, "chunk")
    path = new_path(spark, "dedup-chunks")
    rows.write.option("compression", "zstd").option("path", path).bucketBy(parts, "chunk").sortBy("chunk").saveAsTable(name)
    return spark.table(name)


def deduplicated(docs: DataFrame, chunk_mb: int = 4, bucket_mb: int = 32) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept (the words that stay, joined by one space).

    Chunks and buckets hold about so many MB of text; both grow with very large corpora, so that a chunk's questions
    to a bucket stay worth a row."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunk_size, bucket_size = min(64 * MB, max(chunk_mb * MB, total >> 16)), min(1024 * MB, max(bucket_mb * MB, total >> 14))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(100_000, max(least, total // (128 * MB) + 1))
    # A chunk gives a bucket one row a round, so that their product is kept small: it does not follow the partitions.
    chunks, buckets = max(4 * parts, total // chunk_size + 1), max(LEAST_BUCKETS, total // bucket_size + 1)
    table = dealt(docs, parts, chunks)

    # Spark tells a function's kind by the number of its arguments.
    def first(key, texts):
        return asks_of(1, buckets, key[0].as_py(), texts, None)

    def asking(number):
        return lambda key, texts, answers: asks_of(number, buckets, key[0].as_py(), texts, answers)

    def answering(number):
        return lambda asks: answers_of(number, asks)

    replies = None
    for number in (1, 2, 3):
        if replies is None:
            asks = table.groupBy("chunk").applyInArrow(first, ASKS)
        else:
            asks = table.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(asking(number), ASKS)
        answers = stash(asks.groupBy("bucket").applyInArrow(answering(number), REPLIES), f"dedup-replies{number}")
        replies = answers if replies is None else replies.unionByName(answers)
    return table.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(kept_of, "doc_id long, n_words long, n_removed long, kept string")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
