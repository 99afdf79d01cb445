"""Token counts by rank-synchronous array merging.

Distinct pre-tokens of a batch are held as one ragged numpy array of symbols. In each round every sequence merges all
occurrences of its own lowest-rank pair at once; sequences with no pair left are done, and what is left of them is
counted. That gives the counts of one-at-a-time BPE: a pair that holds a merged symbol ranks after the merge that
made the symbol, and of overlapping equal pairs the leftmost are taken, as one at a time would.

Defined cases. A null or empty text has 0 bytes and 0 tokens. Special strings inside a text count as one token each,
as the tokenizers library does by default. Texts are never cut. Repeated rows are counted each. Columns other than
doc_id and text are not looked at. Memory: one Arrow batch, and at most CACHE counts of pre-tokens per worker.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from saldora.llm.common import tidy, tool
from saldora.llm.pretokens import byte_symbols, word_level

CACHE = 300_000
SLICE = 256
NONE = np.iinfo(np.int32).max


class ArrayMerger:
    """Counts BPE tokens of many pre-tokens at once; built from a tokenizer file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, end = data["model"]["vocab"], data["model"]["end_of_word_suffix"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        self.special = [t["content"] for t in data["added_tokens"] if t["special"]]
        self.size = max(vocab.values()) + 1
        pairs = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        order = np.argsort(pairs, kind="stable")
        self.keys, self.ranks = pairs[order], order.astype(np.int32)
        self.first = np.array([vocab[c] for c in byte_symbols()], np.int32)
        self.last = np.array([vocab[c + end] for c in byte_symbols()], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each non-empty word."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        out = lens.copy()
        if not len(raw):
            return out
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.first[data]
        ends = np.cumsum(lens) - 1
        sym[ends] = self.last[data[ends]]
        who = np.arange(len(raw))  # the words still active; lens are their lengths now
        # rank[i] is that of the pair (i, i + 1), NONE at the last symbol of a word
        rank = np.full(len(sym), NONE, np.int32)
        inner = np.ones(len(sym), bool)
        inner[ends] = False
        i = np.flatnonzero(inner)
        rank[i] = self.rank(sym[i], sym[i + 1])
        while True:
            starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
            low = np.minimum.reduceat(rank, starts)
            live = low < NONE
            if not live.all():
                out[who[~live]] = lens[~live]
                if not live.any():
                    return out
                stay = np.repeat(live, lens)
                sym, rank, low, lens, who = sym[stay], rank[stay], low[live], lens[live], who[live]
            hit = rank == np.repeat(low, lens)
            at = np.flatnonzero(hit)
            if (near := hit[1:] & hit[:-1]).any():  # overlapping pairs of one symbol: every other one of a run
                head = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1])))
                run = at - head[np.searchsorted(head, at, side="right") - 1]
                at = at[run % 2 == 0]
                del near
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym[at] = self.made[rank[at]]
            last = np.zeros(len(sym), bool)
            last[np.cumsum(lens) - 1] = True
            last[at] |= last[at + 1]
            owner = np.repeat(np.arange(len(lens)), lens)[at]
            lens = lens - np.bincount(owner, minlength=len(lens))
            new = np.cumsum(keep) - 1
            sym, rank, last, at = sym[keep], rank[keep], last[keep], new[at]
            first = np.concatenate(([True], last[:-1]))
            redo = np.unique(np.concatenate((at, at[~first[at]] - 1)))
            rank[redo] = NONE
            redo = redo[~last[redo]]
            rank[redo] = self.rank(sym[redo], sym[redo + 1])


def lowered(text: str) -> str:
    """NFC and lower case, character by character (no final sigma)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class TokenCounter:
    def __init__(self, path: str, cache: int = CACHE):
        self.merger, self.known, self.cache = ArrayMerger(path), {}, cache
        self.special = re.compile("|".join(map(re.escape, self.merger.special)) or "(?!)")
        self.find = word_level()

    def pieces(self, text: str) -> tuple[list[str], int]:
        if "<" not in text:
            return self.find(lowered(text)), 0
        parts = self.special.split(text)
        return [w for p in parts for w in self.find(lowered(p))], len(parts) - 1

    def count(self, texts: list[str | None]) -> list[int]:
        cut = [self.pieces(t or "") for t in texts]
        new = set().union(*(p for p, _ in cut)).difference(self.known)
        if new:
            if len(self.known) + len(new) > self.cache:
                self.known = {}
                new = set().union(*(p for p, _ in cut))
            words = list(new)
            self.known.update(zip(words, self.merger.counts(words).tolist()))
        get = self.known.__getitem__
        return [sum(map(get, p)) + extra for p, extra in cut]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens above limit) of every row of docs."""

    @tidy
    def run(batches):
        counter = tool((__name__, tokenizer), lambda: TokenCounter(tokenizer))
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                texts = part.column(1).to_pylist()
                n = pa.array(counter.count(texts), pa.int64())
                size = pa.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], pa.int64())
                over = pa.array([x > limit for x in n.to_pylist()], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), size, n, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
