"""N-best segmentation into pieces: forward Viterbi scores are exact heuristics for a backward A* search.

The piece lattice of a string has an edge for every vocabulary piece in it, and byte pieces for a character that is
no piece. A forward pass gives the best score of every prefix. The search goes back from the end; a state's value is
its score so far plus the best score of the prefix before it, which is exact, so that segmentations come out best
first and none is expanded in vain. Edges are looked up when a state is expanded, so that only one number a
character is held, however long the string.

Scores are log-probabilities of pieces. A model of unigram kind has its own. One of BPE kind has only ranks: its
pieces get the probabilities of Zipf's law, 1 / (rank + SHIFT) over the sum of these; nothing is trained. The best
segmentation is that of the library for a unigram model with the same pieces and scores, not that of BPE merging.

No piece crosses the start of a run of word marks, nor a character that stands in no longer piece (such as a line
break), nor, if the vocabulary has no such piece, the border between letters and other characters. So a text's
lattice falls into segments there, and its n best are the n best sums over the segments.

Defined cases. A null or empty text has no pieces, score 0 and one empty segmentation. Text is not normalised: a blank
becomes the word mark and the text gets one in front, as the model has it. Decoding gives the text back, except that
a word mark that stood in the text itself becomes a blank (decoded_ok is then false). Equal scores: any order, but
the same in every run. Repeated rows are encoded each; an empty table gives none. Columns other than doc_id and text
are not looked at. Memory: one Arrow batch and at most CACHE segments per worker, in flat arrays.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from saldora.llm import common
from saldora.llm.pretokens import Numbers, grown, runs

N = 3
SHIFT = 100
CACHE, SEARCHED = 200_000, 20_000
SLICE, TEXTS = 256, 4 << 20
MARK = "▁"
#: What a character outside the vocabulary costs below the worst piece.
PENALTY = 10.0


def log_probs(scores: list[float], shift: float = SHIFT) -> list[float]:
    """Zipf's law over the ranks of a BPE model, whose scores are minus the ranks."""
    weights = [1 / (shift - s) for s in scores]
    total = math.fsum(weights)
    return [math.log(w / total) for w in weights]


class NBest:
    def __init__(self, path: str, n: int = N):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        # A node of the tree is [children by character, score, piece or -1].
        self.n, self.tree, self.text, self.bytes, joined = n, {}, {}, {}, set()
        for k in range(model.get_piece_size()):
            if model.is_byte(k):
                self.bytes[int(model.id_to_piece(k)[3:-1], 16)] = k
            elif not (model.is_control(k) or model.is_unknown(k)):
                self.text[k] = model.id_to_piece(k)
        scores = [model.get_score(k) for k in self.text]
        # Ranks are whole numbers; log-probabilities are not.
        if all(s == int(s) for s in scores):
            scores = log_probs(scores)
        self.score = dict(zip(self.text, scores))
        self.piece = {t: (self.score[k], k) for k, t in self.text.items()}
        self.longest = max(map(len, self.piece), default=1)
        self.unknown = min(scores, default=0.0) - PENALTY  # a character's bytes together, below every piece
        for name, (score, _) in self.piece.items():
            at = self.tree
            for c in name[:-1]:
                at = at.setdefault(c, [{}, None])[0]
            at.setdefault(name[-1], [{}, None])[1] = score
            if len(name) > 1:
                joined.update(name)
        crossed = any(a.isalpha() != b.isalpha() for t in self.piece for a, b in zip(t, t[1:]) if MARK not in (a, b))
        groups = [joined - {MARK}] if crossed else [{c for c in joined if c.isalpha()}, {c for c in joined if not c.isalpha()} - {MARK}]
        groups = [re.escape("".join(sorted(g))) for g in groups if g]
        between = "|".join(f"[{g}]+" for g in groups)
        self.cut = re.compile(f"{MARK}+(?:{between})?|{between}|[^{''.join(groups)}{MARK}]").findall

    def forward(self, s: str) -> tuple[list[float], list[float], list[int]]:
        """Of each prefix: the best score, the second best, and where the best one's last piece begins."""
        size = len(s)
        best, second, back = [0.0] + [-math.inf] * size, [-math.inf] * (size + 1), [0] * (size + 1)
        tree, unknown, longest = self.tree, self.unknown, self.longest
        for i in range(size):
            first, other, at, j, alone = best[i], second[i], tree, i, False
            for c in s[i : i + longest]:
                node = at.get(c)
                if node is None:
                    break
                j += 1
                at, score = node
                if score is not None:
                    if j == i + 1:
                        alone = True
                    value = first + score
                    if value > best[j]:
                        second[j] = max(best[j], other + score)
                        best[j], back[j] = value, i
                    elif value > second[j]:
                        second[j] = value
            if not alone:
                j, value = i + 1, first + unknown
                if value > best[j]:
                    second[j] = max(best[j], other + unknown)
                    best[j], back[j] = value, i
                elif value > second[j]:
                    second[j] = value
        return best, second, back

    def best(self, s: str) -> tuple[float, float, list[int]]:
        """Score and ids of the best segmentation, which a search without detours gives, and the second best score."""
        best, second, back = self.forward(s)
        at, out = len(s), []
        while at:
            i = back[at]
            edge = self.piece.get(s[i:at])
            out.append([edge[1]] if edge else [self.bytes[b] for b in s[i:at].encode("utf-8", "surrogatepass")])
            at = i
        return best[-1], second[-1], [k for part in reversed(out) for k in part]

    def search(self, s: str) -> list[tuple[float, list[int]]]:
        """Up to n segmentations of s as (score, ids), best first."""
        return [(score, self.ids(s, path)) for score, path in self.paths(s)]

    def paths(self, s: str) -> list[tuple[float, tuple | None]]:
        """Up to n segmentations of s as (score, linked edges), best first.

        As every open state's value is reached by one of its segmentations, states past the n still wanted are
        dropped: they cannot come out."""
        if len(s) == 1:
            score, k = self.piece.get(s, (self.unknown, None))
            return [(score, (0, 1, k, None))]
        best = self.forward(s)[0]
        piece, longest, want, order = self.piece.get, self.longest, self.n, 0
        open_, out, into = [(-best[-1], 0, len(s), 0.0, None)], [], {}
        while open_:
            _, _, at, g, path = open_.pop(0)
            if not at:
                out.append((g, path))
                want -= 1
                if not want:
                    break
                continue
            if at not in into:  # edges into this place, the one of the best prefix first
                found = []
                for i in range(max(0, at - longest), at):
                    if (edge := piece(s[i:at])) is not None:
                        found.append((best[i] + edge[0], i, *edge))
                if not found or found[-1][1] != at - 1:
                    found.append((best[at - 1] + self.unknown, at - 1, self.unknown, None))
                found.sort(key=lambda e: -e[0])
                into[at] = found
            for value, i, score, k in into[at]:
                cost = -(g + value)
                if len(open_) >= want and cost >= open_[-1][0]:
                    break
                order += 1
                bisect.insort(open_, (cost, order, i, g + score, (i, at, k, path)))
                del open_[want:]
        return out

    def ids(self, s: str, path) -> list[int]:
        out = []
        while path:
            i, j, k, path = path
            out += [k] if k is not None else [self.bytes[b] for b in s[i:j].encode("utf-8", "surrogatepass")]
        return out

    @functools.cached_property
    def raw(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes that the pieces stand for, and where those of each begin and how many they are."""
        found = {k: t.replace(MARK, " ").encode() for k, t in self.text.items()} | {k: bytes([b]) for b, k in self.bytes.items()}
        each = [found.get(k, b"") for k in range(max(found) + 1)]
        size = np.fromiter(map(len, each), np.int64, len(each))
        return np.frombuffer(b"".join(each), np.uint8), np.cumsum(size) - size, size

    def decode_bytes(self, ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of many texts' ids, and how many each text has."""
        data, begin, size = self.raw
        ends = np.concatenate(([0], np.cumsum(size[ids])))
        upto = np.cumsum(lens)
        return data[runs(begin[ids], size[ids])], ends[upto] - ends[upto - lens]

    def decode(self, ids: list[int]) -> str:
        """The text of a whole text's ids, without the mark in front."""
        data, _ = self.decode_bytes(np.array(ids, np.int64), np.array([len(ids)]))
        return data.tobytes().decode("utf-8", "replace")[1:]

    def segments(self, text: str | None) -> list[str]:
        return self.cut(MARK + text.replace(" ", MARK)) if text else []


def best_sums(parts: list[list[float]], n: int) -> list[tuple[float, list[int]]]:
    """The n largest sums of one value from each part (sorted falling) with the place taken in each part."""
    base = sum(p[0] for p in parts)
    # Only the n - 1 parts with the smallest loss can leave their first value among the n best.
    near = sorted((p[0] - p[1], k) for k, p in enumerate(parts) if len(p) > 1)[: n - 1]
    options = [(0.0, ())]
    for _, k in near:
        losses = [parts[k][0] - x for x in parts[k]]
        options = sorted((a + loss, took + ((k, i),) if i else took) for a, took in options for i, loss in enumerate(losses))[:n]
    out = []
    for loss, took in options:
        places = [0] * len(parts)
        for k, i in took:
            places[k] = i
        out.append((base - loss, places))
    return out


def apply_edits(ids: list[int], edits) -> list[int]:
    """The ids of a further segmentation: of the best with some slices replaced; edits (at, size, ids) by at."""
    out, done = [], 0
    for e in edits:
        at, size, new = (e["at"], e["size"], e["ids"]) if isinstance(e, dict) else e
        out += list(ids[done:at]) + list(new)
        done = at + size
    return out + list(ids[done:])


class Encoder:
    """Whole texts through a cache of segments, held in flat arrays.

    Only the n - 1 segments of a text whose second best score is nearest to their best can differ from their best in the
    text's n best; the search is for these."""

    def __init__(self, path: str, n: int = N, cache: int = CACHE):
        self.tool, self.n = NBest(path, n), n
        self.flat, self.used = np.zeros(1 << 12, np.int32), 0
        # By segment: where its best ids begin, how many they are, their score, and what the second best loses.
        self.begin, self.size = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int32)
        self.top, self.gap = np.zeros(1 << 10), np.zeros(1 << 10)
        self.found: dict[str, list[tuple[float, list[int]]]] = {}
        self.numbers = Numbers(self._learn, self._keep, cache)

    def _keep(self, kept: np.ndarray) -> None:
        begin, self.size, self.top, self.gap = self.begin[kept], self.size[kept], self.top[kept], self.gap[kept]
        size = self.size.astype(np.int64)
        self.flat, self.used = self.flat[runs(begin, size)], int(size.sum())
        self.begin = np.cumsum(size) - size

    def _learn(self, words: list[str], start: int) -> None:
        end, flat, size, top, gap = start + len(words), [], [], [], []
        for s in words:
            first, second, ids = self.tool.best(s)
            flat += ids
            size.append(len(ids))
            top.append(first)
            gap.append(first - second)
        self.begin, self.size, self.top, self.gap = (grown(x, end) for x in (self.begin, self.size, self.top, self.gap))
        self.size[start:end], self.top[start:end], self.gap[start:end] = size, top, gap
        self.begin[start:end] = np.cumsum(size) - size + self.used
        self.flat = grown(self.flat, self.used + len(flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def searched(self, s: str) -> list[tuple[float, list[int]]]:
        if s not in self.found:
            if len(self.found) >= SEARCHED:
                self.found.clear()
            self.found[s] = self.tool.search(s)
        return self.found[s]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[float]], list[list[list[tuple]]]]:
        """(pieces of each text, all their ids, the n best scores of each, the edits of the further segmentations)."""
        lists = [self.tool.segments(t) for t in texts]
        at, lens = self.numbers.of(lists)
        size = self.size[at].astype(np.int64)
        flat = self.flat[runs(self.begin[at], size)]
        ends = np.cumsum(lens)
        place = np.concatenate(([0], np.cumsum(size)))
        top, gap = self.top[at], self.gap[at]
        scores, edits = [], []
        for words, end in zip(lists, ends.tolist()):
            n = len(words)
            if not n:
                scores.append([0.0])
                edits.append([])
                continue
            start = end - n
            base, some = float(top[start:end].sum()), gap[start:end]
            take = np.argpartition(some, self.n - 1)[: self.n - 1] if n >= self.n > 1 else np.arange(n)
            take = np.sort(take[some[take] < np.inf]).tolist()
            found = [self.searched(words[k]) for k in take]
            sums = best_sums([[score - f[0][0] for score, _ in f] for f in found], self.n) if found else [(0.0, [])]
            scores.append([base + s for s, _ in sums])
            at_ = [(int(place[start + k] - place[start]), int(size[start + k])) for k in take]
            edits.append([[(*at_[k], found[k][r][1]) for k, r in enumerate(ranks) if r] for _, ranks in sums[1:]])
        return place[ends] - place[ends - lens], flat, scores, edits

    def decoded_ok(self, texts: list[str | None], lens: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Whether each text's ids stand for the text."""
        data, size = self.tool.decode_bytes(flat, lens)
        want = [b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        same = np.fromiter(map(len, want), np.int64, len(want)) == size
        if same.all() and data.tobytes() == b"".join(want):
            return same
        ends = np.cumsum(size).tolist()
        return same & np.array([data[e - n : e].tobytes() == w for w, n, e in zip(want, size.tolist(), ends)], bool)


EDIT = pa.struct([("at", pa.int32()), ("size", pa.int32()), ("ids", pa.list_(pa.int32()))])
SCHEMA = "doc_id long, n_pieces long, ids_crc32 long, scores array<double>, decoded_ok boolean, ids array<int>, others array<array<struct<at: int, size: int, ids: array<int>>>>"
NAMES = ["doc_id", "n_pieces", "ids_crc32", "scores", "decoded_ok", "ids", "others"]


def segmented(docs: DataFrame, model: str, n: int = N) -> DataFrame:
    """One row per row of docs: doc_id; n_pieces, ids_crc32 (little-endian 32-bit) and ids of the best segmentation; the
    scores of the n best; others, for each further one the slices of ids that it replaces (see expanded()); and
    decoded_ok, whether ids decode to the text."""

    @common.tidy
    def run(batches):
        tool = common.tool((__name__, model, n), lambda: Encoder(model, n))
        for batch in batches:
            for part in common.by_bytes(batch, 1, TEXTS):
                texts = part.column(1).to_pylist()
                lens, flat, scores, edits = tool.encode(texts)
                ends = np.concatenate(([0], np.cumsum(lens)))
                crc = [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                ok = tool.decoded_ok(texts, lens, flat)
                others = [[[{"at": a, "size": b, "ids": c} for a, b, c in one] for one in row] for row in edits]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(lens, pa.int64()), pa.array(crc, pa.int64()), pa.array(scores, pa.list_(pa.float64())), pa.array(ok),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array(others, pa.list_(pa.list_(EDIT)))], NAMES)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, SCHEMA)


def expanded(found: DataFrame) -> DataFrame:
    """doc_id, rank (from 1), score, ids: one row for each segmentation that segmented() gives."""

    @common.tidy
    def run(batches):
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(4)]
            for doc, scores, ids, others in zip(*cols):
                lists = [ids, *(apply_edits(ids, e) for e in others)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([doc] * len(lists), pa.int64()), pa.array(range(1, len(lists) + 1), pa.int32()), pa.array(scores, pa.float64()), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "rank", "score", "ids"])

    return found.select("doc_id", "scores", "ids", "others").mapInArrow(run, "doc_id long, rank int, score double, ids array<int>")


def decoded(found: DataFrame, model: str) -> DataFrame:
    """doc_id, text of rows with doc_id and ids; null ids give a null text, bytes that are no UTF-8 the sign for that."""

    @common.tidy
    def run(batches):
        tool = common.tool((__name__, model), lambda: NBest(model))
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                lists = part.column(1).to_pylist()
                lens = np.array([len(x or ()) for x in lists], np.int64)
                flat = np.array([i for x in lists for i in x or ()], np.int64)
                data, size = tool.decode_bytes(flat, lens)
                ends = np.cumsum(size).tolist()
                texts = [None if x is None else data[e - m : e].tobytes().decode("utf-8", "replace")[1:] for x, m, e in zip(lists, size.tolist(), ends)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return found.selectExpr("cast(doc_id as long) as doc_id", "ids").mapInArrow(run, "doc_id long, text string")
