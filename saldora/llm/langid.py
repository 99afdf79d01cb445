"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over
all its segmentations into pieces, by the forward algorithm; a text's is the product over its words (runs of
letters, lower case, with the vocabulary's word mark before them). The probabilities are fitted by EM: expected
counts of the pieces by forward and backward sums, smoothed towards the mean of all languages.

Fitting takes about SAMPLE documents a language (those of smallest hash), at most LANGUAGES languages, the most
frequent; that bounds what comes to the driver. Prediction reads every whole text.

Defined cases. und with score 0: a null text, one without any letter, or no labelled document to learn from. score is
the posterior probability of the predicted language, all languages equally likely before. Ties go to the smaller
name. A null doc_id is never learned from and not held out. Null lang is not learned from. Characters outside the
vocabulary count as one unknown piece each. Words of over LONG characters are summed one by one, rescaled as they
go. Columns other than doc_id, text and (for learning) lang are not looked at; an empty table gives none back.
"""

from __future__ import annotations

from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldora.llm import common
from saldora.llm.pretokens import Numbers, grown, letters

SAMPLE = 200
LANGUAGES = 1000
ROUNDS = 3
SMOOTH = 100.0
LONG = 48
PART = 8192
SCALE = 16.0
CACHE, FEW = 150_000, 4_000
SLICE = 4 << 20
MARK = "▁"


class Vocabulary:
    """The pieces of a sentencepiece model as a tree of dictionaries, by character; None leads to a piece's number."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        keep = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.names, self.model_ids = [model.id_to_piece(i) for i in keep], keep
        self.scores = [model.get_score(i) for i in keep]
        self.tree: dict = {}
        for k, name in enumerate(self.names):
            node = self.tree
            for c in name:
                node = node.setdefault(c, {})
            node[None] = k
        self.unknown, self.size = len(keep), len(keep) + 1
        self.lens = np.array([*map(len, self.names), 1])

    def edges(self, word: str, out: list[int]) -> None:
        """Appends start, end, piece of every piece in the word, by start; a character that is no piece is one unknown."""
        tree, unknown, add = self.tree, self.unknown, out.extend
        for i, c in enumerate(word):
            if (node := tree.get(c)) is None:
                add((i, i + 1, unknown))
                continue
            add((i, i + 1, node.get(None, unknown)))
            j = i + 1
            for c in word[j:]:
                if (node := node.get(c)) is None:
                    break
                j += 1
                if None in node:
                    add((i, j, node[None]))


class Lattices:
    """The edges of many words, for sums over all of them at once; words of at most LONG characters."""

    def __init__(self, vocab: Vocabulary, words: list[str]):
        marked = [MARK + w for w in words]
        self.n, self.lens = len(words), np.fromiter(map(len, marked), np.int64, len(marked))
        flat: list[int] = []
        upto = []
        for w in marked:
            vocab.edges(w, flat)
            upto.append(len(flat))
        count = np.diff(np.array([0, *upto])) // 3
        self.word = np.repeat(np.arange(self.n, dtype=np.int32), count)
        self.start, self.end, self.piece = np.array(flat, np.int32).reshape(-1, 3).T
        self.width = int(self.lens.max(initial=0)) + 1

    def _sums(self, probs: np.ndarray, to: np.ndarray, of: np.ndarray, steps, out: np.ndarray) -> np.ndarray:
        order = np.argsort(to.astype(np.int16), kind="stable")  # words stay in order
        bounds = np.searchsorted(to[order], np.arange(self.width + 1))
        for e in steps:
            at = order[bounds[e] : bounds[e + 1]]
            if len(at):
                w = self.word[at]
                first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
                out[w[first], e] = np.add.reduceat(out[w, of[at]] * probs[self.piece[at]], first)
        return out

    def forward(self, probs: np.ndarray) -> np.ndarray:
        """probs: pieces x languages, each times SCALE to its length."""
        out = np.zeros((self.n, self.width, probs.shape[1]))
        out[:, 0] = 1
        return self._sums(probs, self.end, self.start, range(1, self.width), out)

    def backward(self, probs: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, self.width, probs.shape[1]))
        out[np.arange(self.n), self.lens] = 1
        return self._sums(probs, self.start, self.end, range(self.width - 2, -1, -1), out)


def scaled(vocab: Vocabulary, probs: np.ndarray) -> np.ndarray:
    return probs * SCALE ** vocab.lens[:, None]


def long_word(vocab: Vocabulary, word: str, probs: np.ndarray) -> np.ndarray:
    """Log probability of one word of any length; probs as for forward()."""
    word = MARK + word
    into: dict[int, list[tuple[int, int]]] = {}
    alpha, shift = {0: np.ones(probs.shape[1])}, np.zeros(probs.shape[1])
    reach = int(vocab.lens.max())
    for i in range(len(word)):
        found: list[int] = []
        vocab.edges(word[i : i + reach], found)
        for a, b, k in zip(found[::3], found[1::3], found[2::3]):
            if a:
                break
            into.setdefault(i + b, []).append((i, k))
        now = sum(alpha[s] * probs[k] for s, k in into.pop(i + 1))
        alpha[i + 1] = now
        alpha.pop(i + 1 - reach, None)
        if i % 16 == 15:
            top = now.copy()
            for s in alpha:
                alpha[s] = alpha[s] / top
            shift += np.log(top)
    return np.log(alpha[len(word)]) + shift - len(word) * np.log(SCALE)


def word_scores(vocab: Vocabulary, words: list[str], probs: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language; probs as for forward()."""
    out = np.empty((len(words), probs.shape[1]))
    short = np.flatnonzero(np.fromiter((len(w) <= LONG for w in words), bool, len(words)))
    if len(short):
        lat = Lattices(vocab, [words[i] for i in short])
        out[short] = np.log(lat.forward(probs)[np.arange(lat.n), lat.lens]) - lat.lens[:, None] * np.log(SCALE)
    for i in np.setdiff1d(np.arange(len(words)), short):
        out[i] = long_word(vocab, words[i], probs)
    return out


def fit(vocab: Vocabulary, counts: dict[str, dict[str, int]], rounds: int = ROUNDS, smooth: float = SMOOTH) -> tuple[list[str], np.ndarray]:
    """Languages by name, and pieces x languages probabilities, from word counts by language."""
    names = sorted(counts)
    words = sorted({w for c in counts.values() for w in c if len(w) <= LONG}, key=lambda w: (len(w), w))
    if not words:
        return [], np.empty((vocab.size, 0))
    parts = [(words[k : k + PART]) for k in range(0, len(words), PART)]  # words of one length together: narrow tables
    parts = [(Lattices(vocab, p), np.array([[counts[n].get(w, 0) for n in names] for w in p], np.float32)) for p in parts]
    probs = np.full((vocab.size, len(names)), 1 / vocab.size)
    for _ in range(rounds):
        p, got = scaled(vocab, probs), np.zeros((vocab.size, len(names)))
        for lat, weight in parts:
            a, b = lat.forward(p), lat.backward(p)
            share = weight / a[np.arange(lat.n), lat.lens]
            expected = a[lat.word, lat.start] * p[lat.piece] * b[lat.word, lat.end] * share[lat.word]
            for k in range(len(names)):
                got[:, k] += np.bincount(lat.piece, expected[:, k], vocab.size)
        mean = got / got.sum(0)
        mean = (mean.mean(1) + 1e-6) / (1 + 1e-6 * vocab.size)
        probs = (got + smooth * mean[:, None]) / (got.sum(0) + smooth)
    return names, probs


class Predictor:
    def __init__(self, vocab: Vocabulary, names: list[str], probs: np.ndarray, cache: int = CACHE):
        self.vocab, self.names, self.find = vocab, names, letters()
        self.probs = scaled(vocab, probs) if names else probs
        self.scores = np.zeros((1 << 12, len(self.names)), np.float32)
        self.numbers = Numbers(self._learn, self._keep, cache)

    def _keep(self, kept: np.ndarray) -> None:
        self.scores = self.scores[kept]

    def _learn(self, words: list[str], n: int) -> None:
        self.scores = grown(self.scores, n + len(words))
        for k in range(0, len(words), FEW):
            some = words[k : k + FEW]
            self.scores[n + k : n + k + len(some)] = word_scores(self.vocab, some, self.probs)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.names:
            return ["und"] * len(texts), [0.0] * len(texts)
        at, n = self.numbers.of([self.find(t.lower()) if t else [] for t in texts])
        some = np.flatnonzero(n)
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if len(some):
            total = np.add.reduceat(self.scores[at].astype(float), np.cumsum(n[some]) - n[some])
            best = total.argmax(1)
            sure = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            for i, b, s in zip(some.tolist(), best.tolist(), sure.tolist()):
                langs[i], scores[i] = self.names[b], s
        return langs, scores


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, vocab_path: str, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Fits on the labelled documents of docs that are not held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return [], np.empty((0, 0))
    span = 1 << 30
    below = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(int(span * min(1.0, sample / r["count"])))) for r in sizes], F.lit(-1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < below)

    @common.tidy
    def words(batches):
        find = letters()
        for batch in batches:
            rows = [(lang, w[i : i + LONG]) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in find((text or "").lower()) for i in range(0, len(w), LONG)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["lang", "word"])

    table = chosen.select("lang", "text").mapInArrow(words, "lang string, word string").groupBy("lang", "word").count().toArrow()
    counts: dict[str, dict[str, int]] = {}
    for lang, word, n in zip(*(table.column(c).to_pylist() for c in ("lang", "word", "count"))):
        counts.setdefault(lang, {})[word] = n
    return fit(Vocabulary(vocab_path), counts)


def predictor(spark: SparkSession, model: tuple[list[str], np.ndarray], vocab_path: str):
    """A function that gives a task the Predictor of its worker."""
    shared, name = spark.sparkContext.broadcast(model), uuid4().hex  # pieces x languages, whatever the corpus
    return lambda: common.tool((__name__, name), lambda: Predictor(Vocabulary(vocab_path), *shared.value))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], vocab_path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs."""
    tool_of = predictor(docs.sparkSession, model, vocab_path)

    @common.tidy
    def run(batches):
        tool = tool_of()
        for batch in batches:
            for part in common.by_bytes(batch, 2, SLICE):
                langs, scores = tool.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, vocab_path: str) -> DataFrame:
    return predict(docs, learn(docs, vocab_path), vocab_path)


def known_language(docs: DataFrame, vocab_path: str, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is known with a score of at least `least`, columns unchanged; one scan, no shuffle."""
    tool_of = predictor(docs.sparkSession, learn(docs, vocab_path), vocab_path)
    at = docs.columns.index("text")

    @common.tidy
    def run(batches):
        tool = tool_of()
        for batch in batches:
            for part in common.by_bytes(batch, at, SLICE):
                langs, scores = tool.predict(part.column(at).to_pylist())
                yield part.filter(pa.array([x != "und" and s >= least for x, s in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
