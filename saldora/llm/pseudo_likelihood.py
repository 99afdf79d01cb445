"""Language-model scores by masked pseudo-likelihood.

A window network predicts every token of a text from SIDE tokens on each side (the token itself is masked): the
neighbours' vectors, one table a position, are summed, go through tanh, and give a softmax over GROUPS groups of units
and one over the units of the token's group. The units are the words of a vocabulary, the most frequent ones in order,
and, in the last group, ENDINGS classes of all other words by their last two characters. A word outside the vocabulary
has, besides its class's log-probability in this context, that within its class, from counts of the corpus without the
document itself: log((n - own + UNSEEN) / (n of all words of the class + 1)). A document's score is the sum over all its
tokens, so it says how well the rest of the corpus predicts the document.

Counts: every word of every document, summed in each task before the shuffle, kept in a table. Every task knows the
COMMON most frequent words; the counts of all others are joined from the table by word. The network is trained in numpy
on all documents (SHARE is 1; a larger one takes one in so many, by a hash of their tokens): from a start on about START
documents it goes on over each shard of about SHARD tokens, and the shards' networks are averaged
by their tokens, in tasks of at most FAN networks until one is left. Only that one (2 MB) comes to the driver.

Defined cases. A null or empty text, or one without any token, has n_tokens 0, score 0 and a null mean. A token beyond
an end of the text is a unit of its own. A word that the counts do not have, with a model of other documents, has a count
of 0; with such a model nothing is taken off for the document itself. Equal counts are ordered by word. Repeated rows are
scored alike; an empty table gives an empty result. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import copy
import functools
import re
import sys
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldora.llm.common import by_bytes, new_path, stash, tidy
from saldora.llm.jaccard import Powers

SIDE, HIDDEN = 2, 16
GROUPS, ENDINGS = 64, 64
VOCABULARY = (GROUPS - 1) * ENDINGS
UNITS = GROUPS * ENDINGS
COMMON = 100_000
SPLIT, RANGE = 4096, 1 << 20
UNSEEN = 1e-3
SHARE, START, SHARD, FAN = 1, 400, 1 << 22, 64
EPOCHS, BATCH, RATE = 2, 4096, 0.1
CACHE = 300_000
SLICE, SCORED = 1 << 21, 1 << 18
PART, LONG = 1 << 16, 64
STEP = 8192
tokens = re.compile(r"\w+|[^\w\s]").findall


@functools.lru_cache(CACHE)
def class_of(end: str) -> int:
    return VOCABULARY + zlib.crc32(end.encode("utf-8", "surrogatepass")) % ENDINGS


def ending(word: str) -> int:
    return class_of(word[-2:])


def by_group(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """An order of units by group, the units in it, and (group, begin, end) of every group that is there."""
    order = np.argsort((units // ENDINGS).astype(np.uint8), kind="stable")
    y = units[order]
    bounds = np.searchsorted(y // ENDINGS, np.arange(GROUPS + 1)).tolist()
    return order, y, [(g, a, b) for g, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]


class Network:
    """Units from the units around them; unit number UNITS stands beyond the ends."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        normal = lambda *shape: (r.standard_normal(shape) * 0.1).astype(np.float32)
        self.e = normal(2 * SIDE, UNITS + 1, HIDDEN)
        self.top, self.low = np.zeros((HIDDEN + 1, GROUPS), np.float32), np.zeros((GROUPS, HIDDEN + 1, ENDINGS), np.float32)
        self.w[...] = normal(HIDDEN, GROUPS)
        self.u[...] = normal(GROUPS, HIDDEN, ENDINGS)
        self.seen = [np.full_like(x, 1e-6) for x in self.parts]

    @property
    def parts(self) -> tuple[np.ndarray, ...]:
        return self.e, self.top, self.low

    # the last row of top and low are the biases: hidden() ends in 1
    w = property(lambda self: self.top[:HIDDEN])
    b = property(lambda self: self.top[HIDDEN])
    u = property(lambda self: self.low[:, :HIDDEN])
    c = property(lambda self: self.low[:, HIDDEN])

    def to_bytes(self) -> bytes:
        return b"".join(x.tobytes() for x in self.parts)

    @classmethod
    def from_values(cls, values: np.ndarray) -> Network:
        out, at = cls(), 0
        for x in out.parts:
            x[...] = values[at : at + x.size].reshape(x.shape)
            at += x.size
        return out

    @staticmethod
    def around(units: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The units at -SIDE..-1 and 1..SIDE of every token; units of many texts in a row."""
        pad = np.full(len(units) + SIDE * (len(lens) + 1), UNITS, np.int32)
        place = np.arange(len(units)) + SIDE * (1 + np.repeat(np.arange(len(lens)), lens))
        pad[place] = units
        return np.stack([pad[place + k] for k in range(-SIDE, SIDE + 1) if k])

    def hidden(self, near: np.ndarray) -> np.ndarray:
        total = self.e[0].take(near[0], 0)
        for k in range(1, 2 * SIDE):
            total += self.e[k].take(near[k], 0)
        out = np.ones((len(total), HIDDEN + 1), np.float32)
        np.tanh(total, out=out[:, :HIDDEN])
        return out

    def logits(self, h: np.ndarray, groups: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """What goes into the softmax over the groups and into that over the units of the row's group; rows by group."""
        low = np.empty((len(h), ENDINGS), np.float32)
        for g, a, b in groups:
            np.matmul(h[a:b], self.low[g], out=low[a:b])
        return h @ self.top, low

    def log_probs(self, units: np.ndarray, near: np.ndarray) -> np.ndarray:
        out = np.empty(len(units), np.float32)
        for k in range(0, len(units), STEP):
            order, y, groups = by_group(units[k : k + STEP])
            top, low = self.logits(self.hidden(near[:, k : k + STEP].take(order, 1)), groups)
            out[k : k + STEP][order] = chosen(top, y // ENDINGS) + chosen(low, y % ENDINGS)
        return out

    def train(self, units: np.ndarray, lens: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> None:
        """Adagrad on all tokens; goes on from earlier calls."""
        rows, r = np.empty((len(units), 2 * SIDE + 1), np.uint16), np.random.default_rng(seed)
        rows[:, :-1], rows[:, -1] = self.around(units, lens).T, units
        for _ in range(epochs):
            order = r.permutation(len(units))
            for k in range(0, len(units), BATCH):
                self._step(rows.take(order[k : k + BATCH], 0))

    def _step(self, rows: np.ndarray) -> None:
        """rows: the units around each token and its own."""
        order, y, groups = by_group(rows[:, -1])
        near = rows[:, :-1].T.astype(np.intp).take(order, 1)
        h = self.hidden(near)
        p, q = self.logits(h, groups)
        errors(p, y // ENDINGS)
        errors(q, y % ENDINGS)
        back, low = np.empty((len(y), HIDDEN), np.float32), np.zeros_like(self.low)
        for g, a, b in groups:
            np.matmul(q[a:b], self.u[g].T, out=back[a:b])
            np.matmul(h[a:b].T, q[a:b], out=low[g])
        back += p @ self.w.T
        back *= 1 - h[:, :HIDDEN] ** 2
        for k in range(2 * SIDE):
            at, gradient = sums(near[k], back)
            part, seen = self.e[k].take(at, 0), self.seen[0][k].take(at, 0)
            adagrad(part, seen, gradient)
            self.e[k][at], self.seen[0][k][at] = part, seen
        adagrad(self.top, self.seen[1], h.T @ p)
        adagrad(self.low, self.seen[2], low)


def adagrad(part: np.ndarray, seen: np.ndarray, gradient: np.ndarray) -> None:
    """A step, in place; overwrites gradient."""
    seen += gradient * gradient
    gradient *= RATE
    gradient /= np.sqrt(seen)
    part -= gradient


def sums(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys, once each, and the sum of each one's rows, added as complex numbers: half as many, twice as fast."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    keys = keys.take(order)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(rows.take(order, 0).view(np.complex64), first).view(np.float32)


def bounded(z: np.ndarray) -> None:
    """Takes from each row its largest value, if an exponential could overflow or a row of them vanish otherwise."""
    if z.max() > 60 or z.min() < -60:
        z -= z.max(1, keepdims=True)


def chosen(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The log-probability of each row's choice under a softmax of z, which is overwritten."""
    bounded(z)
    hit = z[np.arange(len(z)), y]
    np.exp(z, out=z)
    return hit - np.log(z @ np.ones(z.shape[1], z.dtype))


def errors(z: np.ndarray, y: np.ndarray) -> None:
    """Turns z into the gradient of its softmax, a mean over the rows."""
    bounded(z)
    np.exp(z, out=z)
    z /= (z @ np.full(z.shape[1], len(z), z.dtype))[:, None]
    z[np.arange(len(z)), y] -= z.dtype.type(1 / len(z))


@functools.cache
def kinds() -> np.ndarray:
    """Of every code point, as the pattern of `tokens` has it: 0 white space, 1 part of a word, 2 a sign of its own."""
    out, every = np.zeros(sys.maxunicode + 1, np.uint8), "".join(map(chr, range(sys.maxunicode + 1)))
    for kind, runs in ((1, r"\w+"), (2, r"[^\w\s]+")):
        for m in re.finditer(runs, every):
            out[m.start() : m.end()] = kind
    return out


def cut(text: str):
    """(begin, end) of parts of about PART characters, cut behind a line's end or a blank."""
    at = 0
    while at < len(text):
        end = at + PART
        if end < len(text):
            back = max(text.rfind("\n", at, end), text.rfind(" ", at, end))
            ahead = [k for k in (text.find("\n", end), text.find(" ", end)) if k >= 0] if back < 0 else [back]
            end = min(ahead) + 1 if ahead else len(text)
        yield at, (end := min(end, len(text)))
        at = end


def places(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """What `tokens` finds in the texts in lower case: how many in each, which word every token is, the words, once each,
    and how often they are there. Words of up to LONG characters are told apart by 63 bits of a hash in their slice."""
    lower = [t.lower() if t else "" for t in texts]
    joined, kind_of, long = "\n".join(lower), kinds(), {}
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))]
    for at, end in cut(joined):
        codes = np.frombuffer(joined[at:end].encode("utf-32-le", "surrogatepass"), np.uint32)
        Powers.upto(len(codes) + 1)
        kind = np.concatenate(([0], kind_of.take(codes), [0])).astype(np.uint8)
        word, sign = kind == 1, (kind == 2)[1:-1]
        a = np.flatnonzero(sign | (word[1:-1] & ~word[:-2]))
        b = np.flatnonzero(sign | (word[1:-1] & ~word[2:])) + 1
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * Powers.up[: len(codes)], out=sums[1:])
        key = (sums.take(b) - sums.take(a)) * Powers.down.take(a) | np.uint64(1 << 63)
        for i in np.flatnonzero(b - a > LONG).tolist():
            key[i] = long.setdefault(joined[at + a[i] : at + b[i]], len(long))
        found.append((a + at, b + at, key))
    begin, end, key = (np.concatenate(x) for x in zip(*found))
    lens = np.diff(np.searchsorted(begin, np.concatenate(([0], np.cumsum([len(t) + 1 for t in lower])))))
    order = np.argsort(key)
    key = key.take(order)
    new = np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))
    at = np.empty(len(key), np.int64)
    at[order] = np.cumsum(new) - 1
    first = order[new]
    words = [joined[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist())]
    return lens, at, words, np.diff(np.append(np.flatnonzero(new), len(key)))


class Words:
    """The unit of a word, and what the task knows of its count."""

    def __init__(self, top: list[tuple[str, int]], mass: dict[int, int], table: str):
        """top: the most frequent words with counts; mass: by class, the count of its words; table: the path of the
        counts of the words outside top."""
        self.own, self.table = {w: k for k, (w, _) in enumerate(top[:VOCABULARY])}, table
        self.counts = dict(top[VOCABULARY:])
        self.mass = {c: float(np.log(mass.get(c, 0) + 1)) for c in range(VOCABULARY, UNITS)}

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units and counts; for words of the vocabulary the count is infinite, for words outside top not a number."""
        units, counts = np.fromiter(map(self.own.get, words, repeat(-1)), np.int64, len(words)), np.full(len(words), np.inf)
        other = np.flatnonzero(units < 0)
        rest = [words[i] for i in other.tolist()]
        units[other] = [class_of(w[-2:]) for w in rest]
        counts[other] = np.fromiter(map(self.counts.get, rest, repeat(np.nan)), float, len(rest))
        return units, counts


def units_of(texts: list[str | None], words: Words, own: bool = True):
    """Tokens of each text; the units of all tokens; the sum over common words outside the vocabulary of each text;
    and by text, all other words, once each, with how often the text has them: how many, which, how often."""
    lens, at, list_, _ = places(texts)
    of_word, counts = words.of(list_)
    units, mass = of_word.take(at), np.array([words.mass[c] for c in range(VOCABULARY, UNITS)])
    some = np.flatnonzero(units >= VOCABULARY)
    doc = np.repeat(np.arange(len(lens)), lens)
    pairs, times = np.unique(doc.take(some) * len(list_) + at.take(some), return_counts=True)
    doc, word = np.divmod(pairs, max(1, len(list_)))
    rare = np.isnan(counts[word])
    known, k = word[~rare], times[~rare]
    each = k * (np.log(np.maximum(counts[known] - k * own, 0) + UNSEEN) - mass[of_word[known] - VOCABULARY])
    inside = np.bincount(doc[~rare], each, len(lens))
    return lens, units, inside, np.bincount(doc[rare], minlength=len(lens)), [list_[i] for i in word[rare].tolist()], times[rare]


def unit_scores(network: Network, units: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The sum of the units' log-probabilities of each text; no sum runs over the end of a text."""
    units, out, some = units.astype(np.int32), np.zeros(len(lens)), np.flatnonzero(lens)
    if len(some):
        out[some] = np.add.reduceat(network.log_probs(units, network.around(units, lens)).astype(float), (np.cumsum(lens) - lens)[some])
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all documents."""

    def rows(held: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    @tidy
    def run(batches):
        held: dict[str, int] = {}
        for batch in batches:
            for part in by_bytes(batch, 0, SLICE):
                _, _, words, times = places(part.column(0).to_pylist())
                for w, k in zip(words, times.tolist()):
                    held[w] = held.get(w, 0) + k
                if len(held) > CACHE:
                    yield rows(held)
                    held.clear()
        yield rows(held)

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int):
    """Whether a row of counts is one of the `most` most frequent words, equal counts in the order of the words.

    The count at which the words run out is found from histograms, as the budgets of op1 are: by powers of two, the range
    in which it lies in SPLIT parts again and again until it is one count. Where not all words of that count have room,
    they are dealt to ranges of words; only the range in which the room ends is sorted. What comes to the driver is a
    histogram of at most SPLIT rows, or a word."""
    low, high, room, first = 1, 1 << 62, most, True
    while first or high - low > 1:
        width = max(1, (high - low) // SPLIT)
        bucket = (F.length(F.bin("n")) - 1).cast("long") if first else F.expr(f"(n - {low}) div {width}L")
        hist = counts.where(F.col("n").between(low, high - 1)).groupBy(bucket.alias("b")).count().collect()
        edge = None
        for b, k in sorted(map(tuple, hist), reverse=True):
            if k > room:
                edge = b
                break
            room -= k
        if edge is None:
            return F.col("n") >= low
        low, high = (1 << edge, 1 << (edge + 1)) if first else (low + edge * width, min(high, low + (edge + 1) * width))
        first = False
    if not room:
        return F.col("n") > low
    equal = counts.where(F.col("n") == low).select("word")
    parts = -(-equal.count() // RANGE)
    dealt = stash(equal.repartitionByRange(parts, "word").withColumn("part", F.spark_partition_id()), "lm-equal")
    for part, k in sorted(map(tuple, dealt.groupBy("part").count().collect())):
        if k >= room:
            last = dealt.where(F.col("part") == part).orderBy("word").limit(room).agg(F.max("word")).first()[0]
            break
        room -= k
    return (F.col("n") > low) | ((F.col("n") == low) & (F.col("word") <= last))


def counted(docs: DataFrame) -> Words:
    counts = stash(word_counts(docs), "lm-words")
    common = most_frequent(counts, COMMON)
    found = counts.where(common).collect()  # at most COMMON rows, however many partitions there are
    top = sorted(((r["word"], r["n"]) for r in found), key=lambda x: (-x[1], x[0]))
    known = docs.sparkSession.createDataFrame([(w,) for w, _ in top[:VOCABULARY]], "word string")
    outside = counts.join(F.broadcast(known), "word", "left_anti")
    mass = {r["c"]: r["n"] for r in outside.groupBy(ending_of("word").alias("c")).agg(F.sum("n").alias("n")).collect()}
    words = Words(top, mass, new_path(docs.sparkSession, "lm-rare"))
    counts.where(~common).write.option("compression", "zstd").parquet(words.table)
    return words


def ending_of(word: str):
    return (F.crc32(F.right(word, F.lit(2))) % ENDINGS + VOCABULARY).cast("int")


def read(docs: DataFrame, words: Words, own: bool = True) -> DataFrame:
    """row_no, doc_id, n_tokens, units (two bytes a token), inside (sum over common words), rare (all other words
    outside the vocabulary, once each) and times (how often each stands in the text)."""
    shared = docs.sparkSession.sparkContext.broadcast(words)  # of a size set by the constants above

    @tidy
    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, 2, SLICE):
                lens, units, inside, n, rare, times = units_of(part.column(2).to_pylist(), shared.value, own)
                ends, flat = (2 * np.cumsum(lens)).tolist(), units.astype("<u2").tobytes()
                upto = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
                cells = pa.array([flat[a:b] for a, b in zip([0, *ends], ends)], pa.binary())
                lists = pa.ListArray.from_arrays(upto, pa.array(rare, pa.string())), pa.ListArray.from_arrays(upto, pa.array(times, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lens, pa.int64()), cells, pa.array(inside, pa.float64()), *lists], NAMES)

    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stash(rows.mapInArrow(run, "row_no long, doc_id long, n_tokens long, units binary, inside double, rare array<string>, times array<int>"), "lm-read")


NAMES = ["row_no", "doc_id", "n_tokens", "units", "inside", "rare", "times"]


def flat(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(found), "<u2").astype(np.int32), np.array([len(x) // 2 for x in found])


def trained(rows: DataFrame, share: int = SHARE, start: int = START, shard: int = SHARD) -> Network:
    """The network of all rows of read()."""
    spark, span = rows.sparkSession, 1 << 30
    mark = F.pmod(F.xxhash64("units"), F.lit(span))
    some = rows.where("n_tokens > 0").select(mark.alias("mark"), "units", "n_tokens")
    total = some.agg(F.count("*").alias("k"), F.sum(F.when(F.col("mark") < span // share, F.col("n_tokens"))).alias("t")).first()
    if not total["k"]:
        return Network()

    def learner(begin: Network, epochs: int):
        @tidy
        def run(batches):
            found = sorted(x for batch in batches for x in batch.column(0).to_pylist())
            if found:
                own = copy.deepcopy(begin)
                own.train(*flat(found), epochs=epochs)
                yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, found))], pa.int64()), pa.array([own.to_bytes()], pa.binary())], ["n", "network"])

        return run

    def mean(batches):
        n, total = 0, 0.0
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, total = n + k, total + k * np.frombuffer(data.as_buffer(), np.float32).astype(float)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], ["n", "network"])

    schema = "n long, network binary"
    first = some.where(F.col("mark") <= int(span * min(1.0, start / total["k"]))).select("units").distinct()
    begun = first.repartition(1).mapInArrow(learner(Network(), EPOCHS), schema).first()
    network = Network.from_values(np.frombuffer(bytes(begun["network"]), np.float32)) if begun else Network()
    if not total["t"]:
        return network
    count = -(-total["t"] // shard)
    shared = spark.sparkContext.broadcast(network)
    go_on = lambda batches: learner(shared.value, 1)(batches)
    nets = stash(some.where(F.col("mark") < span // share).select("units").repartition(count).mapInArrow(go_on, schema), "lm-nets")
    while count > 1:
        count = -(-count // FAN)
        nets = stash(nets.repartition(count).mapInArrow(mean, schema), "lm-nets")
    done = nets.first()
    return Network.from_values(np.frombuffer(bytes(done["network"]), np.float32))


def learn(docs: DataFrame) -> tuple[Words, Network]:
    words = counted(docs)
    return words, trained(read(docs, words))


def pseudo_likelihood(docs: DataFrame, model: tuple[Words, Network] | None = None) -> DataFrame:
    """doc_id, n_tokens, score (sum of conditional log-probabilities) and mean of every row of docs; a model given is
    one of other documents."""
    spark, own = docs.sparkSession, model is None
    words = model[0] if model else counted(docs)
    rows = read(docs, words, own)
    shared = spark.sparkContext.broadcast(model[1] if model else trained(rows))

    @tidy
    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, 3, SCORED):
                units, lens = flat(part.column(3).to_pylist())
                score = unit_scores(shared.value, units, lens) + part.column(4).to_numpy()
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(score)], ["row_no", "doc_id", "n_tokens", "part"])

    known = rows.select("row_no", "doc_id", "n_tokens", "units", "inside").mapInArrow(run, "row_no long, doc_id long, n_tokens long, part double")
    table = spark.read.schema("word string, n long").parquet(words.table)
    rare = rows.select("row_no", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row_no", F.col("x.rare").alias("word"), "x.times")
    rare = rare.join(table.hint("shuffle_hash"), "word", "left")
    mass = F.element_at(F.array(*[F.lit(words.mass[c]) for c in range(VOCABULARY, UNITS)]), ending_of("word") - VOCABULARY + 1)
    left = F.greatest(F.coalesce("n", F.lit(0)) - (F.col("times") if own else F.lit(0)), F.lit(0))
    rare = rare.select("row_no", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_tokens"), (F.col("times") * (F.log(left + UNSEEN) - mass)).alias("part"))
    both = known.unionByName(rare).groupBy("row_no").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("part").alias("score"))
    return both.select("doc_id", "n_tokens", "score", F.when(F.col("n_tokens") > 0, F.col("score") / F.col("n_tokens")).alias("mean"))
