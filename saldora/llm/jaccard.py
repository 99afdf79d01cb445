"""N-gram Jaccard self-join of documents with set-relation skipping.

A document's set is its distinct shingles, each a 64-bit hash (a fixed function of the words). Two documents link when
100 * |A & B| >= 75 * |A | B|. The join is exact up to equal hashes of different shingles: nothing is sampled and no
list is capped. It returns each document's component and its number of links, without pairs inside a component.

1. One scan takes each set's size, identity (two 64-bit sums) and HASHES minima, and a table of 2**SKETCH counts of
   shingles by hash, of fixed size, which orders shingles from rare to frequent.
2. Equal sets are one class from here on.
3. Highly similar sets: a class is compared with the smallest class of the buckets (equal minimum) it is in. If they
   link, both are in one component, and no pair within it is a candidate again.
4. Index lists: by the prefix principle two linked sets share a shingle among the rarest n - ceil(0.75 n) + 1 of each.
   Lists of one component are skipped as a whole. In the others the entries, ordered by position, are cut into
   blocks, and a pair of blocks is skipped if its positions and sizes (what the sets can share from the shared
   shingle on) cannot reach the overlap needed. Of the pairs left, all between different components,
   those are compared in full whose counts of shingles by ranges of their hash leave room for the overlap.
5. All links of a component follow from one set's answers: every other set is compared with the component's head R
   once, which leaves its difference D (shingles of one of the two only; d of them in R, i not in R). Then
   |A & B| = |R| - d(A) - d(B) + |D(A) & D(B)|, so that A and B link exactly if
       175 |D(A) & D(B)| >= cost(A) + cost(B) - 25 |R|     with cost = 100 d + 75 i.
   Sets in order of cost: partners up to 25 |R| - cost(A) are counted at once; for the others the shared part of the
   differences is counted through lists of their elements. Only counts leave a task. A component of over HALF classes
   is dealt in pairs of parts.

Sets travel once per comparison list, to tasks dealt by list and salt; a list of over LIST sets is split.

Defined cases. Null or empty texts, or texts without words, have an empty set and link with nothing. A text with fewer
words than a shingle has one, the whole sequence. Rows of equal doc_id are one node with all their sets. n_links is the
number of other rows whose sets link with the row's, copies included. Rows of null doc_id are not compared: they get
their own n_shingles and a null component_id and n_links. Repeated rows come out each. An empty table gives an empty
result. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldora.llm.common import drop_ids, fits, join_checked, join_groups, stash, tidy
from saldora.llm.components import connected
from saldora.llm.pretokens import runs

WORDS = 5
NEED, OF = 75, 100
HASHES, AGREE = 8, 3
SKETCH = 20
LIST = 256
CELLS = 512
ENTRIES, FLUSH = 500_000, 400_000
SPREAD, FOUND = 16, 200_000
BLOCK = 64
HALF = 1024
SLICE = 256
PART = 1 << 20


def _randoms(seed: int, n: int) -> np.ndarray:
    """n fixed odd 64-bit numbers (splitmix)."""
    x = np.arange(seed + 1, seed + n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(x) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LETTER = _randoms(1000, 256)
LETTER[65:91] = LETTER[97:123]  # A-Z count as a-z
PLACE = _randoms(2000, WORDS)
FACTOR = _randoms(3000, HASHES)


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were needed so far."""

    base = int(_randoms(4000, 1)[0])
    up = down = np.empty(0, np.uint64)

    @classmethod
    def upto(cls, n: int) -> None:
        if len(cls.up) < n:
            n = max(n, PART + 1)
            inverse = pow(cls.base, -1, 1 << 64)
            for name, x in (("up", cls.base), ("down", inverse)):
                steps = np.full(n, x, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in bytes of UTF-8, in parts cut at white space."""
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + PART)
        if end < len(data):
            space = np.flatnonzero(SPACES[data[at:end]])
            if len(space):
                end = at + int(space[-1]) + 1
            else:  # a word of more than a part
                rest = SPACES[data[end:]].argmax()
                end = end + int(rest) + 1 if SPACES[data[end + rest]] else len(data)
        part = data[at:end]
        Powers.upto(len(part) + 1)
        inside = ~SPACES[part]
        edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(LETTER[part] * Powers.up[: len(part)])))
        starts.append(a + at)
        hashes.append(mixed((sums[b] - sums[a]) * Powers.down[a]))
        at = end
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.empty(0, np.int64), np.empty(0, np.uint64))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
    starts, hashes = word_hashes(np.frombuffer(b"".join(raw), np.uint8))
    bounds = np.concatenate(([0], np.searchsorted(starts, ends)))
    n = max(0, len(hashes) - words + 1)
    grams = mixed(sum((hashes[k : k + n] * PLACE[k] for k in range(words)), np.zeros(n, np.uint64)))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            out.append(mixed(np.array([(hashes[a:b] * PLACE[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def sliced(batches, column: int):
    """(rows, their sets) of Arrow batches, SLICE texts at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            part = batch.slice(k, SLICE)
            yield part, shingle_sets(part.column(column).to_pylist())


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, np.uint64).view(np.int64))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n, a, b (identity of the set), minima, cells (shingles by CELLS ranges of their hash, at most 255
    each); and rows with counts (a part of the sketch) only."""

    @tidy
    def run(batches):
        names = ["doc_id", "n", "a", "b", "minima", "cells", "counts"]
        counts = np.zeros(1 << SKETCH, np.uint32)
        for part, sets in sliced(batches, 1):
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            flat = np.concatenate(sets)
            counts += np.bincount((flat >> np.uint64(64 - SKETCH)).astype(np.int64), minlength=1 << SKETCH).astype(np.uint32)
            some = np.flatnonzero(n)
            at = (np.cumsum(n) - n)[some]
            rows = np.zeros((2 + HASHES, len(sets)), np.uint64)
            if len(some):
                rows[0, some] = np.add.reduceat(mixed(flat), at)
                rows[1, some] = np.add.reduceat(mixed(flat ^ PLACE[0]), at)
                for k in range(HASHES):
                    rows[2 + k, some] = np.minimum.reduceat(flat * FACTOR[k], at)
            minima = pa.ListArray.from_arrays(pa.array(np.arange(0, HASHES * len(sets) + 1, HASHES), pa.int32()), signed(rows[2:].T.ravel()))
            at = np.repeat(np.arange(len(sets)), n) * CELLS + (flat % np.uint64(CELLS)).astype(np.int64)
            cells = np.minimum(np.bincount(at, minlength=len(sets) * CELLS), 255).astype(np.uint8).reshape(-1, CELLS)
            cells = pa.array([x.tobytes() for x in cells], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), signed(rows[0]), signed(rows[1]), minima, cells, pa.nulls(len(sets), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 4 + [pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], names)

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    return stash(rows.mapInArrow(run, "doc_id long, n long, a long, b long, minima array<long>, cells binary, counts binary"), "jaccard-sets")


def frequencies(rows: DataFrame) -> np.ndarray:
    """The sketch of all rows: 2**SKETCH counts, whatever the input."""

    @tidy
    def add(batches):
        total = np.zeros(1 << SKETCH, np.uint64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), np.uint32)
        total = np.minimum(total, np.uint64(2**32 - 1)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    parts = rows.where("counts is not null").select("counts").repartition(8).mapInArrow(add, "counts binary")
    return np.frombuffer(parts.repartition(1).mapInArrow(add, "counts binary").first()["counts"], np.uint32)


def compare(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of different doc_ids that link. b's set is sent once to each of its salts, a's once a pair."""
    pairs = stash(pairs.select("a", "b").distinct(), "jaccard-pairs")
    salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / LIST).cast("int").alias("salts"))
    sent = pairs.join(salts, "b").select(F.col("a").alias("id"), "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), F.col("a"))
    heads = salts.select(F.col("b").alias("id"), "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("a"))
    roles = stash(heads.unionByName(sent), "jaccard-roles")
    texts = join_checked(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), roles, F.col("doc_id") == F.col("id")).select("b", "salt", "a", "text")

    @tidy
    def sets(batches):
        for part, found in sliced(batches, 3):
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([x.tobytes() for x in found], pa.binary())], ["b", "salt", "a", "hashes"])

    @tidy
    def links(batches):
        key, heads = None, []
        for batch in batches:
            out_a, out_b = [], []
            for b, salt, a, data in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
                mine = np.frombuffer(data.as_buffer(), np.uint64)
                if (b, salt) != key:
                    key, heads = (b, salt), []
                if a is None:
                    heads.append(mine.copy())
                    continue
                for other in heads:
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    if both and OF * both >= NEED * (len(mine) + len(other) - both):
                        out_a.append(a)
                        out_b.append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    held = texts.mapInArrow(sets, "b long, salt int, a long, hashes binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.repartition(parts, "b", "salt").sortWithinPartitions(F.col("b"), F.col("salt"), F.col("a").asc_nulls_first())
    return stash(dealt.mapInArrow(links, "a long, b long"), "jaccard-links")


def similar(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of a class and the smallest class of the buckets that the two share, if they share AGREE or more."""
    cells = classes.select("id", "n", F.posexplode("minima").alias("k", "value"))
    heads = cells.groupBy("k", "value").agg(F.min(F.struct("id", "n")).alias("head"), F.count("*").alias("n")).where("n > 1")
    found = join_groups(cells.select("id", F.col("n").alias("size"), "k", "value"), heads, ["k", "value"], HASHES * classes.count(), "inner")
    near = (F.col("id") != F.col("head.id")) & (OF * F.least("size", "head.n") >= NEED * F.greatest("size", "head.n"))
    return found.where(near).groupBy(F.col("id").alias("a"), F.col("head.id").alias("b")).count().where(F.col("count") >= AGREE)


def needed(n):
    """The least overlap of a set of n with any set that it links with."""
    return -(-NEED * n // OF)


def mixed_pairs(token, owner, pos, comp, size, ids):
    """Lists of pairs (a, b), a > b, of sets of different components that meet in these lists and are not ruled out
    there; a pair can come twice if there are over FOUND of them.

    token, owner, pos: the entries (pos: place in the set's order); comp, size, ids: by owner. From the first
    shingle they share on, two sets share at most min(size - pos), which must reach the overlap needed. Pairs of blocks of a list whose positions and sizes cannot
    reach it are skipped; so are pairs of entries."""
    order = np.lexsort((pos, token))
    token, owner, pos = token[order], owner[order], pos[order].astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
    out: set[tuple[int, int]] = set()
    if len(cut) < 2:
        return
    c = comp[owner]
    low, high = np.minimum.reduceat(c, cut[:-1]), np.maximum.reduceat(c, cut[:-1])
    for k in np.flatnonzero(low != high).tolist():
        o, p = owner[cut[k] : cut[k + 1]], pos[cut[k] : cut[k + 1]]
        n = size[o].astype(np.int64)
        left = n - p
        blocks = [slice(i, i + BLOCK) for i in range(0, len(o), BLOCK)]
        for y, two in enumerate(blocks):
            for one in blocks[: y + 1]:  # positions of `one` are no larger
                if (OF + NEED) * min(left[one].max(), left[two].max()) < NEED * (n[one].min() + n[two].min()):
                    continue
                after = np.minimum(left[one][:, None], left[two][None, :])
                small, large = np.minimum(n[one][:, None], n[two][None, :]), np.maximum(n[one][:, None], n[two][None, :])
                enough = ((OF + NEED) * after >= NEED * (small + large)) & (OF * small >= NEED * large)
                enough &= comp[o[one]][:, None] != comp[o[two]][None, :]
                for i, j in zip(*np.nonzero(enough)):
                    a, b = int(ids[o[one][i]]), int(ids[o[two][j]])
                    if a != b:
                        out.add((max(a, b), min(a, b)))
                if len(out) >= FOUND:
                    yield sorted(out)
                    out.clear()
    yield sorted(out)


def crossing(docs: DataFrame, labels: DataFrame, counts: np.ndarray, entries: int) -> DataFrame:
    """Pairs (a, b) of different components (labels: id, comp) that the prefix index does not rule out."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(counts)
    parts = max(spark.sparkContext.defaultParallelism, entries // ENTRIES + 1)
    buckets = SPREAD * parts  # several to a task, so that tasks are even

    @tidy
    def prefixes(batches):
        for part, sets in sliced(batches, 1):
            cut = []
            for s in sets:
                order = np.argsort(shared.value[(s >> np.uint64(64 - SKETCH)).astype(np.int64)], kind="stable")
                cut.append(s[order[: len(s) - needed(len(s)) + 1 if len(s) else 0]].tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(cut, pa.binary()), *part.columns[2:]], ["doc_id", "n", "hashes", *part.schema.names[2:]])

    @tidy
    def deal(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                size += len(row[2]) // 8
                if size >= FLUSH or len(held) >= 60_000:
                    yield from flush(held)
                    held, size = [], 0
        yield from flush(held)

    def flush(held):
        if not held:
            return
        lens = np.array([len(r[2]) // 8 for r in held])
        token = np.frombuffer(b"".join(r[2] for r in held), np.uint64)
        owner = np.repeat(np.arange(len(held), dtype=np.int32), lens)
        pos = np.arange(len(token)) - np.repeat(np.cumsum(lens) - lens, lens)
        table = np.array([(r[0], r[3], r[1]) for r in held], np.int64)
        which = ((token >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(which, kind="stable")
        used, first = np.unique(which[order], return_index=True)
        rows = []
        for k, at in zip(used.tolist(), np.split(order, first[1:])):
            there, mine = np.unique(owner[at], return_inverse=True)
            rows.append((k, token[at].tobytes(), mine.astype(np.uint16).tobytes(), pos[at].astype(np.uint32).tobytes(), table[there].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows))], ["bucket", "token", "owner", "pos", "rows"])

    @tidy
    def meet(batches):
        """Bucket by bucket, as the rows come in that order."""
        bucket, rows = None, []
        for batch in batches:
            for k, *data in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
                if k != bucket:
                    yield from met(rows)
                    bucket, rows = k, []
                rows.append([x.as_py() for x in data])
        yield from met(rows)

    def met(rows):
        if rows:
            tables = [np.frombuffer(r[3], np.int64).reshape(-1, 3) for r in rows]
            table, base = np.concatenate(tables), np.cumsum([0, *map(len, tables)])
            token = np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows])
            owner = np.concatenate([np.frombuffer(r[1], np.uint16).astype(np.int32) + np.int32(b) for r, b in zip(rows, base)])
            pos = np.concatenate([np.frombuffer(r[2], np.uint32) for r in rows])
            rows.clear()
            for found in mixed_pairs(token, owner, pos, table[:, 1], table[:, 2], table[:, 0]):
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text").where("doc_id is not null")
    comp, dealt = F.coalesce("comp", "doc_id").alias("comp"), "bucket int, token binary, owner binary, pos binary, rows binary"
    if fits(labels):  # labels come to the scan: one pass, one Python worker a task
        placed = rows.join(F.broadcast(labels), F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", comp)
        dealt = placed.mapInArrow(tidy(lambda batches: deal(prefixes(batches))), dealt)
    else:  # texts do not travel, prefixes do
        index = rows.mapInArrow(prefixes, "doc_id long, n long, hashes binary").where("n > 0")
        index = index.join(labels.hint("merge"), F.col("doc_id") == F.col("id"), "left").select("doc_id", "n", "hashes", comp)
        dealt = index.mapInArrow(deal, dealt)
    dealt = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return stash(dealt.mapInArrow(meet, "a long, b long").distinct(), "jaccard-crossing")


def may_link(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) whose cells (rows: signatures) leave room for the overlap needed: two sets share in a range of
    hashes at most what the one with fewer there has. Drops most pairs that share a passage only, before sets travel."""

    @tidy
    def run(batches):
        for batch in batches:
            a, b, m, n, x, y = batch.columns
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, CELLS) for c in (x, y))
            m, n = m.to_numpy(), n.to_numpy()
            most = np.minimum(x, y).sum(1, dtype=np.int64)
            fine = ((OF + NEED) * most >= NEED * (m + n)) | ((x == 255) & (y == 255)).any(1)
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(fine))

    sets = rows.where("counts is null and doc_id is not null and n > 0")
    side = lambda k, n, c: sets.select(F.col("doc_id").alias(k), F.col("n").alias(n), F.col("cells").alias(c))
    both = pairs.join(side("a", "m", "x"), "a").join(side("b", "n", "y"), "b").select("a", "b", "m", "n", "x", "y")
    return both.mapInArrow(run, "a long, b long").distinct()


def differences(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """comp, key, m, cost, base (25 |R|) and diff (sorted, what is in only one of the set and its component's head) of
    every class. classes: comp, id (a doc_id that has the set), key (the set's identity), m."""
    first = F.struct("id", "key")
    heads = stash(classes.groupBy("comp").agg(F.min(first).alias("head"), F.ceil(F.count("*") / LIST).cast("int").alias("salts")), "jaccard-heads")
    spread = join_checked(classes, heads, "comp")
    salt = F.pmod(F.xxhash64("key"), F.col("salts")).cast("int")
    own = spread.select("id", "key", "comp", salt.alias("salt"), F.lit(1).alias("role"), "m")
    head = heads.select(F.col("head.id").alias("id"), F.col("head.key").alias("key"), "comp", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.lit(0).cast("long").alias("m"))
    roles = stash(own.unionByName(head), "jaccard-roles")
    names = ["comp", "salt", "role", "key", "m"]
    texts = join_checked(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), roles, F.col("doc_id") == F.col("id")).select(*names, "text")

    @tidy
    def sets(batches):
        for part, found in sliced(batches, 5):
            # A doc_id may stand in several rows: only the set that is meant goes on.
            keys = part.column(3).to_numpy()
            there = np.array([len(x) > 0 and int(identity(x)) == k for x, k in zip(found, keys.tolist())], bool)
            yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array([x.tobytes() for x in found], pa.binary())], [*names, "hashes"]).filter(pa.array(there))

    @tidy
    def compared(batches):
        group, head, done = None, None, set()
        for batch in batches:
            rows = []
            for comp, salt, role, key, m, data in zip(*(c.to_pylist() for c in batch.columns[:5]), batch.column(5)):
                mine = np.frombuffer(data.as_buffer(), np.uint64)
                if (comp, salt) != group:
                    group, head, done = (comp, salt), None, set()
                if role == 0:
                    head = mine.copy() if head is None else head
                elif key not in done:  # rows of equal doc_id and text
                    done.add(key)
                    out, into = np.setdiff1d(head, mine, assume_unique=True), np.setdiff1d(mine, head, assume_unique=True)
                    cost = OF * len(out) + NEED * len(into)
                    rows.append((comp, key, m, cost, (OF - NEED) * len(head), np.sort(np.concatenate((out, into))).tobytes()))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 5 else pa.int64()) for k, c in enumerate(cols)], ["comp", "key", "m", "cost", "base", "diff"])

    held = texts.mapInArrow(sets, "comp long, salt int, role int, key long, m long, hashes binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = held.repartition(parts, "comp", "salt").sortWithinPartitions("comp", "salt", "role", "key")
    return stash(dealt.mapInArrow(compared, "comp long, key long, m long, cost long, base long, diff binary"), "jaccard-differences")


def identity(hashes: np.ndarray) -> np.int64:
    return np.add.reduce(mixed(hashes)).view(np.int64)


def links_between(left: list[tuple], right: list[tuple], base: int, same: bool) -> list[int]:
    """For each of left (m, cost, diff), how many rows of right link with it; same: both are one list, a set is no
    partner of itself."""
    cost, m = np.array([r[1] for r in right]), np.array([r[0] for r in right])
    order = np.argsort(cost, kind="stable")
    sorted_cost, below = cost[order], np.concatenate(([0], np.cumsum(m[order])))
    sizes = np.array([len(r[2]) for r in right])
    flat, owner = np.concatenate([r[2] for r in right]), np.repeat(np.arange(len(right)), sizes)
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], owner[by]
    out = []
    for k, (own, mine, diff) in enumerate(left):
        sure = int(np.searchsorted(sorted_cost, base - mine, side="right"))
        total = int(below[sure])
        rest = order[sure:]
        if len(rest) and len(diff):
            a, b = np.searchsorted(flat, diff, side="left"), np.searchsorted(flat, diff, side="right")
            shared = np.bincount(owner[runs(a, b - a)], minlength=len(right))
            total += int(m[rest][(OF + NEED) * shared[rest] >= mine + cost[rest] - base].sum())
        # The set itself: among the sure ones, or found by its whole difference, which always suffices.
        out.append(total - own if same else total)
    return out


def link_counts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """key, links: rows of other sets that link with the set, for the classes of differences()."""
    found = differences(docs, classes)
    sizes = found.groupBy("comp").agg(F.ceil(F.count("*") / HALF).cast("int").alias("parts"))
    mine = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    rows = join_checked(found, sizes, "comp").withColumn("p", mine)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q")).drop("parts")
    rows = rows.select("comp", F.least("p", "q").alias("one"), F.greatest("p", "q").alias("two"), F.col("p").alias("side"), "key", "m", "cost", "base", "diff")

    @tidy
    def run(batches):
        group, sides = None, {}
        for batch in batches:
            for comp, one, two, side, key, m, cost, base, diff in zip(*(c.to_pylist() for c in batch.columns[:8]), batch.column(8)):
                if (comp, one, two) != group:
                    yield from counted(group, sides)
                    group, sides = (comp, one, two), {}
                sides.setdefault(side, []).append((key, base, (m, cost, np.frombuffer(diff.as_buffer(), np.uint64).copy())))
        yield from counted(group, sides)

    def counted(group, sides):
        if group is None or (group[1] != group[2] and len(sides) < 2):
            return
        keys, links, same = [], [], group[1] == group[2]
        for side, mine in sides.items():
            other = mine if same else sides[sum(sides) - side]
            keys += [r[0] for r in mine]
            links += links_between([r[2] for r in mine], [r[2] for r in other], mine[0][1], same)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(links, pa.int64())], ["key", "links"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "comp", "one", "two").sortWithinPartitions("comp", "one", "two", "side", "key")
    return dealt.mapInArrow(run, "key long, links long").groupBy("key").agg(F.sum("links").alias("links"))


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows of signatures(); classes of equal sets: n, a, b, id, m; and id, comp of every node with a link."""
    rows = signatures(docs)
    counts = frequencies(rows)
    sets = rows.where("counts is null and doc_id is not null and n > 0")
    total = sets.count()
    key = ["n", "a", "b"]
    classes = stash(sets.groupBy(*key).agg(F.min("doc_id").alias("id"), F.count("*").alias("m")), "jaccard-classes")
    members = join_groups(sets.select("doc_id", "minima", *[F.col(k).alias(f"k{k}") for k in key]), classes.select(F.col("m").alias("n"), "id", *[F.col(k).alias(f"k{k}") for k in key]), [f"k{k}" for k in key], total)
    members = stash(members.select("doc_id", "id", F.col("kn").alias("n"), "minima"), "jaccard-members")
    firsts = members.where("doc_id = id").select("id", "n", "minima").distinct()
    same = members.select(F.col("doc_id").alias("a"), F.col("id").alias("b")).where("a <> b")
    copies = same.select(F.col("a").alias("__id")).distinct()

    near = compare(docs, similar(firsts))
    labels = connected(near.select("a", "b").unionByName(same))
    labels = stash(labels.select(F.col("node").alias("id"), F.col("root").alias("comp")), "jaccard-labels")
    # Copies need no entries in the index: their class has them.
    alone = members.groupBy("doc_id").agg(F.count_distinct("id").alias("k")).where("k > 1").limit(1).count() == 0
    indexed = join_checked(docs, copies, docs["doc_id"] == copies["__id"], "left_anti") if alone and fits(copies) else docs
    entries = sets.agg(F.sum(F.expr(f"n - ceil({NEED} * n / {OF}) + 1"))).first()[0] or 0
    links = compare(docs, may_link(crossing(indexed, labels, counts, int(entries)), rows))
    over = join_checked(join_checked(links, labels.select(F.col("id").alias("a"), F.col("comp").alias("x")), "a", "left"), labels.select(F.col("id").alias("b"), F.col("comp").alias("y")), "b", "left")
    joined = connected(over.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    # A single document that the index linked is a root of its own in `joined`.
    tops = joined.select(F.col("node").alias("top"), "root")
    below = labels.join(tops, labels["comp"] == tops["top"], "left").select("id", F.coalesce("root", "comp").alias("comp"))
    single = tops.join(labels, tops["top"] == labels["id"], "left_anti").select(F.col("top").alias("id"), F.col("root").alias("comp"))
    return rows, classes, stash(below.unionByName(single), "jaccard-final")


def components(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    rows, _, final = grouped(docs.select("doc_id", "text"))
    out = rows.where("counts is null").select("doc_id", F.col("n").alias("n_shingles"))
    out = join_checked(out, final, F.col("doc_id") == F.col("id"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach), n_links."""
    docs = docs.select("doc_id", "text")
    rows, classes, final = grouped(docs)
    # Classes of components with more than one: the only ones that have links besides their copies.
    placed = classes.select(F.col("id").alias("doc"), F.col("a").alias("key"), "m").join(final, F.col("doc") == F.col("id")).select("comp", "id", "key", "m")
    several = placed.groupBy("comp").agg(F.count("*").alias("k")).where("k > 1").select("comp")
    counts = stash(link_counts(docs, stash(join_checked(placed, several, "comp", "left_semi"), "jaccard-placed")), "jaccard-counts")
    key = ["n_shingles", "a", "b"]
    groups = classes.select(F.col("n").alias("n_shingles"), "a", "b", "m").join(counts, F.col("a") == F.col("key"), "left")
    groups = stash(groups.select(*key, F.col("m").alias("n"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "jaccard-groups")
    every = rows.where("counts is null").select("doc_id", F.col("n").alias("n_shingles"), "a", "b")
    compared = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    linked = join_groups(every.where(compared), groups, key, rows.count()).select("doc_id", "n_shingles", "n_links")
    rest = every.where(~compared).select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), 0).cast("long").alias("n_links"))
    out = join_checked(linked.unionByName(rest), final, F.col("doc_id") == F.col("id"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"), "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without those that are not the smallest doc_id of their component, columns unchanged."""
    gone = components(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("__id")).distinct()
    return drop_ids(docs, gone)
