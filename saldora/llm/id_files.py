"""Token ids in binary files of shuffled planes.

Ids are cut into blocks of CHUNK. A block is transposed into byte planes (all first bytes, all second bytes, ...) or
bit planes (all lowest bits, ...), and each plane is compressed with zstandard by itself. A file is

    MAGIC, planes of chunk 0, planes of chunk 1, ..., index, length of the index (8 bytes, little-endian)

where the index is zstandard over JSON: the kind of planes, for each chunk its offset, ids and plane lengths, and
the documents' ids and lengths, so that any chunk, and any document through its chunks, is read without the rest.

Documents are range-partitioned by doc_id, one file a partition, so that files in order of their number hold all
documents in ascending doc_id order and no task sees more than its range; there are as many files as the input has
splits. A file is written beside its name and then renamed: a task that runs twice leaves the same file. Files are
read chunk by chunk, never as a whole, so that their size has no limit.

Defined cases. A null or empty text has no ids but the end id. Null doc_ids come first. Rows of equal doc_id are
ordered by text, null first, and many of them spread over files by how their texts begin; repeated rows are each
written. An empty table makes no rows. Special strings in texts
become their ids, as the tokenizers library does by default. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldora.llm.common import by_bytes, new_path, tidy, tool
from saldora.llm.pretokens import Numbers, byte_level, byte_symbols, grown, runs

MAGIC = b"SPL1"
CHUNK = 65_536
CACHE = 1_200_000
SLICE = 8 << 20
ROWS = 10_000
MARK = 64


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """The planes of uint32 ids: 4 of bytes, or 32 of bits (lowest first)."""
    octets = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    if kind == "byte":
        return [np.ascontiguousarray(p).tobytes() for p in octets]
    return [np.packbits((p >> k) & 1, bitorder="little").tobytes() for p in octets for k in range(8)]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    if kind == "byte":
        octets = np.stack([np.frombuffer(p, np.uint8, n) for p in planes], axis=1)
    else:
        bits = [np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes]
        octets = np.stack([sum(bits[8 * b + k] << k for k in range(8)).astype(np.uint8) for b in range(4)], axis=1)
    return np.ascontiguousarray(octets).view("<u4").reshape(-1)


class FileWriter:
    """Writes one file; add() takes any number of documents, whose ids are buffered to whole chunks only."""

    def __init__(self, out, kind: str = "byte", chunk: int = CHUNK, level: int = 1):
        import zstandard

        self.out, self.kind, self.chunk = out, kind, chunk
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.at, self.chunks, self.docs, self.lens, self.rest, self.held = len(MAGIC), [], [], [], [], 0
        out.write(MAGIC)

    def add(self, doc_ids: list[int | None], lens: list[int], ids: np.ndarray) -> None:
        self.docs += doc_ids
        self.lens += lens
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= self.chunk:
            flat = np.concatenate(self.rest)
            whole = len(flat) // self.chunk * self.chunk
            for k in range(0, whole, self.chunk):
                self._write(flat[k : k + self.chunk])
            self.rest, self.held = [flat[whole:]], len(flat) - whole

    def _write(self, ids: np.ndarray) -> None:
        planes = [self.pack(p) for p in to_planes(ids, self.kind)]
        self.chunks.append([self.at, len(ids), [len(p) for p in planes]])
        self.out.write(b"".join(planes))
        self.at += sum(map(len, planes))

    def close(self) -> int:
        if self.held:
            self._write(np.concatenate(self.rest))
        index = self.pack(json.dumps({"kind": self.kind, "chunks": self.chunks, "docs": self.docs, "lens": self.lens}).encode())
        self.out.write(index + struct.pack("<Q", len(index)))
        return sum(self.lens)


class FileReader:
    """Reads a file that can seek (or bytes): the index first, then any chunk or document by itself."""

    def __init__(self, file):
        import zstandard

        self.file = pa.BufferReader(file) if isinstance(file, bytes) else file
        self.unpack = zstandard.ZstdDecompressor().decompress
        if self._range(0, 4) != MAGIC:
            raise ValueError("not a file of token id planes")
        end = self.file.size() - 8
        n = struct.unpack("<Q", self._range(end, 8))[0]
        index = json.loads(self.unpack(self._range(end - n, n)))
        self.kind, self.chunks, self.docs, self.lens = (index[k] for k in ("kind", "chunks", "docs", "lens"))

    def _range(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def read(self, k: int) -> np.ndarray:
        at, n, sizes = self.chunks[k]
        data, cuts = self._range(at, sum(sizes)), np.cumsum([0, *sizes])
        return from_planes([self.unpack(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], n, self.kind)

    def document(self, k: int) -> np.ndarray:
        """Ids of the file's document k, from the chunks that hold them."""
        ends, start = np.cumsum([c[1] for c in self.chunks]), sum(self.lens[:k])
        one, two = np.searchsorted(ends, [start, start + self.lens[k] - 1], side="right")
        flat = np.concatenate([self.read(c) for c in range(one, two + 1)]) if self.lens[k] else np.empty(0, np.uint32)
        at = start - (int(ends[one - 1]) if one else 0)
        return flat[at : at + self.lens[k]]

    def documents(self):
        """(doc_id, start in the file, ids) of each document, chunk by chunk."""
        k, buffer, start = 0, np.empty(0, np.uint32), 0
        for doc, n in zip(self.docs, self.lens):
            parts, got = [buffer], len(buffer)
            while got < n:
                parts.append(self.read(k))
                got += len(parts[-1])
                k += 1
            buffer = parts[0] if len(parts) == 1 else np.concatenate(parts)
            yield doc, start, buffer[:n]
            buffer, start = buffer[n:], start + n


class Encoder:
    """Whole texts to ids with the tokenizers library, asked once for each distinct pre-token it has not seen."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.find = Tokenizer.from_file(path), byte_level()
        added = json.loads(self.tok.to_str())["added_tokens"]
        self.special = re.compile("(" + "|".join(re.escape(t["content"]) for t in added) + ")") if added else None
        self.names = {t["content"]: t["id"] for t in added}
        self.symbols = dict(enumerate(byte_symbols()))
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.numbers = Numbers(self._learn, self._keep, cache)

    def _keep(self, kept: np.ndarray) -> None:
        begin, self.size = self.begin[kept], self.size[kept]
        self.flat, self.used = self.flat[runs(begin, self.size)], int(self.size.sum())
        self.begin = np.cumsum(self.size) - self.size

    def _learn(self, words: list[str], n: int) -> None:
        # Pre-tokens go straight to the model, in the characters that stand for their bytes.
        tokenize, names = self.tok.model.tokenize, self.names
        ids = [[names[w]] if w in names else [t.id for t in tokenize(w.encode().decode("latin-1").translate(self.symbols))] for w in words]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(lens.sum())
        self.begin, self.size = grown(self.begin, n + len(words)), grown(self.size, n + len(words))
        self.flat = grown(self.flat, self.used + total)
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        self.size[n : n + len(words)] = lens
        self.begin[n : n + len(words)] = self.used + np.cumsum(lens) - lens
        self.used += total

    def pieces(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.special is None or "<" not in text:
            return self.find(text)
        return [w for p in self.special.split(text) for w in ([p] if p in self.names else self.find(p))]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each text (lengths, flat ids)."""
        at, counts = self.numbers.of([self.pieces(t) for t in texts])
        size = self.size[at]
        ends = np.cumsum(size)
        flat = self.flat[runs(self.begin[at], size)]
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return np.diff(bounds), flat


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, kind: str = "byte") -> list[tuple[int, int]]:
    """Writes one file a range of doc_id to folder (a URI); returns (file number, ids) of each, in order.

    Only these pairs, one a file, come to the driver."""

    @tidy
    def run(batches):
        from pyarrow import fs

        number, writer = TaskContext.get().partitionId(), None
        encoder = tool((__name__, tokenizer), lambda: Encoder(tokenizer))
        store, root = fs.FileSystem.from_uri(folder)
        own, name = f"{root}/.{number:06d}-{uuid4().hex}", f"{root}/{number:06d}.ids"
        for batch in batches:
            for part in by_bytes(batch, 1, SLICE):
                if writer is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(own)
                    writer = FileWriter(out, kind)
                lens, flat = encoder.encode(part.column(1).to_pylist())
                flat = np.insert(flat, np.cumsum(lens), end_id)  # after each document's ids
                writer.add(part.column(0).to_pylist(), (lens + 1).tolist(), flat.astype(np.uint32))
        if writer is not None:
            total = writer.close()
            out.close()
            store.move(own, name)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([total], pa.int64())], ["number", "total"])

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text", f"substring(text, 1, {MARK}) as mark")
    # As many files as the scan has splits: a file's size follows the size of a split, whatever the input's.
    files = max(rows.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism)
    rows = rows.repartitionByRange(files, "doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text").drop("mark")
    return sorted((r["number"], r["total"]) for r in rows.mapInArrow(run, "number long, total long").collect())


def read_ids(spark: SparkSession, folder: str, files: list[tuple[int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    starts, total = [], 0
    for number, n in files:
        starts.append((number, total))
        total += n

    @tidy
    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for number, before in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(f"{root}/{number:06d}.ids") as file:
                    rows, documents = [], FileReader(file).documents()
                    for doc, at, ids in documents:
                        rows.append((doc, before + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) == ROWS:
                            yield found(rows)
                            rows = []
                    yield found(rows)

    def found(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.createDataFrame(starts, "number long, before long").repartition(len(starts)).mapInArrow(run, schema)


def id_files(docs: DataFrame, tokenizer: str, end_id: int = 0, kind: str = "byte", folder: str | None = None) -> DataFrame:
    """Encodes docs into files under folder (by default one in the shared folder) and reads these back."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "ids")
    return read_ids(spark, folder, write_ids(docs, folder, tokenizer, end_id, kind))
