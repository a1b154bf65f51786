"""Operator 2: token ids in files of independent zstandard frames with a trailing seek table.

A file is a run of zstandard frames, one a document, then two skippable frames: the index (ids of the documents) and
the seek table in the public zstd seekable layout (compressed size, raw size, low half of the raw bytes' xxh64). Any
zstandard tool can decompress the whole; a reader that wants one document reads the tail and that document's frame.
Inside a frame ids are little-endian, 2 bytes each if all ids of the vocabulary fit, else 4."""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.bpe import alphabet, pieces, vocabulary_path
from folioflow.llm.common import cut, in_order, own_folder, partitions_for, range_starts, table

#: Fixed values of the zstd format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
WITH_CHECKSUMS = 0x80

INDEX_HEAD = "<QBB"


def filesystem(uri: str):
    """The arrow filesystem of a folder and the path in it; local, HDFS and object stores alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


class LibraryPieces(dict):
    """Pre-token to its ids' bytes, by the tokenizers library's model; keeps between `limit` and twice as many, the latest used."""

    def __init__(self, path: str, width: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.before: dict[str, bytes] = {}
        tokenizer = Tokenizer.from_file(path)
        self.model, self.width, self.limit = tokenizer.model, width, limit
        self.char = {b: c for c, b in alphabet().items()}
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.limit:
            self.before = dict(self)
            self.clear()
        if (ids := self.before.get(piece)) is None:
            name = piece.encode("utf-8", "replace").decode("latin-1").translate(self.char)
            ids = np.array([t.id for t in self.model.tokenize(name)], self.width).tobytes()
        self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text. The model works inside pre-tokens only, so equal ones are encoded once."""
        out = []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], self.width).tobytes())
            else:
                out += map(self.__getitem__, pieces(part))
        return b"".join(out)


@functools.cache
def _library(path: str, width: str) -> LibraryPieces:
    return LibraryPieces(path, width)


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 0, width: int = 2) -> DataFrame:
    """Encodes docs, writes one file for each range of doc_id, returns one row a file: part, file, n_docs, n_tokens.

    Files and the documents in them are in ascending doc_id order (rows without doc_id first; repeated ids in the order
    of their frames' bytes). Null text is empty: only the end id. An empty table gives no file. A lost task writes its
    file anew under a name of its own and renames it at the end, so retries and twins leave one whole file.
    width: bytes an id, 2 for vocabularies of up to 65536 ids, else 4."""
    path, dtype = path or vocabulary_path(), f"<u{width}"
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    starts = range_starts(rows, "doc_id", partitions_for(spark))

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, last = _library(path, dtype), np.array([end_id], dtype).tobytes()
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            raw = [known.encode(t) + last for t in batch.text.array]
            yield pd.DataFrame({"doc_id": batch.doc_id.astype("Int64"), "frame": [packer.compress(x) for x in raw], "raw_bytes": [len(x) for x in raw], "checksum": [xxhash.xxh64_intdigest(x) & 0xFFFFFFFF for x in raw]})

    encoded = rows.mapInPandas(frames, "doc_id long, frame binary, raw_bytes long, checksum long")

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        fs, base = filesystem(folder)
        name = f"{base}/part-{task.partitionId():06d}.ids.zst"
        ids, sizes, out = [], [], None
        for batch in batches:
            if len(batch) and out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{name}.{task.taskAttemptId()}")
            for doc_id, frame, raw, checksum in zip(batch.doc_id.array, batch.frame.array, batch.raw_bytes.array, batch.checksum.array):
                out.write(frame)
                ids.append(doc_id)
                sizes.append((len(frame), raw, checksum))
        if out is None:
            return
        out.write(_index(ids, width) + _seek_table(sizes))
        out.close()
        try:
            fs.move(f"{name}.{task.taskAttemptId()}", name)
        except OSError:  # a twin of this task was first
            fs.delete_file(f"{name}.{task.taskAttemptId()}")
        yield pd.DataFrame({"part": [task.partitionId()], "file": [f"{folder}/{name.rpartition('/')[2]}"], "n_docs": [len(ids)], "n_tokens": [sum(r for _, r, _ in sizes) // width]})

    placed = in_order(encoded, "doc_id", ["frame"], starts).drop("head", "_at")
    return cut(placed.mapInPandas(files, "part int, file string, n_docs long, n_tokens long"))


def _skippable(magic: int, payload: bytes) -> bytes:
    return struct.pack("<II", magic, len(payload)) + payload


def _index(ids: list, width: int) -> bytes:
    missing = np.array([x is None or x is pd.NA or x != x for x in ids], bool)
    numbers = np.array([0 if m else int(x) for x, m in zip(ids, missing)], "<i8")
    body = struct.pack(INDEX_HEAD, len(ids), width, int(missing.any())) + numbers.tobytes() + (np.packbits(missing).tobytes() if missing.any() else b"")
    return _skippable(SKIPPABLE_INDEX, body)


def _seek_table(sizes: list[tuple[int, int, int]]) -> bytes:
    return _skippable(SKIPPABLE_SEEK, np.array(sizes, "<u4").tobytes() + struct.pack("<IBI", len(sizes), WITH_CHECKSUMS, SEEKABLE_MAGIC))


class Reader:
    """Random access to the documents of one file: it reads the tail, then only the frames asked for."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or not flags & WITH_CHECKSUMS:
            raise ValueError(f"no seek table in {uri}")
        table_at = size - 9 - 12 * n - 8
        self.sizes = np.frombuffer(self.file.read_at(12 * n, table_at + 8), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.cumsum(self.sizes[:, 0]) - self.sizes[:, 0]
        index_at = int(self.sizes[:, 0].sum())
        body = self.file.read_at(table_at - index_at - 8, index_at + 8)
        _, self.width, missing = struct.unpack_from(INDEX_HEAD, body)
        head = struct.calcsize(INDEX_HEAD)
        numbers = np.frombuffer(body, "<i8", n, head)
        gone = np.unpackbits(np.frombuffer(body, np.uint8, -1, head + 8 * n))[:n].astype(bool) if missing else np.zeros(n, bool)
        self.doc_ids = [None if g else int(x) for x, g in zip(numbers, gone)]
        self.counts = self.sizes[:, 1] // self.width
        self.unpacker = zstandard.ZstdDecompressor()

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document, after its checksum is verified."""
        size, raw, checksum = map(int, self.sizes[k])
        data = self.unpacker.decompress(self.file.read_at(size, int(self.at[k])), max_output_size=raw)
        if len(data) != raw or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(data, f"<u{self.width}")


def read(spark: SparkSession, files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 for each document of the files of write()."""
    rows = sorted(files.collect(), key=lambda r: r["part"])  # one row a file
    starts = np.cumsum([0, *[r["n_tokens"] for r in rows]])
    listed = spark.createDataFrame([(r["file"], int(s)) for r, s in zip(rows, starts)], "file string, start long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, start in zip(batch.file, batch.start):
                reader = Reader(uri)
                crc = [zlib.crc32(reader.ids(k).astype("<u4").tobytes()) for k in range(len(reader.doc_ids))]
                before = start + np.cumsum(reader.counts) - reader.counts
                yield pd.DataFrame({"doc_id": pd.array(reader.doc_ids, "Int64"), "start": before, "n_tokens": reader.counts, "ids_crc32": crc})

    return listed.repartition(max(1, len(rows))).mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write(table(spark, sf_dir, "documents"), own_folder(spark, "token-files"))
    return read(spark, files)
