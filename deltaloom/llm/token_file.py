"""Token ids in fixed-width bit-packed files.

File format (little-endian numbers unless said otherwise):
  8 bytes  magic "DLTOKEN1"
  payload  blocks of ``block_ids`` ids, each id in ``width`` = bits of (vocabulary size - 1), most significant bit first,
           each block padded to a whole byte
  index    int64 block offsets (n_blocks + 1), int64 doc ids, uint8 doc id present, int64 first id of each document (n_docs + 1)
  footer   JSON {width, block_ids, n_ids, n_docs, n_blocks, index}, its uint32 length, magic
The offsets give random access to a block or a document; a block is unpacked by numpy at once.

Documents go to files in ascending doc id (null first, equal ids by text), one file for each range partition, under
names that are unique to a task attempt, so a repeated task never touches what another wrote. Null or empty text has
the end id alone; an empty table writes nothing and reads as empty; further columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, park, read, shared_path, text_of, wide
from .units import encoder, vocabulary_size

MAGIC = b"DLTOKEN1"
#: Ids of a block; documents that a reader returns at once.
BLOCK_IDS, ROWS = 1 << 16, 10_000


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f">u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(bits[:, 32 - width :]).tobytes()


def unpack_bits(data: bytes, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f">u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
    full = np.zeros((n, 32), np.uint8)
    full[:, 32 - width :] = bits
    return np.packbits(full, axis=1).view(">u4").ravel().astype(np.uint32)


class Writer:
    def __init__(self, sink, vocabulary: int, block_ids: int = BLOCK_IDS):
        self.sink, self.width, self.block_ids = sink, max(1, (vocabulary - 1).bit_length()), block_ids
        self.wait, self.waiting, self.n_ids = [], 0, 0
        self.offsets, self.ids, self.present, self.starts = [len(MAGIC)], [], [], [0]
        sink.write(MAGIC)

    def _block(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.width)
        self.sink.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id or 0)
        self.present.append(doc_id is not None)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        self.wait.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block_ids:
            ids = np.concatenate(self.wait)
            full = len(ids) // self.block_ids * self.block_ids
            for i in range(0, full, self.block_ids):
                self._block(ids[i : i + self.block_ids])
            self.wait, self.waiting = [ids[full:]], len(ids) - full

    def close(self) -> None:
        if self.waiting:
            self._block(np.concatenate(self.wait))
        at = self.offsets[-1]
        for values, kind in ((self.offsets, "<i8"), (self.ids, "<i8"), (self.present, "u1"), (self.starts, "<i8")):
            self.sink.write(np.asarray(values, kind).tobytes())
        foot = json.dumps({"width": self.width, "block_ids": self.block_ids, "n_ids": self.n_ids, "n_docs": len(self.ids), "n_blocks": len(self.offsets) - 1, "index": at}).encode()
        self.sink.write(foot + struct.pack("<I", len(foot)) + MAGIC)


class Reader:
    """Random access: ``ids(a, b)`` reads only the blocks that hold ids a..b-1; ``document(i)`` is one document's ids."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        tail = source.read_at(12, end - 12)
        if tail[4:] != MAGIC or source.read_at(8, 0) != MAGIC:
            raise ValueError("not a token file")
        n = struct.unpack("<I", tail[:4])[0]
        foot = json.loads(source.read_at(n, end - 12 - n))
        self.width, self.block_ids, self.n_ids, self.n_docs = (foot[k] for k in ("width", "block_ids", "n_ids", "n_docs"))
        index, at = source.read_at(end - 12 - n - foot["index"], foot["index"]), 0
        parts = []
        for k, kind in ((foot["n_blocks"] + 1, "<i8"), (self.n_docs, "<i8"), (self.n_docs, "u1"), (self.n_docs + 1, "<i8")):
            parts.append(np.frombuffer(index, kind, k, at))
            at += parts[-1].nbytes
        self.offsets, ids, present, self.starts = parts
        self.doc_ids = [int(i) if p else None for i, p in zip(ids, present, strict=True)]

    def ids(self, a: int, b: int) -> np.ndarray:
        if a >= b:
            return np.zeros(0, np.uint32)
        first, last = a // self.block_ids, (b - 1) // self.block_ids
        data = self.source.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        out, at = [], 0
        for k in range(first, last + 1):
            size = int(self.offsets[k + 1] - self.offsets[k])
            n = min(self.block_ids, self.n_ids - k * self.block_ids)
            out.append(unpack_bits(data[at : at + size], self.width, n))
            at += size
        return np.concatenate(out)[a - first * self.block_ids : b - first * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def documents(self, span: int = 1 << 20) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order, reading about ``span`` ids at a time."""
        i = 0
        while i < self.n_docs:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + span, "right")) - 1)
            ids = self.ids(int(self.starts[i]), int(self.starts[j]))
            for d in range(i, j):
                yield self.doc_ids[d], ids[self.starts[d] - self.starts[i] : self.starts[d + 1] - self.starts[i]]
            i = j


def write_tokens(df: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", newline_splits: bool = False) -> DataFrame:
    """Write ``df`` in ascending ``id_col``; the manifest has a row for each file: shard, path, n_docs, n_ids.

    One exchange by ranges of the id; a task holds one block and the index of its own file. ``folder`` may be in any
    store that pyarrow.fs opens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, writer, store, sink, name = TaskContext.get().partitionId(), None, None, None, ""
        encode, whole = encoder(path, newline_splits), False
        try:
            for b in batches:
                if writer is None and len(b):
                    store, root = fs.FileSystem.from_uri(folder)
                    store.create_dir(root, recursive=True)
                    name = f"{shard:08d}-{uuid.uuid4().hex}.dlt"
                    sink = store.open_output_stream(f"{root}/{name}")
                    writer = Writer(sink, vocabulary_size(path))
                for doc_id, ids in zip(b.column("id").to_pylist(), encode(b.column("text")), strict=True):
                    writer.add(doc_id, np.append(ids, ids.dtype.type(end_id)))
            if writer is not None:
                writer.close()
            whole = True
        finally:
            if sink is not None:
                sink.close()
                if not whole:  # a task that fails leaves no half file
                    store.delete_file(f"{root}/{name}")
        if writer is not None:
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([len(writer.ids)], pa.int64()), pa.array([writer.n_ids], pa.int64())], names=["shard", "path", "n_docs", "n_ids"])

    narrow = df.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    ordered = narrow.repartitionByRange(wide(df.sparkSession), F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    return arrow_map(ordered, run, "shard int, path string, n_docs long, n_ids long")


def read_tokens(spark: SparkSession, manifest: DataFrame, checksums: bool = True) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The manifest has a row for each file, so the driver adds up file sizes, never documents.
    """
    files, before = [], 0
    for r in manifest.orderBy("shard").collect():
        files.append((r.path, before))
        before += r.n_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                store, file = fs.FileSystem.from_uri(name)
                with store.open_input_file(file) as source:
                    reader = Reader(source)
                    sums = (zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in reader.documents())
                    for i in range(0, reader.n_docs, ROWS):
                        starts = reader.starts[i : i + ROWS + 1]
                        yield pa.record_batch([pa.array(reader.doc_ids[i : i + ROWS], pa.int64()), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(list(islice(sums, ROWS)), pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(files, "path string, base long").repartition(max(1, len(files)), "path")
    return arrow_map(listed, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    manifest = park(write_tokens(docs, shared_path(spark, "tokens"), P.path("word_bpe_49k.json"), end_id=2, newline_splits=True), "manifest")
    return read_tokens(spark, manifest)


QUERIES = {"op8_token_files": op8_token_files}
ORACLE_SQL: dict[str, str] = {}
