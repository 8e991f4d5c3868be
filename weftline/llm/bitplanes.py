"""Token-id files: fixed-size blocks of ids transposed into byte or bit planes, each plane compressed by zstandard.

A file is, in this order: the magic; the planes of block after block; the index (zstandard over little-endian 64-bit
numbers: block size, plane bits, ids, blocks, documents; then for each block its place and each plane's size, then
each document's id and ids); the index's place and size; the magic again. A plane of zeros has size 0. Any block is
read alone by its index entry. Files of a folder hold ascending ranges of doc_id.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.bpe import encoder, public_path
from weftline.llm.common import integer_id, new_path, partitions, slices, tidied

MAGIC, BLOCK = b"WEFTPLN1", 1 << 16


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """The planes of 32-bit ids, lowest first: 4 of bytes (bits=8) or 32 of bits (bits=1)."""
    rows = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [np.ascontiguousarray(rows[:, k]).tobytes() for k in range(4)]
    spread = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(spread[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    """The ids of to_planes(); an empty plane is zeros."""
    if bits == 8:
        rows = np.zeros((n, 4), dtype=np.uint8)
        for k, plane in enumerate(planes):
            if plane:
                rows[:, k] = np.frombuffer(plane, dtype=np.uint8)
        return rows.view("<u4").ravel()
    spread = np.zeros((n, 32), dtype=np.uint8)
    for k, plane in enumerate(planes):
        if plane:
            spread[:, k] = np.unpackbits(np.frombuffer(plane, dtype=np.uint8), count=n, bitorder="little")
    return np.packbits(spread, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """Writes ids as they come; close() writes what is left and the index."""

    def __init__(self, out: BinaryIO, block: int = BLOCK, bits: int = 8, level: int = 3) -> None:
        self.out, self.block, self.bits = out, block, bits
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.at, self.ids, self.index, self.docs, self.counts, self.left = len(MAGIC), 0, [], [], [], np.zeros(0, dtype="<u4")
        out.write(MAGIC)

    def add(self, docs: list[int], ids: np.ndarray, counts: np.ndarray) -> None:
        self.docs += docs
        self.counts += counts.tolist()
        ids = np.concatenate([self.left, ids])
        whole = len(ids) // self.block * self.block
        for lo in range(0, whole, self.block):
            self._put(ids[lo : lo + self.block])
        self.left = ids[whole:].copy()

    def _put(self, ids: np.ndarray) -> None:
        planes = [self.zstd.compress(p) if p.strip(b"\0") else b"" for p in to_planes(ids, self.bits)]
        self.index.append([self.at, *map(len, planes)])
        self.out.write(b"".join(planes))
        self.at += sum(map(len, planes))
        self.ids += len(ids)

    def close(self) -> None:
        if len(self.left):
            self._put(self.left)
        numbers = [self.block, self.bits, self.ids, len(self.index), len(self.docs)]
        blob = self.zstd.compress(np.concatenate([np.array(x, dtype="<i8").ravel() for x in (numbers, self.index, self.docs, self.counts)]).astype("<i8").tobytes())
        self.out.write(blob + np.array([self.at, len(blob)], dtype="<u8").tobytes() + MAGIC)


class Reader:
    """Random access to the blocks of a file."""

    def __init__(self, source: BinaryIO) -> None:
        self.source = source
        source.seek(0, os.SEEK_END)
        end = source.tell()
        tail = self._read(end - 24, 24)
        if tail[16:] != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError("not a file of id planes")
        at, size = np.frombuffer(tail[:16], dtype="<u8").tolist()
        numbers = np.frombuffer(zstandard.decompress(self._read(at, size)), dtype="<i8")
        self.block, self.bits, self.ids, blocks, docs = numbers[:5].tolist()
        width = 1 + 32 // self.bits
        self.index = numbers[5 : 5 + blocks * width].reshape(blocks, width)
        self.docs, self.counts = numbers[5 + blocks * width :].reshape(2, docs)

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def read_block(self, k: int) -> np.ndarray:
        at, *sizes = self.index[k].tolist()
        raw, planes, lo = self._read(at, sum(sizes)), [], 0
        for size in sizes:
            planes.append(zstandard.decompress(raw[lo : lo + size]) if size else b"")
            lo += size
        return from_planes(planes, min(self.block, self.ids - k * self.block), self.bits)

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """(doc_id, ids) in order, holding the blocks of one document at a time."""
        have, k, lo = np.zeros(0, dtype="<u4"), 0, 0
        for doc, n in zip(self.docs.tolist(), self.counts.tolist()):
            if lo + n > len(have):
                parts = [have[lo:]]
                while sum(map(len, parts)) < n:
                    parts.append(self.read_block(k))
                    k += 1
                have, lo = np.concatenate(parts), 0
            yield doc, have[lo : lo + n]
            lo += n


def opened(uri: str, mode: str) -> BinaryIO:
    """A file in a folder that all machines share: a mounted path, or a store that pyarrow's file systems reach."""
    path = uri.removeprefix("file://") if uri.startswith("file://") else uri.removeprefix("file:")
    if "://" not in path:
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if mode == "wb":
        store.create_dir(os.path.dirname(path), recursive=True)
        return store.open_output_stream(path)
    return store.open_input_file(path)


def write_ids(docs: DataFrame, folder: str, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, block: int = BLOCK, bits: int = 8) -> DataFrame:
    """Write every document's ids and the end id, in ascending doc_id, as files in folder; runs when the result does.

    Returns a row per file: part, path, n_docs, n_ids. Each attempt of a task writes a file of its own, and only files
    named in the result count, so a lost or repeated task does no harm. Rows with a null id are not written; a null
    text is empty; rows that share an id follow each other in the order of their texts. Ids that are not whole numbers
    are refused.
    """
    integer_id(docs, doc_id)
    path = tokenizer or public_path()

    @partial(tidied, keep=True)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, out = encoder(path), TaskContext.get().partitionId(), None
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.planes"
        for batch in slices(batches, "text", 1 << 21):
            if out is None:
                out = opened(name, "wb")
                writer = Writer(out, block, bits)
            writer.add(batch.column(0).to_pylist(), *bpe.encode(batch.column(1).to_pylist()))
        if out is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([len(writer.docs)], pa.int64()), pa.array([writer.ids], pa.int64())], names=["part", "path", "n_docs", "n_ids"])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    placed = slim.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return placed.mapInArrow(run, "part int, path string, n_docs long, n_ids long")


def read_ids(files: DataFrame) -> DataFrame:
    """From write_ids()'s rows, a row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The driver sees one row per file, to add up where each file starts.
    """
    spark = files.sparkSession
    listed = sorted(files.collect(), key=lambda r: r.part)
    starts = np.concatenate([[0], np.cumsum([r.n_ids for r in listed])]).astype(int).tolist()
    table = spark.createDataFrame([(r.path, s) for r, s in zip(listed, starts)], "path string, base long")

    @partial(tidied, keep=True)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with opened(name, "rb") as source:
                    reader = Reader(source)
                    counts = reader.counts
                    crc = [zlib.crc32(np.ascontiguousarray(ids).data) for _, ids in reader.documents()]
                columns = [reader.docs, base + np.cumsum(counts) - counts, counts, np.array(crc, dtype=np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return table.repartition(max(1, len(listed))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write docs' ids to a new folder in the shared one and read them back; see write_ids() and read_ids()."""
    return read_ids(write_ids(docs, new_path(docs.sparkSession, "planes"), **options))
