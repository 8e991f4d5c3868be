"""Super-k-mers: runs of consecutive windows that share one minimiser, packed as one string, and their blobs.

Equal windows have the same minimiser at the same offset, so they meet in that minimiser's bucket whatever document
they come from. Strings repeated inside one slice of a map task are brought together there, before anything is
shuffled: only the owner's copy travels, so a passage that a third of all documents share costs a row a slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard

from weftline.llm.common import mix, ragged, same_slices

#: One run of windows each: owner's id, check sum of its text, first symbol in the document, bytes, minimiser's offset.
RUN = np.dtype([("doc", "<i8"), ("sum", "<u4"), ("start", "<u4"), ("size", "<u4"), ("offset", "<u4")])
#: Symbols [start, stop) of a document that go.
CUT = np.dtype([("doc", "<i8"), ("sum", "<u4"), ("start", "<u4"), ("stop", "<u4")])
BLOBS = "bucket int, kind int, blob binary"
RUNS, CUTS = 0, 1


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each i, the leftmost place of the least of values[i:i+width]; by doubling."""
    best, at, have = values.copy(), np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        less = best[step:] < best[:-step]
        best, at = np.where(less, best[step:], best[:-step]), np.where(less, at[step:], at[:-step])
        have += step
    return at


class Runs(NamedTuple):
    first: np.ndarray  # window where each run starts
    count: np.ndarray  # windows in it
    key: np.ndarray  # its minimiser's hash
    offset: np.ndarray  # of the minimiser from the run's first symbol


def runs_of(hashes: np.ndarray, valid: np.ndarray, width: int) -> Runs:
    """Cut the valid windows (of width minimiser places each) into runs that share the minimiser's place."""
    at = sliding_argmin(hashes, width)[: len(valid)]
    begins = valid & np.concatenate([[True], ~valid[:-1] | (at[1:] != at[:-1])])
    first = np.flatnonzero(begins)
    count = np.bincount(np.cumsum(begins)[valid] - 1, minlength=len(first))
    return Runs(first, count, hashes[at[first]], at[first] - first)


def owners(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each string, the index of the least (doc, place) among the equal ones; equal hashes are compared byte by byte."""
    order = np.lexsort((places, docs, sizes, hashes))
    new = np.concatenate([[True], (hashes[order][1:] != hashes[order][:-1]) | (sizes[order][1:] != sizes[order][:-1])]) if len(order) else np.zeros(0, bool)
    owner = np.empty(len(order), dtype=np.int64)
    owner[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    check = np.flatnonzero(owner != np.arange(len(owner)))
    wrong = check[~same_slices(data, starts[check], starts[owner[check]], sizes[check])]
    if len(wrong):  # a collision of hashes: settle those strings by their bytes
        clash = np.flatnonzero(np.isin(owner, owner[wrong]))
        least: dict[bytes, int] = {}
        for i in sorted(clash, key=lambda i: (docs[i], places[i])):
            owner[i] = least.setdefault(data[starts[i] : starts[i] + sizes[i]].tobytes(), i)
    return owner


def pack(records: np.ndarray, texts: bytes = b"") -> bytes:
    columns = b"".join(np.ascontiguousarray(records[n]).tobytes() for n in records.dtype.names)
    return zstandard.compress(len(records).to_bytes(8, "little") + columns + texts, 3)


def unpack(blob: bytes, kind: np.dtype) -> tuple[np.ndarray, bytes]:
    raw = zstandard.decompress(blob)
    n, at = int.from_bytes(raw[:8], "little"), 8
    out = np.empty(n, dtype=kind)
    for name in kind.names:
        out[name] = np.frombuffer(raw, dtype=kind[name], count=n, offset=at)
        at += n * kind[name].itemsize
    return out, raw[at:]


def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, x = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(x, pa.binary())], names=["bucket", "kind", "blob"])


def dealt(keys: np.ndarray, records: np.ndarray, data: np.ndarray, starts: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    """The runs as one blob for each bucket that has any."""
    bucket = (mix(keys) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            some = order[a:b]
            out.append((int(bucket[some[0]]), RUNS, pack(records[some], data[ragged(starts[some], records["size"][some])].tobytes())))
    return out


def covered(n: int, starts: np.ndarray, stops: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges of 0..n as maximal ranges, parted at breaks."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, stops, -1)
    inside = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    begin = np.flatnonzero(inside[1:] & ~inside[:-1])
    end = np.flatnonzero(inside[:-1] & ~inside[1:])
    at = breaks[(breaks < n) & (breaks > 0)]
    at = at[inside[at + 1] & inside[at]] if len(at) else at
    return np.sort(np.concatenate([begin, at])), np.sort(np.concatenate([end, at]))


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """From rows sorted by bucket, the blobs of runs and of cuts of one bucket after another."""
    now, found = None, ([], [])
    for batch in batches:
        for bucket, kind, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now:
                if found[0] or found[1]:
                    yield found
                now, found = bucket, ([], [])
            found[kind].append(blob)
    if found[0] or found[1]:
        yield found


def cut_batch(cuts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cuts["doc"]), pa.array(cuts["sum"].astype(np.int64)), pa.array(cuts["start"].astype(np.int64)), pa.array(cuts["stop"].astype(np.int64))], names=["doc", "sum", "start", "stop"])


CUT_ROWS = "doc long, sum long, start long, stop long"
