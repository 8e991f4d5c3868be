"""Packing documents into fixed-size sequences by order-preserving dynamic programming.

The documents' ids in doc_id order are one stream. A cut may fall at a document's end, at a sentence's end (a small
penalty) or, where a sentence is longer than ``stride`` ids, at every ``stride``-th id of it (a larger one). With f(j)
the least cost up to cut j, f(j) = penalty(j) + window - c(j) + min(f(i) + c(i)) over the cuts i at most a window
before; a monotone queue gives each minimum in constant time. Each range partition is one stream, worked through in
chunks of bounded size: of a chunk's best cuts those that lie AHEAD windows or more before its end are final, and the
rest is carried into the next chunk, so that no chunk's end is forced to be a cut.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.bpe import CACHE_UNITS, encoder, public_path
from weftline.llm.common import partitions, slices, tidied

WINDOW, STRIDE, CHUNK, AHEAD = 1024, 8, 1 << 19, 64
#: What a cut costs, in ids of padding.
DOCUMENT, SENTENCE, INSIDE = 0, 1, 4


def candidates(sentence: np.ndarray, ends: np.ndarray, n: int, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Places where the stream 0..n may be cut, with their costs; the last place is n. No gap exceeds stride."""
    cost = np.full(n + 1, -1, dtype=np.int16)
    cost[np.flatnonzero(sentence[:n]) + 1] = SENTENCE
    cost[ends] = DOCUMENT
    cost[n] = DOCUMENT
    at = np.flatnonzero(cost >= 0)
    before = np.concatenate([[0], at[:-1]])
    extra = np.maximum(0, (at - before - 1) // stride)
    which = np.repeat(np.arange(len(at)), extra)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    cost[before[which] + nth * stride] = INSIDE
    at = np.flatnonzero(cost >= 0)
    at = at[at > 0]
    return at, cost[at]


def best_cuts(at: np.ndarray, cost: np.ndarray, window: int = WINDOW, last: bool = True) -> list[int]:
    """The cuts of least total padding plus cost, as ascending places; the last of at is always one.

    last=False: more places follow, so the cuts up to the cheapest one that a later window can start from.
    """
    places, costs = [0, *at.tolist()], [0, *cost.tolist()]
    value, parent = [0] * len(places), [0] * len(places)
    queue: deque[int] = deque([0])
    for j in range(1, len(places)):
        c = places[j]
        while c - places[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        parent[j] = i
        value[j] = v = costs[j] + window + value[i]  # f(j) + c(j), which the later cuts compare
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    out, j = [], len(places) - 1
    if not last:
        j = min(queue, key=lambda j: value[j] - places[j])  # f(j)
    while j:
        out.append(places[j])
        j = parent[j]
    return out[::-1]


class _Stream:
    """The ids of one partition, cut and emitted chunk by chunk."""

    def __init__(self, window: int, sentence: np.ndarray, first: int) -> None:
        self.window, self.sentence, self.sequence = window, sentence, first
        self.ids, self.docs, self.counts, self.skip = np.zeros(0, dtype="<u4"), [], np.zeros(0, dtype=np.int64), 0

    def add(self, docs: list, ids: np.ndarray, counts: np.ndarray) -> None:
        self.ids, self.docs, self.counts = np.concatenate([self.ids, ids]), self.docs + docs, np.concatenate([self.counts, counts])

    def pieces(self, last: bool) -> Iterator[dict]:
        """skip: how many ids of the first document are gone already."""
        n = len(self.ids)
        if not n:
            return
        ends = np.cumsum(self.counts) - self.skip
        cuts = best_cuts(*candidates(self.sentence[self.ids], ends, n), self.window, last)
        if not last:
            cuts = cuts[: bisect_right(cuts, n - AHEAD * self.window)]
        stop = cuts[-1] if cuts else 0
        if stop:
            bounds = np.unique(np.concatenate([[0], cuts, ends[ends < stop]]))
            a, b = bounds[:-1], bounds[1:]
            doc = np.searchsorted(ends, a, side="right")
            sequence = np.searchsorted(cuts, a, side="right")
            begins = np.concatenate([[0], cuts])[sequence]
            starts = a - np.concatenate([[-self.skip], ends[:-1]])[doc]
            raw = self.ids.data
            yield {
                "doc_id": [self.docs[i] for i in doc.tolist()], "start": starts, "length": b - a,
                "ids_crc32": np.array([zlib.crc32(raw[x:y]) for x, y in zip(a.tolist(), b.tolist())], dtype=np.int64),
                "doc_tokens": self.counts[doc], "sequence_id": self.sequence + sequence, "offset": a - begins,
            }
            self.sequence += len(cuts)
        gone = int(np.searchsorted(ends, stop, side="right"))
        self.skip = int(stop - (ends[gone - 1] if gone else -self.skip))
        self.ids, self.docs, self.counts = self.ids[stop:].copy(), self.docs[gone:], self.counts[gone:]


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, tokenizer: str | None = None, cache_units: int = CACHE_UNITS) -> DataFrame:
    """One row for each piece of a document in a sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and the end id 0; a null or empty text is the end id alone. Rows with a null id come
    first, repeated ids stand in the order of their texts, each row being a document. Sequences hold at most window
    ids; their ids ascend with doc_id, without gaps inside a partition. An empty table gives no rows; other columns
    are ignored. cache_units: about how many distinct units' ids a Python worker remembers.
    """
    path = tokenizer or public_path()
    id_type = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    @partial(tidied, keep=True)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, cache_units)
        stream = _Stream(window, bpe.sentence_ends(), TaskContext.get().partitionId() << 33)
        kind = None

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            for x in stream.pieces(last):
                yield pa.RecordBatch.from_arrays([pa.array(x["doc_id"], kind), *(pa.array(x[k], pa.int64()) for k in names[1:])], names=names)

        for batch in slices(batches, "text", 1 << 21):
            kind = batch.column(0).type
            stream.add(batch.column(0).to_pylist(), *bpe.encode(batch.column(1).to_pylist()))
            if len(stream.ids) >= CHUNK:
                yield from out(last=False)
        if kind is not None:
            yield from out(last=True)

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    placed = slim.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return placed.mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{c} long" for c in names[1:]))
