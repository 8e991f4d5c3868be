"""Exact substring dedup over bytes by column-wise construction of a collection's Burrows-Wheeler transform.

100-byte windows are dealt by minimiser, as runs that share it (see minimisers). In a bucket, equal strings are first
brought together under their first occurrence. Among strings that share a minimiser the Burrows-Wheeler transform
is built column by column: each round takes one more symbol of every string from its end, finds where the longer
suffixes fall by the ranks of their symbols, and merges them and their common prefixes with the neighbours into the
columns, which are read and written front to back (as files once they pass ``memory`` bytes). Suffixes that share 100
bytes stand together; the first occurrence among them stays, and the cuts go back to their documents by a join.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Rolling, integer_id, looked_up, materialize, partitions, ragged, slices, texts_of, tidied
from weftline.llm.minimisers import BLOBS, CUT, CUT_ROWS, CUTS, RUN, batch_of, by_bucket, covered, cut_batch, dealt, owners, pack, runs_of, unpack

WINDOW, MINIMISER, SLICE, MEMORY, GROUP, BUCKETS = 100, 24, 1 << 21, 1 << 26, 1 << 19, 4
END = 255  # not a byte of UTF-8; stands for a symbol that is not known yet or does not exist
_rolling = Rolling(11)


class Columns:
    """The transform's columns: symbol before each suffix, common prefix with the suffix above, and whose suffix it is.

    Each round's columns are written anew from the old ones, in order; beyond the memory bound to files.
    """

    KINDS = {"symbol": np.uint8, "prefix": np.uint16, "string": np.int32, "length": np.uint16}

    def __init__(self, memory: int = MEMORY) -> None:
        self.memory, self.folder, self.round = memory, None, 0
        self.now: dict[str, np.ndarray] = {}

    def new(self, name: str, n: int) -> np.ndarray:
        kind = np.dtype(self.KINDS[name])
        if n * kind.itemsize <= self.memory:
            return np.empty(n, dtype=kind)
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory()
        return np.memmap(os.path.join(self.folder.name, f"{name}-{self.round % 2}"), dtype=kind, mode="w+", shape=(n,))

    def start(self, n: int) -> None:
        self.now = {k: self.new(k, n) for k in self.KINDS}
        self.now["symbol"][:], self.now["prefix"][:], self.now["length"][:] = END, 0, 0
        self.now["string"][:] = np.arange(n)

    def merge(self, at: np.ndarray, rows: dict[str, np.ndarray]) -> None:
        """Insert rows so that they stand at the places at of the new columns."""
        self.round += 1
        n = len(self.now["symbol"]) + len(at)
        old = np.ones(n, dtype=bool)
        old[at] = False
        for name, values in self.now.items():
            out = self.new(name, n)
            out[old] = values
            out[at] = rows[name]
            self.now[name] = out

    def close(self) -> None:
        self.now = {}
        if self.folder is not None:
            self.folder.cleanup()


def transform(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, memory: int = MEMORY) -> Columns:
    """The columns over all suffixes of the strings data[start:start+size], no byte of which is 255.

    An end sorts before every symbol, and the ends among themselves by string.
    """
    d = len(starts)
    columns = Columns(memory)
    columns.start(d)
    place = np.arange(d)  # of each active string's longest suffix so far, ascending
    string = np.arange(d)
    for taken in range(1, int(sizes.max(initial=0)) + 1):
        active = sizes[string] >= taken
        place, string = place[active], string[active]
        symbol, prefix = columns.now["symbol"], columns.now["prefix"]
        symbol[place] = data[starts[string] + sizes[string] - taken]
        # Where the k-th known symbol in the order (symbol, place) stands: the k-th suffix below the ends.
        order = np.argsort(symbol, kind="stable")
        order = order[: len(order) - int(np.count_nonzero(symbol == END))]
        fresh = np.zeros(len(symbol), dtype=bool)
        fresh[place] = True
        k = np.flatnonzero(fresh[order])
        at = order[k]
        # Common prefix with the suffix above: 1 + the least between the two places where the same symbol was taken.
        same = lambda i: symbol[order[i]] == symbol[at]
        above = (k > 0) & same(np.maximum(k - 1, 0))
        below = (k + 1 < len(order)) & same(np.minimum(k + 1, len(order) - 1))
        up = np.zeros(len(k), dtype=np.uint16)
        up[above] = 1 + _least(prefix, order[k[above] - 1] + 1, at[above] + 1)
        touched = np.flatnonzero(below & ~fresh[order[np.minimum(k + 1, len(order) - 1)]])
        down = 1 + _least(prefix, at[touched] + 1, order[k[touched] + 1] + 1)
        string = string[np.searchsorted(place, at)]
        place = d + k
        columns.merge(place, {"symbol": np.uint8(END), "prefix": up, "string": string, "length": np.uint16(taken)})
        columns.now["prefix"][place[touched] + 1] = down
    return columns


def _least(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The least of each values[start:stop], none of them empty."""
    if not len(starts):
        return np.zeros(0, dtype=values.dtype)
    order = np.argsort(-starts, kind="stable")  # from the back, so that the stretch between two ranges costs one step
    padded = np.append(values, values.dtype.type(0))
    bounds = np.empty(2 * len(starts), dtype=np.int64)
    bounds[0::2], bounds[1::2] = starts[order], stops[order]
    out = np.empty(len(starts), dtype=values.dtype)
    out[order] = np.minimum.reduceat(padded, bounds)[0::2]
    return out


def first_owner(columns: Columns, window: int, sizes: np.ndarray, docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, window) of the windows whose content occurs first in another string; docs and places: where strings begin."""
    prefix, string, length = (columns.now[k] for k in ("prefix", "string", "length"))
    near = prefix >= window
    inside = near | np.append(near[1:], False)
    s, n = string[inside].astype(np.int64), length[inside].astype(np.int64)
    if not len(s):
        return s, s
    group = np.cumsum(~near[inside]) - 1
    offset = sizes[s] - n
    order = np.lexsort((places[s] + offset, docs[s], group))
    first = np.concatenate([[True], group[order][1:] != group[order][:-1]])
    return s[order][~first], offset[order][~first]


def _split(ids: list, sums: list, texts: list[bytes], window: int, minimiser: int, buckets: int) -> list[tuple[int, int, bytes]]:
    """Blobs of one slice of documents: the runs that travel, and the cuts that are certain already."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n = len(data)
    if n < window:
        return []
    sizes = np.array([len(x) for x in texts])
    doc_at = np.cumsum(sizes) - sizes
    valid = np.ones(n - window + 1, dtype=bool)
    for k in np.cumsum(sizes)[:-1]:
        valid[max(0, k - window + 1) : k] = False
    if not valid.any():
        return []
    prefix = _rolling.prefix(data)
    at = np.arange(n - minimiser + 1)
    runs = runs_of(_rolling.of(prefix, at, at + minimiser), valid, window - minimiser + 1)
    size = runs.count + window - 1
    doc = np.searchsorted(doc_at, runs.first, side="right") - 1
    id_of, sum_of = np.array(ids, dtype=np.int64), np.array(sums, dtype=np.uint32)
    start = runs.first - doc_at[doc]
    owner = owners(data, runs.first, size, _rolling.of(prefix, runs.first, runs.first + size), id_of[doc], start)
    gone = (id_of[doc] != id_of[doc[owner]]) | (start != start[owner])
    stays = ~gone
    records = np.empty(int(stays.sum()), dtype=RUN)
    records["doc"], records["sum"] = id_of[doc[stays]], sum_of[doc[stays]]
    records["start"], records["size"], records["offset"] = start[stays], size[stays], runs.offset[stays]
    out = dealt(runs.key[stays], records, data, runs.first[stays], buckets)
    if gone.any():
        a, b = covered(n, runs.first[gone], (runs.first + size)[gone], doc_at)
        owner_doc = np.searchsorted(doc_at, a, side="right") - 1
        cuts = np.empty(len(a), dtype=CUT)
        cuts["doc"], cuts["sum"], cuts["start"], cuts["stop"] = id_of[owner_doc], sum_of[owner_doc], a - doc_at[owner_doc], b - doc_at[owner_doc]
        out.append((int(abs(ids[0]) % buckets), CUTS, pack(cuts)))
    return out


def _count(blobs: list[bytes], window: int, minimiser: int, memory: int, group_bytes: int) -> np.ndarray:
    """The cuts of one bucket."""
    parts = [unpack(x, RUN) for x in blobs]
    records = np.concatenate([r for r, _ in parts])
    data = np.frombuffer(b"".join(t for _, t in parts), dtype=np.uint8)
    sizes = records["size"].astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    docs, places = records["doc"], records["start"].astype(np.int64)
    # Only a minimiser that several runs hold can have equal windows.
    grams = data[(starts + records["offset"])[:, None] + np.arange(minimiser)].view(f"S{minimiser}").ravel()
    _, kind, times = np.unique(grams, return_inverse=True, return_counts=True)
    several = np.flatnonzero(times[kind] > 1)
    hashes = _rolling.of_slices(data, starts[several], starts[several] + sizes[several])
    owner = several[owners(data, starts[several], sizes[several], hashes, docs[several], places[several])]
    gone = (docs[several] != docs[owner]) | (places[several] != places[owner])
    copies = several[gone]
    cuts = [_cuts(records, copies, np.zeros(len(copies), dtype=np.int64), sizes[copies])]
    distinct = np.unique(owner)
    left = np.bincount(kind[distinct], minlength=len(times)) > 1
    distinct = distinct[left[kind[distinct]]]
    distinct = distinct[_beside(data, starts[distinct] + records["offset"][distinct], starts[distinct], (starts + sizes)[distinct], window, minimiser)]
    distinct = distinct[np.argsort(kind[distinct], kind="stable")]
    # Groups of whole minimisers, each about group_bytes, so that the columns stay in the processor's cache.
    ends = np.cumsum(sizes[distinct])
    new = np.concatenate([[0], np.flatnonzero(np.diff(kind[distinct])) + 1, [len(distinct)]]) if len(distinct) else np.zeros(1, dtype=np.int64)
    lo = 0
    for a, b in zip(new[:-1], new[1:]):
        if b < len(distinct) and ends[b - 1] - (ends[lo - 1] if lo else 0) < group_bytes:
            continue
        x = distinct[lo:b]
        lo = b
        columns = transform(data, starts[x], sizes[x], memory)
        s, offset = first_owner(columns, window, sizes[x], docs[x], places[x])
        columns.close()
        cuts.append(_cuts(records, x[s], offset, offset + window, merge=True))
    return np.concatenate(cuts)


def _beside(data: np.ndarray, at: np.ndarray, starts: np.ndarray, stops: np.ndarray, window: int, minimiser: int) -> np.ndarray:
    """Which strings can share a window with another. Shared windows have their minimisers, which stand at at, one over the
    other, so that half of what a window holds beside it is equal on one side at least: others need no transform."""
    half = (window - minimiser + 1) // 2
    out = np.zeros(len(at), dtype=bool)
    for lo, hi in ((at - half, at + minimiser), (at, at + minimiser + half)):
        fits = np.flatnonzero((lo >= starts) & (hi <= stops))
        _, same, times = np.unique(_rolling.of_slices(data, lo[fits], hi[fits]), return_inverse=True, return_counts=True)
        out[fits[times[same] > 1]] = True
    return out


def _cuts(records: np.ndarray, of: np.ndarray, start: np.ndarray, stop: np.ndarray, merge: bool = False) -> np.ndarray:
    """Cuts of runs, in each run's own bytes; merge: join those of neighbouring windows."""
    if merge and len(of):
        order = np.lexsort((start, of))
        of, start, stop = of[order], start[order], stop[order]
        new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (start[1:] > stop[:-1])]))
        last = np.concatenate([new[1:] - 1, [len(of) - 1]])
        of, start, stop = of[new], start[new], stop[last]
    out = np.empty(len(of), dtype=CUT)
    out["doc"], out["sum"] = records["doc"][of], records["sum"][of]
    out["start"], out["stop"] = records["start"][of] + start, records["start"][of] + stop
    return out


def repeated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, minimiser: int = MINIMISER, memory: int = MEMORY, group_bytes: int = GROUP) -> DataFrame:
    """(doc, sum, cuts): for documents with any, the byte ranges [start, stop) covered by a window that also starts
    earlier, in a document with a smaller id or further ahead in the same one. Ranges may overlap.
    """
    integer_id(docs, doc_id)
    buckets = BUCKETS * partitions(docs.sparkSession)

    @tidied
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            rows = _split(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts_of(batch, "text"), window, minimiser, buckets)
            if rows:
                yield batch_of(rows)

    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs, cuts in by_bucket(batches):
            for blob in cuts:
                yield cut_batch(unpack(blob, CUT)[0])
            if runs:
                yield cut_batch(_count(runs, window, minimiser, memory, group_bytes))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"), F.crc32(F.col(text)).alias("sum")).where("doc is not null and text is not null")
    packed = rows.mapInArrow(split, BLOBS).repartition("bucket").sortWithinPartitions("bucket")
    return packed.mapInArrow(count, CUT_ROWS).groupBy("doc", "sum").agg(F.collect_list(F.struct("start", "stop")).alias("cuts"))


def kept_bytes(text: bytes, cuts: list[dict] | None) -> tuple[bytes, int]:
    """The bytes that stay, and how many maximal runs go."""
    if not cuts:
        return text, 0
    edge = np.zeros(len(text) + 1, dtype=np.int32)
    np.add.at(edge, [c["start"] for c in cuts], 1)
    np.add.at(edge, [c["stop"] for c in cuts], -1)
    stay = np.cumsum(edge[:-1]) == 0
    spans = int(np.count_nonzero(~stay & np.concatenate([[True], stay[:-1]])))
    return np.frombuffer(text, dtype=np.uint8)[stay].tobytes(), spans


def digests(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """For every row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay).

    Null and empty texts have no bytes. A row with a null id loses nothing and takes nothing from others. Of rows that
    repeat an id and a text, none counts as earlier. An empty table gives no rows; other columns are ignored. Ids that
    are not whole numbers are refused.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = materialize(repeated(slim, **options), "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            rows = []
            for x, cuts in zip(texts_of(batch, "text"), batch.column(2).to_pylist()):
                kept, spans = kept_bytes(x, cuts)
                rows.append((len(x), len(x) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            a, b, c, d, e = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d), pa.array(e, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return looked_up(slim, found, {"doc": F.col("doc_id").cast("long"), "sum": F.crc32("text")}, "text", run, schema)
