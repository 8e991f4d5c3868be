"""Substring dedup over windows of words, by super-k-mer partitioning.

Each document's words are cut into runs of consecutive windows that share a minimiser (the least hash of 3 consecutive
words inside the window). A run travels as one packed string to its minimiser's bucket. There the windows are sorted,
equal neighbours compared byte by byte, and the smallest doc_id of each window's content found. The cuts go back to
their documents by a join on the id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.llm.common import IS_SPACE, Rolling, free_name, integer_id, looked_up, materialize, mix, partitions, ragged, same_slices, slices, texts_of, tidied
from weftline.llm.minimisers import BLOBS, CUT, CUT_ROWS, CUTS, RUN, batch_of, by_bucket, covered, cut_batch, dealt, owners, pack, runs_of, unpack

WINDOW, MINIMISER, SLICE, BUCKETS = 13, 3, 1 << 21, 4  # buckets a shuffle partition
_rolling = Rolling()


def words_at(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words [^\\x20\\x09-\\x0D]+ of a buffer that ends in white space start and stop."""
    space = IS_SPACE[data]
    before = np.concatenate([[True], space[:-1]])
    return np.flatnonzero(~space & before), np.flatnonzero(space & ~before)


def _split(ids: list, sums: list, texts: list[bytes], window: int, minimiser: int, buckets: int) -> list[tuple[int, int, bytes]]:
    """Blobs of one slice of documents: the runs that travel, and the cuts that are certain already."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    doc_at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
    s, e = words_at(raw)
    n = len(s)
    if n < window:
        return []
    docs = np.searchsorted(doc_at, s, side="right") - 1
    valid = docs[: n - window + 1] == docs[window - 1 :]
    if not valid.any():
        return []
    space = IS_SPACE[raw]
    keep = ~space | np.concatenate([[False], ~space[:-1]])
    data = np.where(space, np.uint8(32), raw)[keep]
    moved = np.cumsum(keep) - 1
    s, e = moved[s], moved[e]
    words = _rolling.of_slices(data, s, e)
    _rolling.powers_upto(n)
    grams = sum(words[k : n - minimiser + 1 + k] * np.uint64(0x9E3779B97F4A7C15 ** (k + 1) % (1 << 64)) for k in range(minimiser))
    runs = runs_of(mix(grams), valid, window - minimiser + 1)
    last = runs.first + runs.count + window - 2
    begin, size = s[runs.first], e[last] + 1 - s[runs.first]  # the blank after the last word travels too
    sums_of_words = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * _rolling.powers[:n])])
    whole = _rolling.of(sums_of_words, runs.first, last + 1)
    id_of, sum_of = np.array(ids, dtype=np.int64), np.array(sums, dtype=np.uint32)
    first_word = np.searchsorted(docs, np.arange(len(texts)))
    doc = docs[runs.first]
    owner = owners(data, begin, size, whole, id_of[doc], runs.first)
    stays = id_of[doc] == id_of[doc[owner]]
    records = np.empty(int(stays.sum()), dtype=RUN)
    records["doc"], records["sum"] = id_of[doc[stays]], sum_of[doc[stays]]
    records["start"], records["size"], records["offset"] = (runs.first - first_word[doc])[stays], size[stays], runs.offset[stays]
    out = dealt(runs.key[stays], records, data, begin[stays], buckets)
    if not stays.all():
        a, b = covered(n, runs.first[~stays], last[~stays] + 1, first_word)
        cuts = np.empty(len(a), dtype=CUT)
        cuts["doc"], cuts["sum"], cuts["start"], cuts["stop"] = id_of[docs[a]], sum_of[docs[a]], a - first_word[docs[a]], b - first_word[docs[a]]
        out.append((int(abs(ids[0]) % buckets), CUTS, pack(cuts)))
    return out


def _count(blobs: list[bytes], window: int) -> np.ndarray:
    """The cuts of one bucket: runs of windows whose content also starts in a document with a smaller id."""
    parts = [unpack(x, RUN) for x in blobs]
    records = np.concatenate([r for r, _ in parts])
    data = np.frombuffer(b"".join(t for _, t in parts), dtype=np.uint8)
    e = np.flatnonzero(data == 32)
    s = np.concatenate([[0], e[:-1] + 1])
    upto = np.searchsorted(e, np.cumsum(records["size"], dtype=np.int64) - 1) + 1
    first = np.concatenate([[0], upto[:-1]])
    count = upto - first - window + 1
    at = ragged(first, count)
    run = np.repeat(np.arange(len(records)), count)
    begin, end = s[at], e[at + window - 1]
    doc = records["doc"][run]
    hashes = _rolling.of_slices(data, begin, end)
    order = np.argsort(hashes, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]))
    sizes = np.diff(np.concatenate([new, [len(order)]]))
    least = np.repeat(np.minimum.reduceat(doc[order], new), sizes)
    rep = np.repeat(order[new], sizes)
    gone = np.zeros(len(order), dtype=bool)
    check = np.repeat(sizes > 1, sizes)
    x, r = order[check], rep[check]
    same = (end[x] - begin[x]) == (end[r] - begin[r])
    same[same] = same_slices(data, begin[x[same]], begin[r[same]], (end - begin)[x[same]])
    gone[x] = doc[x] > least[check]
    for r in np.unique(r[~same]):  # a collision of hashes: settle that run by the windows' bytes
        group = order[rep == r]
        seen: dict[bytes, int] = {}
        for i in group:
            key = data[begin[i] : end[i]].tobytes()
            seen[key] = min(seen.get(key, doc[i]), doc[i])
        gone[group] = [doc[i] > seen[data[begin[i] : end[i]].tobytes()] for i in group]
    edge = np.concatenate([[True], run[1:] != run[:-1]])
    begins = np.flatnonzero(gone & (edge | np.concatenate([[True], ~gone[:-1]])))
    ends = np.flatnonzero(gone & np.concatenate([edge[1:] | ~gone[1:], [True]]))
    cuts = np.empty(len(begins), dtype=CUT)
    k = run[begins]
    local = records["start"][k].astype(np.int64) - first[k]
    cuts["doc"], cuts["sum"], cuts["start"], cuts["stop"] = records["doc"][k], records["sum"][k], local + at[begins], local + at[ends] + window
    return cuts


def repeated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, minimiser: int = MINIMISER) -> DataFrame:
    """(doc, sum, cuts): for documents with any, the word ranges [start, stop) covered by a window that also starts in a
    document with a smaller id. Ranges may overlap. sum is crc32 of the text, to tell rows that share an id apart.
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
                yield cut_batch(_count(runs, window))

    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"), F.crc32(F.col(text)).alias("sum")).where("doc is not null and text is not null")
    packed = rows.mapInArrow(split, BLOBS).repartition("bucket").sortWithinPartitions("bucket")
    return packed.mapInArrow(count, CUT_ROWS).groupBy("doc", "sum").agg(F.collect_list(F.struct("start", "stop")).alias("cuts"))


def _marked(docs: DataFrame, doc_id: str, text: str, cuts: str, then: Callable, schema: str | StructType, **options) -> DataFrame:
    """then over docs with a column cuts, null where nothing goes. Documents that lose nothing are not shuffled."""
    found = materialize(repeated(docs, doc_id=doc_id, text=text, **options), "cuts").withColumnRenamed("cuts", cuts)
    return looked_up(docs, found, {"doc": F.col(doc_id).cast("long"), "sum": F.crc32(F.col(text))}, text, then, schema)


def kept_words(text: bytes, cuts: list[dict] | None) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    words = text.split()
    if not cuts:
        return words, len(words)
    edge = np.zeros(len(words) + 1, dtype=np.int32)
    np.add.at(edge, [c["start"] for c in cuts], 1)
    np.add.at(edge, [c["stop"] for c in cuts], -1)
    stay = np.cumsum(edge[:-1]) == 0
    return [words[i] for i in np.flatnonzero(stay)], len(words)


def digests(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """For every row of docs: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one space.

    Null and empty texts have no words. A row with a null id loses nothing and takes nothing from others. Rows that
    share an id never take words from each other. An empty table gives no rows; other columns are ignored. Ids that are
    not whole numbers are refused.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            out = []
            for text_, cuts in zip(texts_of(batch, "text"), batch.column(2).to_pylist()):
                words, n = kept_words(text_, cuts)
                out.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            a, b, c = zip(*out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return _marked(slim, "doc_id", "text", "cuts", run, f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string", **options)


def without_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", **options) -> DataFrame:
    """docs without the repeated words, with all their columns. Where words go, the rest are joined by one space and
    n_chars counts anew; a text from which nothing goes is left as it is, null or empty ones too; a row left with no word
    goes. An empty table gives no rows.
    """
    schema = docs.schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE):
            texts, cuts = batch.column(names.index(text)).to_pylist(), batch.column(len(names)).to_pylist()
            new = [b" ".join(kept_words(x.encode(), c)[0]).decode() if c else x for x, c in zip(texts, cuts)]
            stay = [not c or bool(x) for x, c in zip(new, cuts)]
            columns = list(batch.columns[: len(names)])
            columns[names.index(text)] = pa.array(new, pa.string())
            if n_chars in names:
                sizes = [len(x) if c else k for x, c, k in zip(new, cuts, columns[names.index(n_chars)].to_pylist())]
                columns[names.index(n_chars)] = pa.array(sizes, columns[names.index(n_chars)].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stay))

    return _marked(docs, doc_id, text, free_name(names, "_cuts"), run, schema, **options)
