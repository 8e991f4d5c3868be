"""A hidden Markov language model, trained by Baum-Welch over all training documents.

A token is a lower-cased word or a text's end. Each token has a class: the ``frequent`` most frequent words and the end
have one each, any other word the class of its last three letters' hash. A state emits a class, and a class a word of
it with probability (c + 0.1) / (N + 0.1 (V + 1)), c being the word's training count, N and V the class's tokens and
distinct words; one share is left for the words that training never saw. So the size of states' tables is bounded, while
the words' counts grow with the corpus and stay distributed.

Texts are cut into words once. A slice of documents numbers its distinct words and asks for them, packed by bucket; a
bucket adds up what all slices have counted and answers each in the order it asked. From then on a document is a row of
class ids and three sums over its words. Each round of Baum-Welch runs over the class ids of every training document,
whole, from its first token to its end; tasks emit expected counts and Spark adds them up. Rounds end when one gains
less than ``gain`` nats a token, or after ``rounds``. Scores come from the scaled forward recursion over whole documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import IS_SPACE, materialize, partitions, release, slices, texts_of, tidied

STATES, FREQUENT, TAILS, ROUNDS, GAIN, SLICE, SEED = 8, 2000, 512, 8, 0.002, 1 << 22, 42
END, SMOOTH = b"", 0.1  # no word is empty
TOKENS, AREA = 1 << 21, 1 << 19  # that wait to be sorted by length, and that go through the recursions side by side


def training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 10 != 0


def tail_of(word: bytes, tails: int) -> int:
    """Which of the classes by ending a word falls into."""
    return zlib.crc32(word.decode()[-3:].encode()) % tails


class Chain(NamedTuple):
    """start (K), move (K, K) and emit (K, classes): rows sum to 1."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_chain(share: np.ndarray, states: int, seed: int) -> Chain:
    """States that stay, each with the classes' shares disturbed at random."""
    rng = np.random.default_rng(seed)
    emit = share * np.exp(rng.normal(size=(states, len(share))))
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Chain(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True))


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, sizes, matrix) of rows, the longest first."""
    sizes = np.array([len(r) for r in rows])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    out = np.zeros((len(rows), int(sizes[0]) if len(rows) else 0), dtype=np.int32)
    for i, k in enumerate(order):
        out[i, : sizes[i]] = rows[k]
    return order, sizes, out


def forward(chain: Chain, rows: list[np.ndarray]) -> np.ndarray:
    """Natural log likelihood of each row of class ids (none of them empty), by the scaled forward recursion."""
    order, sizes, seen = _padded(rows)
    active = np.searchsorted(-sizes, -np.arange(1, seen.shape[1] + 1), side="right")
    emit, total, alpha = np.ascontiguousarray(chain.emit.T), np.zeros(len(rows)), np.tile(chain.start, (len(rows), 1))
    for t in range(seen.shape[1]):
        n = active[t]
        alpha = (alpha[:n] @ chain.move if t else alpha[:n]) * emit[seen[:n, t]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:n] += np.log(scale)
    out = np.empty(len(rows))
    out[order] = total
    return out


def expected(chain: Chain, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and emissions over rows of class ids (none of them empty), and their log likelihood.

    The recursions run in single precision, scaled at each step, in buffers that are used again; sums are double.
    """
    k, classes = chain.emit.shape
    _, sizes, seen = _padded(rows)
    length = seen.shape[1]
    active = np.searchsorted(-sizes, -np.arange(1, length + 1), side="right")
    columns = np.ascontiguousarray(seen.T)
    emit = np.ascontiguousarray(chain.emit.T, dtype=np.float32)[columns]
    start, ahead, ones = chain.start.astype(np.float32), chain.move.astype(np.float32), np.ones((k, 1), dtype=np.float32)
    back = np.ascontiguousarray(ahead.T)
    state, scale = np.zeros_like(emit), np.ones((*columns.shape, 1), dtype=np.float32)
    for t in range(length):
        n = active[t]
        now, size = state[t, :n], scale[t, :n]
        if t:
            np.matmul(state[t - 1, :n], ahead, out=now)
            now *= emit[t, :n]
        else:
            np.multiply(emit[t, :n], start, out=now)
        np.matmul(now, ones, out=size)
        now /= size
    beta, move = np.ones((len(rows), k), dtype=np.float32), np.zeros((k, k))
    for t in range(length - 1, -1, -1):
        n = active[t]
        later = emit[t, :n]
        if t:
            later *= beta[:n]
            later /= scale[t, :n]
            move += state[t - 1, :n].T @ later
        state[t, :n] *= beta[:n]  # from here on the states' shares at t
        if t:
            np.matmul(later, back, out=beta[:n])
    inside = np.arange(length)[:, None] < sizes[None, :]
    flat, weights = columns[inside], state[inside].T.astype(np.float64)
    emitted = np.stack([np.bincount(flat, weights=w, minlength=classes) for w in weights])
    return state[0].sum(axis=0, dtype=np.float64), move * chain.move, emitted, np.log(scale[..., 0], where=inside, out=np.zeros(inside.shape)).sum(keepdims=True)


def packs(rows: list[np.ndarray], area: int = AREA) -> Iterator[list[int]]:
    """Places of rows of like length, the longest first, so many that they fill about area tokens with their padding."""
    order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
    lo = 0
    while lo < len(order):
        n = max(1, area // max(1, len(rows[order[lo]])))
        yield order[lo : lo + n]
        lo += n


def _squeeze(x: np.ndarray) -> bytes:
    """An array of numbers, its bytes by significance, as a zstandard frame."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 3)


def _unsqueeze(blob: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def numbered(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct tokens, the end first; each token's number among them; how many each text has): words and the end."""
    data = np.frombuffer(b" ".join(texts).lower() + b" ", dtype=np.uint8)
    space = IS_SPACE[data]
    before = np.concatenate([[True], space[:-1]])
    begin, stop = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    offsets = np.concatenate([[0], np.cumsum(stop - begin)]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[~space]))]).dictionary_encode()
    ends = np.searchsorted(begin, np.cumsum([len(x) + 1 for x in texts]))
    tokens = np.insert(words.indices.to_numpy().astype(np.int64) + 1, ends, 0)
    return pa.concat_arrays([pa.array([END], pa.binary()), words.dictionary]), tokens, np.diff(np.concatenate([[0], ends])) + 1


def _asked(slim: DataFrame, id_type: str, buckets: int, size: int) -> DataFrame:
    """From (doc_id, text, trains): rows with a bucket (its words and their training counts) and a row for each slice."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", size):
            now += 1
            words, tokens, sizes = numbered(texts_of(batch, "text"))
            n = len(words)
            trains = batch.column("trains").to_numpy(zero_copy_only=False).astype(bool)
            times = np.bincount(tokens[np.repeat(trains, sizes)], minlength=n)
            names = words.to_pylist()
            bucket = np.fromiter(map(zlib.crc32, names), dtype=np.int64, count=n) % buckets
            order = np.argsort(bucket, kind="stable")
            place = np.empty(n, dtype=np.uint32)
            place[order] = np.arange(n)
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) > 0, [True]]))
            parts = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            k = len(parts)
            columns = [
                pa.array([now] * (k + 1), pa.int64()), pa.array([*(int(bucket[x[0]]) for x in parts), None], pa.int32()),
                pa.array([*(zstandard.compress(b"\n".join([names[i] for i in x]), 3) for x in parts), None], pa.binary()),
                pa.array([*(_squeeze(times[x]) for x in parts), _squeeze(place[tokens])], pa.binary()),
                pa.array([*[None] * k, batch.column("doc_id").to_pylist()], pa.list_(batch.column("doc_id").type)),
                pa.array([*[None] * k, trains.tolist()], pa.list_(pa.bool_())), pa.array([*[None] * k, sizes.tolist()], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["slice", "bucket", "words", "numbers", "ids", "trains", "sizes"])

    return slim.mapInArrow(run, f"slice long, bucket int, words binary, numbers binary, ids array<{id_type}>, trains array<boolean>, sizes array<long>")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Requests sorted by bucket, as (bucket, its rows)."""
    now, held = None, []
    for row in (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))):
        if row[1] != now and held:
            yield now, held
            held = []
        now = row[1]
        held.append(row)
    if held:
        yield now, held


def _added(held: list[tuple]) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
    """The distinct words of a bucket, what all slices have counted of each, and each slice's words as places among them."""
    asked = [zstandard.decompress(r[2]).split(b"\n") for r in held]
    coded = pa.chunked_array([pa.array(x, pa.binary()) for x in asked]).combine_chunks().dictionary_encode()
    at = coded.indices.to_numpy()
    counts = np.bincount(at, weights=np.concatenate([_unsqueeze(r[3], "<i8") for r in held]).astype(np.float64), minlength=len(coded.dictionary)).astype(np.int64)
    return coded.dictionary.to_pylist(), counts, np.split(at, np.cumsum([len(x) for x in asked])[:-1])


class Vocabulary(NamedTuple):
    """Frequent words' classes, tokens and distinct words of each class. 0 is the end, then frequent words, then endings."""

    frequent: dict[bytes, int]
    n: np.ndarray
    v: np.ndarray


class _Totals:
    """The end and the most frequent words so far, and the tokens and distinct words of each class by ending."""

    def __init__(self, frequent: int, tails: int) -> None:
        self.frequent, self.top = frequent, {END: 0}
        self.n, self.v = np.zeros(tails, dtype=np.int64), np.zeros(tails, dtype=np.int64)

    def add(self, top: dict[bytes, int], n: np.ndarray, v: np.ndarray) -> None:
        """Of other words than those added before."""
        both = self.top | top | {END: self.top[END] + top.get(END, 0)}
        self.top = dict(sorted(both.items(), key=lambda x: (x[0] != END, -x[1], x[0]))[: self.frequent + 1])
        self.n, self.v = self.n + n, self.v + v

    def row(self) -> pa.RecordBatch:
        blobs = zstandard.compress(b"\n".join(self.top)), *(_squeeze(np.array(x, dtype="<i8")) for x in (list(self.top.values()), self.n, self.v))
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in blobs], names=["words", "counts", "n", "v"])

    def read(self, words: bytes, counts: bytes, n: bytes, v: bytes) -> None:
        names = zstandard.decompress(bytes(words)).split(b"\n")
        self.add(dict(zip(names, _unsqueeze(bytes(counts), "<i8").tolist())), _unsqueeze(bytes(n), "<i8"), _unsqueeze(bytes(v), "<i8"))


def vocabulary(asked: DataFrame, frequent: int, tails: int, mergers: int = 16) -> Vocabulary:
    """The classes and their totals, from all requests. The driver sees a bounded row from each of the mergers."""

    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = _Totals(frequent, tails)
        for _, held in _buckets(batches):
            words, counts, _ = _added(held)
            known = np.flatnonzero(counts)
            tail = np.fromiter((tail_of(words[i], tails) for i in known.tolist()), dtype=np.int64, count=len(known))
            most = known[np.argsort(-counts[known], kind="stable")]
            most = most[counts[most] >= counts[most[min(frequent, len(most) - 1)]]] if len(most) else most  # with all ties
            top = {words[i]: int(counts[i]) for i in [*most.tolist(), *(i for i in known.tolist() if words[i] == END)]}
            totals.add(top, np.bincount(tail, weights=counts[known], minlength=tails).astype(np.int64), np.bincount(tail, minlength=tails))
        yield totals.row()

    @tidied
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = _Totals(frequent, tails)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                totals.read(*row)
        yield totals.row()

    kind, totals = "words binary, counts binary, n binary, v binary", _Totals(frequent, tails)
    parts = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, kind)
    for row in parts.repartition(mergers).mapInArrow(merge, kind).collect():
        totals.read(*row)
    top = list(totals.top.items())
    n, v = np.concatenate([np.zeros(len(top)), totals.n]), np.concatenate([np.zeros(len(top)), totals.v])
    for k, (word, times) in enumerate(top):
        n[k], v[k] = times, times > 0
        n[len(top) + tail_of(word, tails)] -= times
        v[len(top) + tail_of(word, tails)] -= times > 0
    return Vocabulary({w: k for k, (w, _) in enumerate(top)}, n, v)


def _classed(asked: DataFrame, kept: DataFrame, words: Vocabulary, id_type: str) -> DataFrame:
    """A row for each slice: ids, trains, sizes, known (tokens with a training count), seen and inside (see scored()), classes."""
    tails = len(words.n) - len(words.frequent)
    of = np.log10(words.n + SMOOTH * (words.v + 1))

    @tidied
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in _buckets(batches):
            names, counts, places = _added(held)
            kinds = np.fromiter((words.frequent[w] if w in words.frequent else len(words.frequent) + tail_of(w, tails) for w in names), dtype="<u2", count=len(names))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in held], pa.int64()), pa.array([bucket] * len(held), pa.int32()), pa.array([_squeeze(counts[x]) for x in places], pa.binary()), pa.array([_squeeze(kinds[x]) for x in places], pa.binary())],
                names=["slice", "bucket", "counts", "kinds"],
            )

    @tidied
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (_, numbers, ids, trains, sizes, answers) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                tokens, ends = _unsqueeze(numbers, "<u4"), np.cumsum([0, *sizes])
                counts = np.concatenate([_unsqueeze(x["counts"], "<i8") for x in answers])
                kinds = np.concatenate([_unsqueeze(x["kinds"], "<u2") for x in answers])
                seen = np.log10(counts + SMOOTH)
                inside = seen - of[kinds]
                per = lambda x: np.add.reduceat(x[tokens], ends[:-1])  # noqa: E731  every document has its end
                columns = [batch.column("ids").slice(k, 1), batch.column("trains").slice(k, 1), batch.column("sizes").slice(k, 1)]
                columns += [pa.array([per(x).tolist()], pa.list_(kind)) for x, kind in (((counts > 0).astype(np.int64), pa.int64()), (seen, pa.float64()), (inside, pa.float64()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([_squeeze(kinds[tokens])], pa.binary())], names=["ids", "trains", "sizes", "known", "seen", "inside", "classes"])

    answers = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(answer, "slice long, bucket int, counts binary, kinds binary")
    answers = answers.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("bucket", "counts", "kinds"))).alias("answers"))  # bounded by a slice's words
    joined = kept.join(answers, "slice").select("slice", "numbers", "ids", "trains", "sizes", "answers")
    return joined.mapInArrow(apply, f"ids array<{id_type}>, trains array<boolean>, sizes array<long>, known array<long>, seen array<double>, inside array<double>, classes binary")


def _round(encoded: DataFrame, chain: Chain, share: np.ndarray) -> tuple[Chain, float]:
    """One round of Baum-Welch over all training documents, and the log likelihood a token before it."""
    k, classes = chain.emit.shape
    size = k + k * k + k * classes + 2

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, waiting = np.zeros(size), [], 0

        def add() -> None:
            for some in packs(rows):
                total[:-1] += np.concatenate([x.ravel() for x in expected(chain, [rows[i] for i in some])])

        for batch in batches:
            for trains, sizes, blob in zip(*(c.to_pylist() for c in batch.columns)):
                for t, row in zip(trains, np.split(_unsqueeze(blob, "<u2"), np.cumsum(sizes)[:-1])):
                    if t:
                        rows.append(row)
                        waiting += len(row)
                        total[-1] += len(row)
                if waiting > TOKENS:
                    add()
                    rows, waiting = [], 0
        add()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["at", "value"])

    summed = encoded.select("trains", "sizes", "classes").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()  # bounded by the tables' size
    total = np.zeros(size)
    total[summed["at"].to_numpy(dtype=int)] = summed["value"].to_numpy()
    start, move, emit = total[:k] + 0.1, total[k : k + k * k].reshape(k, k) + 0.1, total[k + k * k : -2].reshape(k, classes) + share
    return Chain(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True)), float(total[-2] / max(total[-1], 1))


def scored(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", states: int = STATES, frequent: int = FREQUENT, tails: int = TAILS,
    rounds: int = ROUNDS, gain: float = GAIN, slice_bytes: int = SLICE, seed: int = SEED,
) -> DataFrame:
    """For every row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities).

    Rows whose crc32(doc_id) mod 10 is 0 are held out of all training. Null and empty texts are the end alone. A row
    with a null id is scored but neither trains nor counts as held out; repeated rows each count. Ids may be of any
    type. With no training row every word is unknown. An empty table gives no rows; other columns are ignored.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    ids = F.col(doc_id)
    slim = docs.select(ids.alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(training(ids), F.lit(False)).alias("trains"))
    rows = materialize(_asked(slim, id_type, 2 * partitions(docs.sparkSession), slice_bytes), "asked")
    asked, kept = rows.where("bucket is not null").select("slice", "bucket", "words", "numbers"), rows.where("bucket is null")
    words = vocabulary(asked, frequent, tails)
    n, v = float(words.n.sum()), float(words.v.sum())
    share = (words.n + SMOOTH) / (n + SMOOTH * len(words.n))
    encoded = materialize(_classed(asked, kept, words, id_type), "classes")
    release(rows)
    chain, before = first_chain(share, states, seed), -math.inf
    for _ in range(rounds if n else 0):
        chain, now = _round(encoded, chain, share)
        if now - before < gain:
            break
        before = now
    base_of = math.log10(n + SMOOTH * (v + 1))

    @tidied
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (trains, sizes, known, seen, inside, blob) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                found, total = np.split(_unsqueeze(blob, "<u2"), np.cumsum(sizes)[:-1]), np.empty(len(sizes))
                for some in packs(found):
                    total[some] = forward(chain, [found[i] for i in some])
                own = batch.column(0)[k].values
                held = [not t and x is not None for t, x in zip(trains, own.to_pylist())]
                columns = [pa.array(held, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array([int(n)] * len(sizes), pa.int64()), pa.array(np.array(seen) - np.array(sizes) * base_of), pa.array(total / math.log(10) + np.array(inside))]
                yield pa.RecordBatch.from_arrays([own, *columns], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return encoded.mapInArrow(score, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
