"""Importance resampling towards a target: documents whose words look like the target's are drawn more often.

Each task runs DuckDB over its documents: SQL unnests words, pairs neighbours with a window and hashes both with zlib's
CRC-32 into buckets. A document's bucket counts, and at a task's end the sums over its documents, go to Parquet. Spark
merges the sums to the corpus's and the target's counts, gives each bucket the gain of its likelihood ratio, and scores
and draws documents without replacement: a Gumbel noise of the id is added to the mean gain and the highest scores win.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialize, partitions, release, slices, texts_of, tidied

BUCKETS, MIN_WORDS, PERCENT, SEED, SCALE = 10_000, 20, 25, 7, 1000
SLICE = 1 << 19  # bytes of text that DuckDB sees at a time
MEMORY = "512MB"
_LETTERS = b"0123456789abcdefghijklmnopqrstuvwxyz"
_CAPITALS = bytes(range(65, 91))
_OTHERS = bytes(b for b in range(128) if b not in _LETTERS + _CAPITALS)
_PLAIN = bytes.maketrans(_OTHERS + _CAPITALS, b" " * len(_OTHERS) + _CAPITALS.lower())
FEATURES = f"""
with words as (select piece, unnest(string_split(words, ' ')) word from pieces where words <> ''),
pairs as (select piece, word, lead(word) over () follower, lead(piece) over () follows from words)
select piece, crc32(feature) % {{buckets}} bucket, count(*) n
from (select piece, word feature from pairs union all select piece, word || ' ' || follower from pairs where follows = piece)
group by all order by all"""


def words_of(text: bytes) -> bytes:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text with A-Z in lower case, a blank between two."""
    return b" ".join(text.translate(_PLAIN).split())


def pieces_of(words: bytes, limit: int = SLICE) -> Iterator[tuple[bytes, bytes | None]]:
    """Cut words into pieces near limit bytes; each but the first begins with the last word of the one before, given too."""
    start, lead = 0, None
    while len(words) - start > limit and (stop := words.find(b" ", start + max(limit, len(lead or b"") + 1))) > 0:
        yield words[start:stop], lead
        start = max(start, words.rfind(b" ", start, stop) + 1)
        lead = words[start:stop]
    yield words[start:], lead


def _crc(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, places, data = column.buffers()
    data, wide = data.to_pybytes() if data else b"", pa.types.is_large_string(column.type)
    at = np.frombuffer(places, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    return pa.array(np.fromiter((zlib.crc32(data[i:j]) for i, j in zip(at, at[1:])), dtype=np.uint32, count=len(column)))


class _Counter:
    """DuckDB in a task, with zlib's CRC-32 as a function of SQL."""

    def __init__(self, buckets: int) -> None:
        self.sql, self.buckets = FEATURES.format(buckets=buckets), buckets
        self.duck = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        self.duck.create_function("crc32", _crc, ["VARCHAR"], "UINTEGER", type="arrow")

    def counts(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, bucket, n) in order."""
        self.duck.register("pieces", pa.table({"piece": pa.array(range(len(pieces)), pa.int32()), "words": pa.array(pieces, pa.binary()).cast(pa.string())}))
        out = self.duck.sql(self.sql).to_arrow_table()
        self.duck.unregister("pieces")
        return tuple(out.column(k).to_numpy().astype(np.int64) for k in range(3))

    def long_counts(self, words: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """counts() of one text, cut into pieces so that DuckDB's memory stays bounded."""
        total = np.zeros(self.buckets, dtype=np.int64)
        for piece, lead in pieces_of(words):
            _, bucket, n = self.counts([piece])
            total[bucket] += n
            if lead is not None:  # the last piece has counted it
                total[zlib.crc32(lead) % self.buckets] -= 1
        bucket = np.flatnonzero(total)
        return np.zeros(len(bucket), dtype=np.int64), bucket, total[bucket]


def bucket_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """For every row of docs doc_id, n_words, and as arrays its buckets and their counts; and for every task a row with
    total true: the sums over its documents, without id. A null text has no words."""
    id_type = docs.schema[doc_id].dataType.simpleString()

    def rows(ids: pa.Array, n_words: np.ndarray, starts: np.ndarray, bucket: np.ndarray, n: np.ndarray, total: bool) -> pa.RecordBatch:
        starts = pa.array(starts, pa.int32())
        lists = [pa.ListArray.from_arrays(starts, pa.array(x, pa.int64())) for x in (bucket, n)]
        return pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), *lists, pa.array([total] * len(n_words), pa.bool_())], names=["doc_id", "n_words", "buckets", "counts", "total"])

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, sums, seen, kind = _Counter(buckets), np.zeros(buckets, dtype=np.int64), 0, None
        for batch in slices(batches, "text", SLICE):
            texts, kind = [words_of(x) for x in texts_of(batch, "text")], batch.column(0).type
            piece, bucket, n = counter.long_counts(texts[0]) if len(texts) == 1 and len(texts[0]) > SLICE else counter.counts(texts)
            np.add.at(sums, bucket, n)
            n_words = np.array([x.count(b" ") + (x != b"") for x in texts], dtype=np.int64)
            seen += int(n_words.sum())
            yield rows(batch.column(0), n_words, np.searchsorted(piece, np.arange(len(texts) + 1)), bucket, n, False)
        if kind is not None:
            bucket = np.flatnonzero(sums)
            yield rows(pa.nulls(1, kind), np.array([seen]), np.array([0, len(bucket)]), bucket, sums[bucket], True)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {id_type}, n_words long, buckets array<long>, counts array<long>, total boolean")


def merged(counts: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The sums over all tasks, by bucket: at most that many rows reach the driver."""
    out = [0] * buckets
    each = counts.where("total").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    for r in each.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: list[int], target: list[int], scale: int = SCALE) -> np.ndarray:
    """floor(scale * ln(target's share / corpus's share)) of each bucket, one added to each count."""
    s_all, t_all, n = float(sum(corpus)), float(sum(target)), float(len(corpus))
    return np.array([math.floor(scale * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(corpus, target)], dtype=np.int64)


def scored(counts: DataFrame, gain: np.ndarray, *, seed: int = SEED, scale: int = SCALE) -> DataFrame:
    """doc_id, n_words, n_features, weight (floored mean gain of the features, 0 without any), score (weight and noise)."""
    id_type = counts.schema["doc_id"].dataType.simpleString()
    known = counts.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    @tidied
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket, n = b.column("buckets"), b.column("counts")
            at = bucket.offsets.to_numpy().astype(np.int64)
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (known.value[bucket.values.to_numpy()] * n.values.to_numpy(), n.values.to_numpy())]
            gained, features = (x[at[1:]] - x[at[:-1]] for x in sums)
            weight = gained // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    share = (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    out = counts.where("not total").mapInArrow(weigh, f"doc_id {id_type}, n_words long, n_features long, weight long")
    return out.withColumn("score", F.col("weight") + F.floor(-F.lit(float(scale)) * F.log(-F.log(share))).cast("long"))


def _ranked(rows: DataFrame) -> DataFrame:
    """rows with rank 1, 2, 3... by highest score, then smallest id (null first): ranges are sorted and numbered at once,
    and a range's numbers begin where the ranges before it end. No task gets all rows."""
    row = ["doc_id", "n_words", "n_features", "weight", "score"]
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("row")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(np.arange(done + 1, done + 1 + b.num_rows))], names=[*b.schema.names, "part", "place"])
            done += b.num_rows

    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).select(*row)
    numbered = materialize(dealt.mapInArrow(number, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema) + ", part int, place long"), "ranks")
    sizes = sorted((r.part, r["count"]) for r in numbered.groupBy("part").count().collect())  # a row a range
    before = [(p, sum(n for q, n in sizes if q < p)) for p, _ in sizes]
    starts = rows.sparkSession.createDataFrame(before, "part int, start long")
    return numbered.join(F.broadcast(starts), "part").select(*row, (F.col("start") + F.col("place")).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """For every row of docs doc_id, n_features, weight, score, rank and n_words.

    Features are words and pairs of neighbouring words, repeats counted. Of the rows with at least min_words words the
    percent of a hundred (rounded down) with the highest scores are drawn and ranked from 1; other ranks are null.
    Null and empty texts have no features and weight 0; a null id counts as an empty one in its noise and as the least
    in ties; repeated rows each get a row and ranks of their own; empty tables give no rows or no gains; other columns
    are ignored.
    """
    spilled = materialize(bucket_counts(docs, doc_id=doc_id, text=text, buckets=buckets), "buckets")
    wanted = materialize(bucket_counts(target.withColumn("_id", F.lit(0)), doc_id="_id", text=target_text, buckets=buckets), "target")
    gain = gains(merged(spilled, buckets), merged(wanted, buckets))
    rows = materialize(scored(spilled, gain, seed=seed).withColumn("row", F.monotonically_increasing_id()), "scores")
    release(spilled)
    release(wanted)
    able = rows.where(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    ranks = _ranked(able).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranks.select(columns).unionByName(rows.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")).select(columns))
