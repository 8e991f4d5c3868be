"""What the operators of this subpackage share: the shared work folder, byte tables and rolling hashes."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, IntegralType, StructField, StructType

from weftline.session import checkpoint_dir

#: ASCII white space as the contracts define it: [\x20\x09-\x0D]. bytes.split() splits on exactly these.
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (see session.checkpoint_dir) a new one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        checkpoint_dir(spark)
        path = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return path.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{work_dir(spark)}/weftline-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a frame from materialize() that nothing reads any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name).getParent()
        if "/weftline-" in path.toString():
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def integer_id(df: DataFrame, doc_id: str) -> None:
    """Refuse ids that are not whole numbers, whose order decides."""
    if not isinstance(df.schema[doc_id].dataType, IntegralType):
        raise TypeError(f"{doc_id} must be of an integer type, not {df.schema[doc_id].dataType.simpleString()}")


def free_name(columns: list[str], name: str) -> str:
    """name, lengthened until it is none of the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def least_hashed(df: DataFrame, key: str, rows: int, *ties: str) -> DataFrame:
    """At most rows rows of df, those whose key has the least hashes; all of df where it has no more.

    Hashes are near uniform, so those under 1.5 times the share suffice, and the task that merges gets little else.
    """
    n = df.count()
    if n <= rows:
        return df
    bound = min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, 1.5 * rows / n + 1000 / n)))
    return df.where(F.xxhash64(key) <= bound).orderBy(F.xxhash64(key), key, *ties).limit(rows)


FILTER_BITS, PAGE = 1 << 24, 1 << 15  # a filter's bits in all, and in a row of its aggregation


def bit_filter(keys: DataFrame, column: str, bits: int = FILTER_BITS) -> Broadcast:
    """A bitmap of bits / 8 bytes, however many keys there are, in which every key's bit is set; see has_bit().

    It spares what certainly has none of the keys a shuffle; what has a key's bit is still joined with the keys.
    """
    place = F.pmod(F.col(column), F.lit(bits))
    pages = keys.groupBy(F.floor(place / PAGE).alias("page")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(PAGE))).alias("set")).collect()  # at most bits / PAGE rows of PAGE / 8 bytes
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in pages:
        out[r.page * PAGE // 8 : (r.page + 1) * PAGE // 8] = np.frombuffer(r.set, dtype=np.uint8)
    return keys.sparkSession.sparkContext.broadcast(out)


def has_bit(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the keys' bits are set in the table of bit_filter()."""
    place = keys % (8 * len(table))
    return (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: What a Python worker remembers from task to task, as functions that forget it.
memories: list[Callable[[], None]] = []


def tidy(keep: bool = False) -> None:
    """Give memory back: a Python worker lives on after its task, beside those of the next stage. keep: but not memories."""
    if not keep:
        for forget in memories:
            forget()
        memories.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with what it has used given back when it ends."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy(keep)
        yield from run(batches)
        tidy(keep)

    return wrapped


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text in each stays near limit bytes; a longer document makes a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.array([0 if x is None else x for x in pc.binary_length(column).to_pylist()], dtype=np.int64)
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of the ranges [start, start + length)."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, dtype=np.int64)
    step = np.ones(ends[-1], dtype=np.int64)
    keep = lengths > 0
    s, n, e = starts.astype(np.int64)[keep], lengths[keep], ends[keep]
    step[0] = s[0]
    step[e[:-1]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(step)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a uint64 array."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Polynomial hashes modulo 2**64 over random byte values; any slice's hash comes from prefix sums."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, seed: int = 7) -> None:
        self.table = np.random.default_rng(seed).integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def powers_upto(self, n: int) -> None:
        if len(self.powers) <= n:
            size = max(n + 1, 1 << 16)
            inverse = pow(self.BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size, self.BASE, dtype=np.uint64)]))
                self.inverses = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size, inverse, dtype=np.uint64)]))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self.powers_upto(len(data))
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.table[data] * self.powers[: len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end], with the length mixed in."""
        self.powers_upto(len(prefix))
        return mix((prefix[ends] - prefix[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


    def of_slices(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, limit: int = 1 << 20) -> np.ndarray:
        """Hashes of data[start:stop] for ascending starts, over about limit bytes at a time."""
        out, lo = np.empty(len(starts), dtype=np.uint64), 0
        while lo < len(starts):
            base = int(starts[lo])
            hi = max(lo + 1, int(np.searchsorted(starts, base + limit)))
            prefix = self.prefix(data[base : int(stops[lo:hi].max())])
            out[lo:hi] = self.of(prefix, starts[lo:hi] - base, stops[lo:hi] - base)
            lo = hi
        return out


Batches = Iterator[pa.RecordBatch]


def _sift(batches: Batches, at: int, bits: Broadcast, maybe: bool) -> Batches:
    for batch in batches:
        yield batch.filter(pa.array(has_bit(bits.value, batch.column(at).to_numpy()) == maybe))


def _squeeze(batches: Batches, text: str) -> Batches:
    """The text column as zstandard frames, for a shuffle that has to carry whole texts."""
    zstd = zstandard.ZstdCompressor(level=3)
    for batch in slices(batches, text, 1 << 22):
        columns, at = list(batch.columns), batch.schema.get_field_index(text)
        columns[at] = pa.array([None if x is None else zstd.compress(x) for x in columns[at].cast(pa.binary()).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def _unsqueeze(batches: Batches, text: str) -> Batches:
    zstd = zstandard.ZstdDecompressor()
    for batch in slices(batches, text, 1 << 21):
        columns, at = list(batch.columns), batch.schema.get_field_index(text)
        columns[at] = pa.array([None if x is None else zstd.decompress(x) for x in columns[at].to_pylist()], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def sifted(df: DataFrame, key: str, bits: Broadcast, maybe: bool) -> DataFrame:
    """The rows of df whose long column key has its bit set (maybe), or has not; see bit_filter()."""
    at = df.columns.index(key)
    return df.mapInArrow(tidied(lambda batches: _sift(batches, at, bits, maybe)), df.schema)


def looked_up(df: DataFrame, found: DataFrame, on: dict[str, Column], text: str, then: Callable[[Batches], Batches], schema: str | StructType) -> DataFrame:
    """then over df left joined with found, which has a row at most for each key and columns of other names than df's.

    on: found's key columns, and what they equal; then gets df's columns and found's others, and gives rows of schema.
    Rows whose keys found certainly has not do not travel; the others do with their text squeezed. What follows each
    other without a shuffle is one function, so that a task needs one Python worker.
    """
    names, rest = df.columns, [c for c in found.columns if c not in on]
    own: dict[str, str] = {}
    for c in on:
        own[c] = free_name([*names, *found.columns, *own.values()], f"_{c}")
    key = free_name([*names, *found.columns, *own.values()], "_key")
    keyed = df.withColumns({own[c]: x for c, x in on.items()}).withColumn(key, F.xxhash64(*own.values()))
    bits, at, kinds = bit_filter(found.select(F.xxhash64(*on).alias("key")), "key"), len(keyed.columns) - 1, [to_arrow_type(found.schema[c].dataType) for c in rest]

    @tidied
    def stay(batches: Batches) -> Batches:
        few = _sift(batches, at, bits, False)
        yield from then(pa.RecordBatch.from_arrays([*b.columns[: len(names)], *(pa.nulls(b.num_rows, k) for k in kinds)], names=[*names, *rest]) for b in few)

    @tidied
    def travel(batches: Batches) -> Batches:
        yield from _squeeze(_sift(batches, at, bits, True), text)

    @tidied
    def arrive(batches: Batches) -> Batches:
        yield from then(_unsqueeze(batches, text))

    carried = StructType([StructField(f.name, BinaryType() if f.name == text else f.dataType) for f in keyed.schema])
    joined = keyed.mapInArrow(travel, carried).join(found.withColumnsRenamed(own), list(own.values()), "left")
    return keyed.mapInArrow(stay, schema).unionByName(joined.select(*(F.col(f"`{c}`") for c in names), *rest).mapInArrow(arrive, schema))


def same_slices(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each k, whether data[a:a+n] and data[b:b+n] hold the same bytes; in blocks of bounded memory."""
    out = np.ones(len(a), dtype=bool)
    ends = np.cumsum(lengths.astype(np.int64))
    lo = 0
    while lo < len(a):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + (1 << 21), side="right")))
        n = lengths[lo:hi]
        differs = data[ragged(a[lo:hi], n)] != data[ragged(b[lo:hi], n)]
        if differs.any():
            owner = np.repeat(np.arange(lo, hi), n)
            out[owner[differs]] = False
        lo = hi
    return out
