"""Links between texts whose sets of word shingles have a Jaccard similarity of ``share`` or more, all of them verified.

The near-dedup stage's second half: SimHash gives its links as candidates (simhash.keep_one), and prefix filtering
completes them, as 64 bits do not tell a similarity of 0.8. A text is the set of its shingles' 64-bit hashes. All sets
are put in one total order (frequent shingles last, then by hash). Two sets of similarity s or more share one of the
first n - ceil(s n) + 1 shingles of each, so only these prefixes travel, as packed records to their shingles' buckets,
and no pair is missed whatever the order. Pairs are counted over all shared prefix shingles: the prefix that ends first
lies wholly within what the other one shows, so a pair with too few matches in it cannot reach s.

A shingle that more than ``SMALL`` sets show does not make all their pairs. First only sets next to each other by size,
and each set with the one of about its size that has the fewest rare shingles, are paired and verified, with SimHash's
candidates; then the pairs of sets that are not in one component yet. So a family of m near copies costs some m pairs,
and no link between components is lost. A set goes no further that shares fewer shingles with all others together than
any of them would have to share with it; the others meet with all the frequent shingles of a family in one cell, where
a pair's matches are counted at once, so that only pairs with enough of them leave it.

Which shingles are frequent comes from a sample and bears on the cost alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bit_filter, has_bit, materialize, mix, partitions, ragged, release, slices, texts_of, tidied
from weftline.llm.components import components
from weftline.llm.minimisers import pack, unpack

SHINGLE, SHARE, SEED = 5, 0.8, 42
SAMPLE, OFTEN, FREQUENT = 32, 3, 250_000
PAIRS, SEEN, SMALL, BLOCK = 1 << 20, 1 << 18, 16, 64
#: One shingle of a prefix: its hash, its set's signature and size, and how many shingles of the prefix are not frequent.
SHOWN = np.dtype([("key", "<u8"), ("sig", "<i8"), ("n", "<i4"), ("rare", "<i4")])
PAIR, NEXT, MEMBER = 0, 1, 2


def hashes(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the shingles in their order; fewer words are one shingle, no words none."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest, n = xxhash.xxh64_intdigest, min(shingle, len(words))
    return np.array([digest(x, SEED) for x in map(b" ".join, zip(*(words[k:] for k in range(n))))], dtype=np.uint64)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Ascending distinct hashes of the lower-cased text's shingles."""
    return np.unique(hashes(text.lower().split(), shingle))  # bytes: only A-Z are lowered, only ASCII white space splits


def signature(found: np.ndarray) -> int:
    """What stands for a set: 64 bits as a signed long."""
    x = xxhash.xxh64_intdigest(found.tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def need(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """The common shingles that sets of a and b shingles need for the share."""
    return np.ceil(share / (1 + share) * (a + b) - 1e-9).astype(np.int64)


def prefix(n: np.ndarray, share: float) -> np.ndarray:
    return n - np.ceil(share * n - 1e-9).astype(np.int64) + 1


def least_matches(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """The matches within their prefixes that sets of a and b shingles need for the share."""
    o = need(a, b, share)
    return np.minimum(o - a + prefix(a, share), o - b + prefix(b, share))


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The distinct (signature, set) of a task, in pieces; one that comes again much later may be repeated."""
    seen: set[int] = set()
    for batch in slices(batches, "text", 1 << 22):
        out = []
        for text in texts_of(batch, "text"):
            found = shingles(text, shingle)
            sig = signature(found)
            if len(found) and sig not in seen:
                seen.add(sig)
                out.append((sig, found))
        if len(seen) > SEEN:
            seen.clear()
        if out:
            yield out


def _frequent(texts: DataFrame, shingle: int) -> np.ndarray:
    """Ascending shingles that many texts of a sample hold."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _sets(batches, shingle):
            keys, n = np.unique(np.concatenate([x for _, x in sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    some = texts.where(F.expr(f"pmod(xxhash64(text), {SAMPLE}) = 0"))
    often = some.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    got = often.orderBy(F.desc("n"), "key").limit(FREQUENT).select("key").toArrow()
    return np.sort(got.column(0).to_numpy().astype(np.int64).view(np.uint64))


def _fit(a: np.ndarray, b: np.ndarray, n: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs of places (a, b) whose sizes allow the share."""
    fits = np.minimum(n[a], n[b]) >= need(n[a], n[b], share)
    return a[fits], b[fits]


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys start, and their lengths."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return starts, np.diff(np.concatenate([starts, [len(key)]]))


def _all_pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (left, right) of all pairs within each run, about PAIRS at a time."""
    at = ragged(starts, sizes)
    later = np.repeat(starts + sizes, sizes) - at - 1
    ends, lo = np.cumsum(later), 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
        yield np.repeat(at[lo:hi], later[lo:hi]), ragged(at[lo:hi] + 1, later[lo:hi])
        lo = hi


def _counted(kind: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], sig: np.ndarray, n: np.ndarray, share: float) -> Iterator[pa.RecordBatch]:
    """Pairs of places as rows (kind, a, b, na, nb, c), a below b; c is how often the pair occurs here."""
    for left, right in pairs:
        left, right = _fit(left, right, n, share)
        if len(left):
            swap = sig[left] > sig[right]
            left, right = np.where(swap, right, left), np.where(swap, left, right)
            order = np.lexsort((sig[right], sig[left]))
            a, b = sig[left][order], sig[right][order]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            c = np.diff(np.concatenate([first, [len(a)]]))
            yield _rows(kind, a[first], b[first], n[left][order][first], n[right][order][first], c)


PAIR_ROWS = "kind int, a long, b long, na int, nb int, c long"


def _rows(kind: int, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    columns = np.full(len(a), kind, dtype=np.int32), a, b, na.astype(np.int32), nb.astype(np.int32), c.astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["kind", "a", "b", "na", "nb", "c"])


def _met(shown: np.ndarray, share: float) -> Iterator[pa.RecordBatch]:
    """What the prefix shingles of one bucket say; a MEMBER row has the shingle as a and the set as b."""
    shown = shown[np.lexsort((shown["sig"], shown["n"], shown["key"]))]
    key, sig, n, rare = shown["key"], shown["sig"], shown["n"].astype(np.int64), shown["rare"]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])])
    key, sig, n, rare = key[new], sig[new], n[new], rare[new]
    starts, sizes = _runs(key)
    few = (sizes > 1) & (sizes <= SMALL)
    yield from _counted(PAIR, _all_pairs(starts[few], sizes[few]), sig, n, share)
    many = sizes > SMALL
    if many.any():
        at = ragged(starts[many], sizes[many])
        left = ragged(starts[many], sizes[many] - 1)
        yield from _counted(NEXT, iter([(left, left + 1)]), sig, n, share)
        band = np.floor(np.log(n[at]) / np.log(1.12)).astype(np.int64)
        order = np.lexsort((sig[at], rare[at], band, key[at]))  # the key's least rare set of a band is the same one at most keys
        firsts, count = _runs(np.cumsum(np.concatenate([[True], (key[at][order][1:] != key[at][order][:-1]) | (band[order][1:] != band[order][:-1])])))
        yield from _counted(NEXT, iter([(at[order][np.repeat(firsts, count - 1)], at[order][ragged(firsts + 1, count - 1)])]), sig, n, share)
        yield _rows(MEMBER, key[at].view(np.int64), sig[at], n[at], n[at], np.ones(len(at)))


def prefixes_met(texts: DataFrame, *, shingle: int = SHINGLE, share: float = SHARE) -> DataFrame:
    """PAIR_ROWS of all buckets."""
    frequent, buckets = _frequent(texts, shingle), 2 * partitions(texts.sparkSession)

    @tidied
    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _sets(batches, shingle):
            keys, rare = [], []
            for _, found in sets:
                last = np.isin(found, frequent, assume_unique=True) if len(frequent) else np.zeros(len(found), dtype=bool)
                keys.append(np.concatenate([found[~last], found[last]])[: int(prefix(np.int64(len(found)), share))])
                rare.append(min(len(keys[-1]), int((~last).sum())))
            sizes = [len(x) for x in keys]
            shown = np.empty(sum(sizes), dtype=SHOWN)
            shown["key"], shown["sig"], shown["n"] = np.concatenate(keys), np.repeat(np.array([s for s, _ in sets], dtype=np.int64), sizes), np.repeat([len(x) for _, x in sets], sizes)
            shown["rare"] = np.repeat(rare, sizes)
            bucket = (mix(shown["key"]) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            shown, (starts, n) = shown[order], _runs(bucket[order])
            blobs = [pack(shown[a : a + k]) for a, k in zip(starts.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][starts]), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    @tidied
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != now and held:
                    yield from _met(np.concatenate(held), share)
                    held = []
                now = bucket
                held.append(unpack(blob, SHOWN)[0])
        if held:
            yield from _met(np.concatenate(held), share)

    packed = texts.mapInArrow(show, "bucket int, blob binary").repartition("bucket").sortWithinPartitions("bucket")
    return packed.mapInArrow(meet, PAIR_ROWS)


def verified(pairs: DataFrame, texts: DataFrame, rows: DataFrame, *, shingle: int = SHINGLE, share: float = SHARE) -> DataFrame:
    """Those of the pairs (a, b) of signatures whose sets reach the share. texts: (text, row); rows: (row, sig)."""
    named = materialize(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct(), "named")
    bits = bit_filter(rows.join(named, "sig").groupBy("sig").agg(F.min("row").alias("row")), "row")  # one text of each set

    @tidied
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each set as its text, which is smaller than the set when squeezed."""
        zstd = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            some = batch.filter(pa.array(has_bit(bits.value, batch.column("row").to_numpy())))
            for part in slices(iter([some]), "text", 1 << 22):
                texts = texts_of(part, "text")
                sigs = [signature(shingles(x, shingle)) for x in texts]
                yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array([zstd.compress(x) for x in texts], pa.binary())], names=["sig", "squeezed"])

    @tidied
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd, sets = zstandard.ZstdDecompressor(), {}

        def found(sig: int, x: bytes) -> np.ndarray:
            if len(sets) > 64 and sig not in sets:
                sets.pop(next(iter(sets)))
            if sig not in sets:
                sets[sig] = shingles(zstd.decompress(x), shingle)
            return sets[sig]

        for batch in batches:
            fits = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = found(a, x), found(b, y)
                fits.append(len(np.intersect1d(x, y, assume_unique=True)) >= need(np.int64(len(x)), np.int64(len(y)), share))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(fits, pa.bool_()))

    sets = materialize(texts.mapInArrow(whole, "sig long, squeezed binary").join(named, "sig", "left_semi").dropDuplicates(["sig"]), "sets")
    left = sets.select(F.col("sig").alias("a"), F.col("squeezed").alias("x"))
    right = sets.select(F.col("sig").alias("b"), F.col("squeezed").alias("y"))
    out = materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "near")
    release(named)
    release(sets)
    return out


def links(texts: DataFrame, rows: DataFrame, candidates: DataFrame, *, shingle: int = SHINGLE, share: float = SHARE) -> DataFrame:
    """(a, b): verified links whose transitive closure is that of all pairs of different sets that reach the share.

    texts: (text, row), row being a long that tells rows apart; rows: (row, sig) with signature() of the text.
    candidates: pairs (a, b) of signatures to verify first.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    @tidied
    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, c = (x.to_numpy() for x in batch.columns)
            fits = c >= least_matches(na, nb, share)
            yield pa.RecordBatch.from_arrays([pa.array(a[fits]), pa.array(b[fits])], names=["a", "b"])

    def likely_of(met: DataFrame) -> DataFrame:
        """Pairs with as many matches as the share asks for."""
        counted = met.groupBy("a", "b").agg(F.first("na").cast("long").alias("na"), F.first("nb").cast("long").alias("nb"), F.sum("c").alias("c"))
        return counted.mapInArrow(enough, "a long, b long")

    met = materialize(prefixes_met(texts.select("text"), shingle=shingle, share=share), "met")
    beside = met.where(F.col("kind") == NEXT).select("a", "b").distinct()
    beside = likely_of(met.where(F.col("kind") == NEXT).unionByName(met.where(F.col("kind") == PAIR).join(beside, ["a", "b"], "left_semi")))
    first = beside.unionByName(candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    first = materialize(first.where("a <> b").distinct(), "first")
    near = verified(first, texts, rows, shingle=shingle, share=share)
    release(first)
    roots = materialize(components(near), "roots")

    members, cells = _crossing(met, roots, share)
    order = ["cell", "sig", "key", "root", "n", "hot", "beside", "block", "two"]
    crossing = cells.select(*order).repartition("cell").sortWithinPartitions("cell", "sig").mapInArrow(tidied(lambda batches: _across(batches, share)), PAIR_ROWS)
    likely = likely_of(met.where(F.col("kind") == PAIR).unionByName(crossing))
    for end in "ab":
        likely = likely.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left")
    likely = materialize(likely.where("coalesce(a_root, a) <> coalesce(b_root, b)").select("a", "b"), "likely")
    more = verified(likely, texts, rows, shingle=shingle, share=share)
    for done in (met, roots, members, likely):
        release(done)
    return near.unionByName(more)


def _crossing(met: DataFrame, roots: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """(members, cells): sets under frequent shingles, and those of them that can have a link to another component, in cells.

    No two sets have more matches than the frequent shingles of one and the most that it has with any set in the others.
    Who has fewer than the sizes under a shingle ask for is not needed there. Frequent shingles whose most common component
    is the same make a family; its sets stand in blocks, and each two blocks, or one with itself, meet in a cell, but for
    two of that component.
    """
    hot = met.where(F.col("kind") == MEMBER).select(F.col("a").alias("key"), F.col("b").alias("sig"), F.col("na").cast("long").alias("n"))
    few = met.where(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("c").alias("c"))
    beside = few.select(F.explode(F.array("a", "b")).alias("sig"), "c").groupBy("sig").agg(F.max("c").alias("beside"))
    known = hot.groupBy("sig").agg(F.count("*").alias("hot")).join(beside, "sig", "left").join(roots.select(F.col("node").alias("sig"), "root"), "sig", "left")
    known = known.select("sig", "hot", F.coalesce("beside", F.lit(0)).alias("beside"), F.coalesce("root", "sig").alias("root"))
    members = materialize(hot.join(known, "sig"), "members")
    mixed = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("n").alias("least"), F.max("n").alias("most")).where("low <> high")
    # need() less what is outside the prefixes, before rounding up: it falls with the distance of the sizes.
    asked = lambda other: share / (1 + share) * (F.col("n") + other) - share * F.greatest(F.col("n"), other)
    lower, upper = F.greatest(F.col("least"), share * F.col("n")), F.least(F.col("most"), F.col("n") / share)
    able = members.join(mixed.select("key", "least", "most"), "key").where(F.col("hot") + F.col("beside") >= F.least(asked(lower), asked(upper)) - 1e-6)
    able = materialize(able.select("key", "sig", "n", "root", "hot", "beside"), "able")
    big = able.groupBy("key", "root").count().groupBy("key").agg(F.sum("count").alias("all"), F.max(F.struct("count", "root")).alias("big")).where("big.count < all")
    family = F.when((F.col("all") > BLOCK) & (4 * F.col("big.count") >= F.col("all")), F.xxhash64(F.lit("root"), "big.root")).otherwise(F.xxhash64(F.lit("key"), "key"))
    placed = able.join(big.select("key", family.alias("family"), F.col("big.root").alias("big")), "key").withColumn("most", F.col("root") == F.col("big"))
    counted = placed.select("family", "sig", "most").distinct().groupBy("family").agg(F.count_if("most").alias("g"), F.count_if(~F.col("most")).alias("r"))
    ceil = lambda c: F.ceil(F.col(c) / BLOCK).cast("long")
    one = F.col("g") + F.col("r") <= BLOCK
    counted = counted.select("family", F.when(one, 0).otherwise(ceil("g")).cast("long").alias("g"), F.when(one, 1).otherwise(ceil("r")).cast("long").alias("r"))
    placed = placed.join(counted, "family").withColumn("most", F.col("most") & (F.col("g") > 0))
    placed = placed.withColumn("block", F.when(F.col("most"), F.pmod(F.xxhash64("sig"), F.greatest("g", F.lit(1)))).otherwise(F.col("g") + F.pmod(F.xxhash64("sig"), "r")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.when(F.col("most"), F.col("g")).otherwise(F.lit(0).cast("long")), F.col("g") + F.col("r") - 1)))
    cell = F.xxhash64("family", F.least("block", "other"), F.greatest("block", "other")).alias("cell")
    return members, placed.select(cell, "sig", "key", "root", "n", "hot", "beside", "block", (F.col("block") != F.col("other")).cast("long").alias("two"))


def _across(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """Pairs in one cell that have different roots, and blocks where a cell has two, with their matches there, unless those and
    all that they may have elsewhere are too few. Rows come sorted by cell and sig."""
    for columns in _whole_runs(batches):
        starts, sizes = _runs(columns[0])
        for at, size in zip(starts.tolist(), sizes.tolist()):
            _, sig, key, *_ = cell = [x[at : at + size] for x in columns]
            firsts, count = _runs(sig)
            sig, _, root, n, hot, beside, block, two = (x[firsts] for x in cell[1:])
            who, what = np.repeat(np.arange(len(firsts)), count), np.unique(key, return_inverse=True)[1]
            common = np.zeros((len(sig), len(sig)), dtype=np.float32)
            for lo in range(0, int(what.max()) + 1, 1 << 12):
                here = (what >= lo) & (what < lo + (1 << 12))
                shows = np.zeros((len(sig), min(1 << 12, int(what.max()) + 1 - lo)), dtype=np.float32)
                shows[who[here], what[here] - lo] = 1
                common += shows @ shows.T
            left, right = np.nonzero(np.triu(common, 1))
            wanted = (root[left] != root[right]) & ((two[left] == 0) | (block[left] != block[right]))
            left, right = _fit(left[wanted], right[wanted], n, share)
            c, elsewhere = common[left, right].astype(np.int64), hot - count
            enough = c + np.minimum(elsewhere[left], elsewhere[right]) + np.minimum(beside[left], beside[right]) >= least_matches(n[left], n[right], share)
            left, right, c = left[enough], right[enough], c[enough]
            if len(left):
                yield _rows(PAIR, sig[left], sig[right], n[left], n[right], c)  # sigs ascend


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by the first one, in pieces that never part a run of it."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy() for c in batch.columns]
        cut = int(np.searchsorted(now[0], now[0][-1], side="left"))
        if cut or held and held[0][0][0] != now[0][0]:
            yield [np.concatenate([*(h[k] for h in held), x[:cut]]) for k, x in enumerate(now)]
            held = []
        held.append([x[cut:] for x in now])
    if held:
        yield [np.concatenate([h[k] for h in held]) for k in range(len(held[0]))]
