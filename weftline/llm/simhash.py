"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ in at most 2 of 64 bits are linked. Cut into 2 halves of 32 bits, one half differs in at most
one bit. Each half is indexed under its 32 one-wildcard variants (the half with one bit blanked, and which one), so
linked fingerprints share a variant. Equal variants are brought together by a sort, and every pair in a bucket is
verified, but only the links of a spanning forest leave the task, never all pairs of a group.

A bucket of more than ``bucket_rows`` fingerprints is not verified in one task. Its members go out again under
two-wildcard keys of the whole fingerprint: one bit blanked in each half, or two in the other half. Such a key is a
proof of the link and holds at most 4 fingerprints, so the bucket spreads over all tasks with nothing left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import jaccard
from weftline.llm.common import bit_filter, free_name, materialize, release, sifted, slices, texts_of, tidied
from weftline.llm.components import components

SHINGLE, SEED, BUCKET_ROWS = 3, 42, 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is set in more than half of the shingles' XXH64; no words: zero."""
    words = text.lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    return majority(jaccard.hashes(words, shingle))


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in more than half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[lo : lo + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""
    id_type = docs.schema[doc_id].dataType.simpleString()

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 22):
            fps = np.array([fingerprint(x, shingle) for x in texts_of(batch, "text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, fp long")


def _forest(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints, found by breadth first search."""
    left = fps[1:].copy()
    frontier, a, b = [fps[0]], [], []
    while len(left):
        if not frontier:
            frontier, left = [left[0]], left[1:]
            continue
        x = frontier.pop()
        near = np.bitwise_count(left ^ x) <= bits
        if near.any():
            got = left[near]
            a.append(np.full(len(got), x))
            b.append(got)
            frontier.extend(got)
            left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def _links(keys: np.ndarray, fps: np.ndarray, bits: int, bucket_rows: int) -> tuple[list, list]:
    """Links within each run of equal keys, and (key, fps) of the runs that are too long for one task."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    links, hot = [], []
    two = starts[sizes == 2]
    near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= bits
    links.append((fps[two][near], fps[two + 1][near]))
    for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
        if n > bucket_rows:
            hot.append((keys[s], fps[s : s + n]))
        else:
            links.append(_forest(fps[s : s + n], bits))
    return links, hot


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted (key, fp) rows in pieces that never part a run of equal keys."""
    key, fp = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.concatenate([key, batch.column(0).to_numpy()])
        fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
        cut = int(np.searchsorted(key, key[-1], side="left"))
        if cut:
            yield key[:cut], fp[:cut]
            key, fp = key[cut:], fp[cut:]
    if len(key):
        yield key, fp


def links(prints: DataFrame, *, bits: int = 2, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b) pairs of distinct fingerprints whose transitive closure is that of all pairs within 2 bits.

    prints: one row per distinct fingerprint, column fp. bits: 0 to 2, what the two halves can prove.
    """
    if not 0 <= bits <= 2:
        raise ValueError("two one-wildcard halves prove differences of at most 2 bits")
    half = F.when(F.col("v") < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    masked = half.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, v % 32)")))
    variants = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v")).select((F.col("v").cast("long") * (1 << 32) + masked).alias("key"), "fp")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in _runs(batches):
            found, hot = _links(key, fp, bits, bucket_rows)
            kinds = [np.full(len(a), -1) for a, _ in found] + [np.full(len(x), k >> 32) for k, x in hot]
            a = np.concatenate([x[0] for x in found] + [x for _, x in hot]).view(np.int64)
            b = np.concatenate([x[1] for x in found] + [x for _, x in hot]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds).astype(np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

    placed = variants.repartition("key").sortWithinPartitions("key")
    found = materialize(placed.mapInArrow(run, "kind int, a long, b long"), "links")
    out = found.where("kind < 0").select("a", "b")
    if not found.where("kind >= 0").limit(1).count():
        return out
    # kind is the variant v: bit v % 32 of half v // 32 is blank. All pairs of such a bucket differ there or in the other half only.
    bit = "shiftleft(1L, case when kind < 32 then kind % 32 + 32 else kind % 32 end)"
    other = "case when kind < 32 then {0} else {0} + 32 end"
    one = found.where("kind >= 0").select("kind", F.col("a").alias("fp"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("j"))
    one = one.select("fp", F.expr(f"{bit} | shiftleft(1L, {other.format('j')})").alias("blank"))
    two = found.where("kind >= 0 and kind % 32 = 0").select("kind", F.col("a").alias("fp"), F.explode(F.sequence(F.lit(0), F.lit(1023))).alias("p")).where("p div 32 < p % 32")
    two = two.select("fp", F.expr(f"shiftleft(1L, {other.format('cast(p div 32 as int)')}) | shiftleft(1L, {other.format('p % 32')})").alias("blank"))
    keyed = one.unionByName(two).withColumn("rest", F.expr("fp & ~blank"))
    least = keyed.groupBy("blank", "rest").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"))  # at most 4 fingerprints each
    # bits < 2 would need a check here; the pairs of a key differ in its two blank bits at most.
    more = least.select("a", F.explode("all").alias("b")).where("a <> b")
    return out.unionByName(more.where(F.bit_count(F.expr("a ^ b")) <= bits))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = 2, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs: component_id is the smallest doc_id reachable by links.

    Documents with equal fingerprints are linked, so exact copies cost one row. Null and empty texts have fingerprint
    zero and link like any other. A row with a null id gets the component of its fingerprint, and lends it no id (the
    component is null if no row of it has an id). Repeated rows each return a row. An empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, doc_id, text, shingle), "prints")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(prints.select("fp"), bits=bits, bucket_rows=bucket_rows))
    placed = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    first = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(first, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def _described(texts: DataFrame, shingle: int) -> DataFrame:
    """(row, sig, fp) of (row, text): the set of shingles' signature (jaccard.signature) and the fingerprint."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 22):
            found = [jaccard.hashes(x.lower().split(), shingle) for x in texts_of(batch, "text")]
            sigs = [jaccard.signature(np.unique(x)) for x in found]
            fps = np.array([majority(x) for x in found], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.int64()), pa.array(fps)], names=["row", "sig", "fp"])

    return texts.select("row", "text").mapInArrow(run, "row long, sig long, fp long")


def near_links(texts: DataFrame, rows: DataFrame, *, shingle: int = jaccard.SHINGLE, share: float = jaccard.SHARE, bits: int = 2, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): links between signatures of sets of shingles whose Jaccard similarity is share or more.

    The fingerprints' links are the first candidates; as 64 bits do not tell such a similarity, prefix filtering finds
    what they miss. All links are verified on the whole sets.
    """
    prints = materialize(rows.groupBy("fp").agg(F.min("sig").alias("least")), "distinct")
    same = rows.select("fp", "sig").distinct().join(prints, "fp").where("sig <> least").select(F.col("least").alias("a"), F.col("sig").alias("b"))
    found = links(prints.select("fp"), bits=bits, bucket_rows=bucket_rows)
    for end in "ab":
        found = found.join(prints.select(F.col("fp").alias(end), F.col("least").alias(f"{end}_sig")), end)
    candidates = materialize(found.select(F.col("a_sig").alias("a"), F.col("b_sig").alias("b")).unionByName(same), "candidates")
    out = jaccard.links(texts, rows, candidates, shingle=shingle, share=share)
    release(prints)
    release(candidates)
    return out


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each group of near copies (near_links(), sets of equal shingles included), with all its columns: the one
    with the smallest doc_id, of several the one whose text has the smallest hash; a null id counts as the largest.

    Texts without words are copies of each other; a text of fewer words than a shingle is one shingle. Of rows that
    repeat id and text, one stays. A row of its own group stays, whatever its id. An empty table gives no rows.
    """
    name, mark = free_name(docs.columns, "_row"), free_name(docs.columns, "_stays")
    key = F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("\0")), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    texts = docs.select(key.alias("row"), F.col(text).cast("string").alias("text"))
    ids = docs.select(key.alias("row"), F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("sum")).groupBy("row").agg(F.min("id").alias("id"), F.min("sum").alias("sum"), F.count("*").alias("times"))
    rows = materialize(_described(texts, options.get("shingle", jaccard.SHINGLE)), "rows")
    near = near_links(texts, rows, **options)
    roots = components(near)
    release(near)
    groups = rows.select("row", "sig").distinct().join(roots, rows["sig"] == roots["node"], "left").select("row", F.coalesce("root", "sig").alias("root"))
    order = F.struct(F.col("id").isNull(), "id", "sum", "row")
    placed = materialize(groups.join(ids, "row").select("row", "root", "times", order.alias("order")), "placed")
    best = placed.groupBy("root").agg(F.min("order").alias("best"))
    fate = placed.join(best, "root").select("row", "times", (F.col("order") == F.col("best")).alias("stays")).where("not stays or times > 1")
    fate = materialize(fate.select("row", "stays"), "fate")
    release(rows)
    release(placed)
    bits, keyed = bit_filter(fate, "row"), docs.withColumn(name, key)
    sure = sifted(keyed, name, bits, False).drop(name)  # these need no shuffle
    unsure = sifted(keyed, name, bits, True).join(fate.select(F.col("row").alias(name), F.col("stays").alias(mark)), name, "left")
    others = unsure.where(F.col(mark).isNull()).drop(name, mark)
    repeats = unsure.where(F.col(mark)).dropDuplicates([name]).drop(name, mark)
    return sure.unionByName(others).unionByName(repeats)
