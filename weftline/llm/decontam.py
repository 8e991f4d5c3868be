"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Words are lower-cased. A fixed mask selects some of the words of a short stretch; the hash of the selected words is
a seed, so words at the ignored places may differ. Seeds of the documents are joined with seeds of the benchmark.
Around each hit the two word sequences are compared on their common diagonal: the pair counts if some window of
``window`` words (the whole item where that is shorter) holds the seed's stretch and agrees in ``similarity`` of its
places. The two default masks are lossless for that rule: any 13 words with at most 2 substitutions hold a seed.

An item shorter than the window has masks of its own length: with s substitutions allowed, every (s+1)-th of its words
from each of the first s + 1 on. One of these holds no substitution, so they are lossless too, down to one word.

Seeds carry no words, only which row they are of. If there are at most ``broadcast_seeds`` seeds of the benchmark (some
40 bytes each) and at most ``broadcast_words`` words in its items (8 bytes each), both counted first, seeds and then
items' words are broadcast. Beyond either the seeds are joined by a shuffle, the hits of a document and an item brought
together, and the words of both fetched once a pair; this gives the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import free_name

#: Selected places of each mask; weight 6, spans 7 and 9.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 7, 8))
WINDOW, SIMILARITY = 13, 0.8
BROADCAST_SEEDS, BROADCAST_WORDS = 2_000_000, 8_000_000
BLANKS = " \t\n\x0b\x0c\r"


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words [^\\x20\\x09-\\x0D]+ of a text; one of no word at all where there are none."""
    trimmed = F.call_function("btrim", F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS))
    return F.transform(F.split(trimmed, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))


def has_words(text: Column) -> Column:
    return F.call_function("btrim", F.coalesce(text, F.lit("")), F.lit(BLANKS)) != ""


def needed(length: int, similarity: float) -> int:
    """How many of a window's places have to agree."""
    return math.ceil(similarity * length - 1e-9)


def short_masks(length: int, similarity: float) -> list[tuple[int, ...]]:
    """An item's places in classes, one of which agrees as a whole in every overlap that counts."""
    step = length - needed(length, similarity) + 1
    return [tuple(range(first, length, step)) for first in range(min(step, length))]


def _seeds(df: DataFrame, words: str, keep: list[str], masks=MASKS) -> DataFrame:
    """One row per place and mask: keep, pos, seed. Places where the mask would leave the text make none."""
    placed = df.select(*keep, words, F.posexplode(F.sequence(F.lit(0), F.size(words) - 1)).alias("pos", "_at"))
    n = F.size(words)
    seeds = [
        F.when(F.col("pos") + (m[-1] + 1) <= n, F.xxhash64(F.lit(k), *[F.get(F.col(words), F.col("pos") + o) for o in m])) for k, m in enumerate(masks)
    ]
    return placed.select(*keep, words, "pos", F.posexplode(F.array(*seeds)).alias("mask", "seed")).where("seed is not null")


def _short_seeds(items: DataFrame, lengths: list[int], masks: list[tuple[int, ...]], similarity: float) -> DataFrame:
    """One row per short item and mask: item_row, item_pos, mask, seed."""
    rows = F.array().cast("array<struct<item_pos:int,mask:int,seed:bigint>>")
    for n in lengths:
        seeds = []
        for places in short_masks(n, similarity):
            k = masks.index(tuple(x - places[0] for x in places))
            seeds.append(F.struct(F.lit(places[0]).alias("item_pos"), F.lit(k).alias("mask"), F.xxhash64(F.lit(k), *[F.get("item_words", F.lit(x)) for x in places]).alias("seed")))
        rows = F.when(F.size("item_words") == n, F.array(*seeds)).otherwise(rows)
    return items.select("item_row", F.explode(rows).alias("s")).select("item_row", "s.*")


def _verify(window: int, similarity: float, spans: list[int], pos: Column, item_pos: Column, mask: Column) -> Column:
    """The best agreement of a window that holds the hit, as (agreeing places, first item word), null if too low."""
    span = F.element_at(F.array(*[F.lit(s) for s in spans]), mask + 1)
    n, d = F.size("item_words"), pos - item_pos
    length = F.least(F.lit(window), n)
    first = F.greatest(F.lit(0), -d, item_pos + span - length)
    last = F.least(n, F.size("words") - d) - length
    last = F.least(last, item_pos)
    agree = lambda s: F.size(F.filter(F.sequence(s, s + length - 1), lambda k: F.get("item_words", k) == F.get("words", k + d)))
    every = F.when(first <= last, F.transform(F.sequence(first, last), lambda s: F.struct(agree(s).alias("agree"), (-s).alias("back"))))
    best = F.array_max(every)
    return F.when(best["agree"] >= F.ceil(F.lit(similarity) * length - 1e-9), best)


def _row(doc_id: Column, words: Column) -> Column:
    return F.xxhash64(doc_id, words)


def _matches(
    docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    masks=MASKS, window: int = WINDOW, similarity: float = SIMILARITY, broadcast_seeds: int = BROADCAST_SEEDS, broadcast_words: int = BROADCAST_WORDS,
) -> DataFrame:
    """doc_id, row, item_id, top: the best window of each row of docs and item that overlap; see contaminated()."""
    items = benchmark.where(F.col(item_id).isNotNull() & has_words(F.col(item_text))).select(F.col(item_id).alias("item_id"), word_hashes(F.col(item_text)).alias("item_words")).distinct()
    items = items.withColumn("item_row", _row(F.col("item_id"), F.col("item_words")))
    left = docs.where(F.col(doc_id).isNotNull() & has_words(F.col(text))).select(F.col(doc_id).alias("doc_id"), word_hashes(F.col(text)).alias("words"))
    left = left.withColumn("row", _row(F.col("doc_id"), F.col("words")))  # once a document, before its places are laid out
    lengths = sorted(r[0] for r in items.select(F.size("item_words")).where(F.size("item_words") < window).distinct().collect())  # fewer than window values
    own = {tuple(x - m[0] for x in m) for n in lengths for m in short_masks(n, similarity)}
    every = [*masks, *sorted(own - set(masks))]
    spans = [m[-1] + 1 for m in every]
    places = _seeds(items.where(F.size("item_words") >= window), "item_words", ["item_row"], masks).select("item_row", F.col("pos").alias("item_pos"), "mask", "seed")
    if lengths:
        places = places.unionByName(_short_seeds(items, lengths, every, similarity))
    found, length = _seeds(left, "words", ["doc_id", "row"], every), F.least(F.lit(window), F.size("item_words")).alias("length")
    small = places.limit(broadcast_seeds + 1).count() <= broadcast_seeds and (items.agg(F.sum(F.size("item_words"))).first()[0] or 0) <= broadcast_words
    if small:
        hits = found.join(F.broadcast(places), ["mask", "seed"]).join(F.broadcast(items), "item_row")
        # The verdict is filtered after the aggregation: a filter here would become part of the join's condition, and the
        # join, no longer compiled, would copy the words of a document for each of its places.
        verdict = _verify(window, similarity, spans, F.col("pos"), F.col("item_pos"), F.col("mask"))
        checked = hits.select("doc_id", "row", "item_id", length, (F.col("pos") - F.col("item_pos")).alias("diagonal"), verdict.alias("best"))
    else:
        met = found.select("row", "pos", "mask", "seed").join(places, ["mask", "seed"])
        pairs = met.groupBy("row", "item_row").agg(F.collect_set(F.struct("pos", "item_pos", "mask")).alias("hits"))
        both = pairs.join(left.distinct(), "row").join(items, "item_row")
        judged = F.transform("hits", lambda h: F.struct((h["pos"] - h["item_pos"]).alias("diagonal"), _verify(window, similarity, spans, h["pos"], h["item_pos"], h["mask"]).alias("best")))
        checked = both.select("doc_id", "row", "item_id", length, F.explode(judged).alias("j")).select("doc_id", "row", "item_id", "length", "j.*")
    order = F.when(F.col("best").isNotNull(), F.struct(F.col("best.agree"), (F.col("best.back") - F.col("diagonal")).alias("doc_back"), F.col("best.back").alias("item_back"), "length"))
    return checked.groupBy("doc_id", "row", "item_id").agg(F.max(order).alias("top")).where("top is not null")


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Pairs of a document and a benchmark item that overlap: doc_id, item_id, matched_words, window_words, doc_start, item_start.

    matched_words is the best window's agreeing places; doc_start and item_start are where the best window begins (of
    several, the one earliest in the document, then in the item; of rows that share the item's id, the longest window).
    A pair has one row. Texts without words match nothing; an item of any length matches, however short; rows with a
    null id are left out; rows that repeat an id are looked at one by one; empty tables give no rows. Other columns of
    either table are ignored. Options: doc_id, text, item_id, item_text (columns), masks, window, similarity,
    broadcast_seeds, broadcast_words. masks have to suit items of window words and more; shorter ones have short_masks().
    """
    top = _matches(docs, benchmark, **options).groupBy("doc_id", "item_id").agg(F.max("top").alias("top"))
    return top.select(
        "doc_id", "item_id", F.col("top.agree").alias("matched_words"), F.col("top.length").alias("window_words"), (-F.col("top.doc_back")).alias("doc_start"), (-F.col("top.item_back")).alias("item_start"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that overlap with no benchmark item, with all their columns.

    Each row is judged by its own text, also where rows share an id. Rows with a null id, null and empty texts stay;
    repeated rows stay or go together; an empty benchmark drops nothing; columns may have any names.
    """
    name = free_name(docs.columns, "_row")
    own = _row(docs[options.get("doc_id", "doc_id")], word_hashes(docs[options.get("text", "text")]))
    bad = _matches(docs, benchmark, **options).select(F.col("row").alias(name)).distinct()
    return docs.join(bad, own == bad[name], "left_anti")
