"""Toxic passages as maximum-scoring segments of token log-odds, with extreme-value significance.

Each word is scored by the log-odds of its most specific known feature between toxic and clean documents, with an
informative Dirichlet prior from all counts: the word itself, or its first 8 to 4 letters where more letters follow.
Unknown words cost a little, so the expected score is negative. A linear scan (Ruzzo and Tompa) finds every maximal
scoring segment. The best of n random words follows an extreme-value law, P(S >= s) = 1 - exp(-K n exp(-lambda s)):
lambda comes from the scores of all words of all documents, K from the labelled clean documents. A segment is a toxic
passage where at most ``level`` as good ones are expected by chance in a text of that length. The passages count
together: with x = lambda s - log(K n) for each, the sum T of the r best has about the chance
exp(-T) T**(r-1) / (r! (r-1)!) (Karlin and Altschul), doubled for each further r that is tried. The least chance is
mapped to a probability by logistic regression on all labelled training rows.

Only the features' log-odds come from a bounded sample: the ``fit_rows`` labelled training rows with the smallest
hashes of their ids.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import least_hashed, materialize, slices, tidied

#: PRIOR: the prior's size as a share of all counts.
FIT_ROWS, MIN_Z, PRIOR, THRESHOLD, LEVEL = 20_000, 2.0, 0.05, 0.3, 0.05
#: Scores are whole quarters of a nat; DRIFT is what each word costs.
UNIT, DRIFT, LOW, HIGH = 4, 2, -12, 40
PREFIXES = (8, 7, 6, 5, 4)
EDGES = "\"'.,;:!?()[]{}<>|*#$%&-_/\\"


def features(word: str) -> list[str]:
    """A word's features, the most specific first; none if nothing but marks."""
    w = word.strip(EDGES).lower()
    return [w, *(w[:k] + "+" for k in PREFIXES if len(w) > k)] if w else []


def segments(scores: list[int]) -> list[tuple[int, int, int]]:
    """All maximal scoring segments as (start, stop, score), in order, in linear time."""
    found: list[list[int]] = []  # start, stop, sum before, sum after
    total = 0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        now = [i, i + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= now[2]:
                j -= 1
            if j < 0 or found[j][3] >= now[3]:
                found.append(now)
                break
            now = [found[j][0], now[1], found[j][2], now[3]]
            del found[j:]
    return [(a, b, after - before) for a, b, before, after in found]


class Scores(dict):
    """Words' scores by a lexicon, remembered up to a bound."""

    def __init__(self, lexicon: dict[str, int]) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        score = next((self.lexicon[f] for f in features(word) if f in self.lexicon), 0) - DRIFT
        self[word] = score
        return score


def training(doc_id: Column) -> Column:
    """Rows that labels may be learnt from."""
    return F.crc32(doc_id.cast("string")) % 4 != 2


def _labels(labels: DataFrame, doc_id: str, toxic: str) -> DataFrame:
    rows = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).alias("toxic"))
    return rows.where("doc_id is not null and toxic is not null").where(training(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))


def fit_lexicon(docs: DataFrame, marks: DataFrame, *, fit_rows: int = FIT_ROWS, min_z: float = MIN_Z, prior: float = PRIOR) -> dict[str, int]:
    """Feature -> score in units, for all features that are surely toxic: as many as the fit_rows texts give."""
    chosen = least_hashed(marks, "doc_id", fit_rows)
    rows = docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic").groupBy("text").agg(F.max("toxic").alias("toxic"))  # copies count once

    @tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 23):
            bad, good = Counter(), Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (bad if toxic else good).update({f for w in set((text or "").split()) for f in features(w)})
            names = list(bad.keys() | good.keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([bad[f] for f in names], pa.int64()), pa.array([good[f] for f in names], pa.int64())], names=["feature", "bad", "good"])

    counts = rows.mapInArrow(count, "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counts = materialize(counts, "features")
    n1, n0 = (float(x or 0) for x in counts.agg(F.sum("bad"), F.sum("good")).first())
    if not n1 or not n0:
        return {}
    alpha, whole = F.lit(prior) * (F.col("bad") + F.col("good")), prior * (n1 + n0)
    odds = F.log((F.col("bad") + alpha) / (n1 + whole - F.col("bad") - alpha)) - F.log((F.col("good") + alpha) / (n0 + whole - F.col("good") - alpha))
    z = odds / F.sqrt(1 / (F.col("bad") + alpha) + 1 / (F.col("good") + alpha))
    top = counts.select("feature", odds.alias("odds"), z.alias("z"), "bad").where(F.col("z") >= min_z).where("bad >= 3").collect()  # of fit_rows texts only
    return {r.feature: int(min(HIGH, max(LOW, round(UNIT * r.odds)))) for r in top}


def scan(docs: DataFrame, lexicon: dict[str, int], id_type: str) -> DataFrame:
    """Per document: doc_id, n_words, segments (start, stop in words, score; all maximal ones), and times (words by score)."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Scores(lexicon)
        for batch in slices(batches, "text", 1 << 23):
            out = []
            for text in batch.column(1).to_pylist():
                scores = [known[w] for w in (text or "").split()]
                found = segments(scores) if max(scores, default=0) > 0 else []
                out.append((len(scores), found, sorted(Counter(scores).items())))
            sizes, found, times = zip(*out)
            flat = np.array([x for f in found for x in f], dtype=np.int64).reshape(-1, 3)
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            parts = pa.StructArray.from_arrays([pa.array(flat[:, k].copy()) for k in range(3)], names=["start", "stop", "score"])
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), parts), pa.array(times, pa.map_(pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "segments", "times"])

    return docs.mapInArrow(run, f"doc_id {id_type}, n_words long, segments array<struct<start:long,stop:long,score:long>>, times map<int,long>")


def together(x: Column) -> Column:
    """Minus the logarithm of the least chance of the r greatest of x over all r, from x in falling order; null for none."""
    zero = F.struct(F.lit(0).alias("r"), F.lit(0.0).alias("t"), F.lit(0.0).alias("paid"), F.lit(None).cast("double").alias("most"))

    def step(was: Column, value: Column) -> Column:
        r, t = was["r"] + 1, was["t"] + value
        # log r! + log (r-1)! - r log 2, of which the first r pays nothing
        paid = was["paid"] + F.when(r > 1, F.log(r.cast("double")) + F.log(F.greatest(r - 1, F.lit(1)).cast("double")) - math.log(2)).otherwise(0.0)
        now = F.when(r == 1, t).otherwise(t - (r - 1) * F.log(F.greatest(t, F.lit(1.0))) + paid)
        return F.struct(r.alias("r"), t.alias("t"), paid.alias("paid"), F.greatest(was["most"], now).alias("most"))

    return F.aggregate(x, zero, step, lambda s: s["most"])


def decay(times: dict[int, float]) -> float:
    """The positive lambda with sum p(s) exp(lambda s) = 1; 1 / UNIT where no score is positive."""
    total = sum(times.values())
    if not total or max(times) <= 0 or sum(s * n for s, n in times.items()) >= 0:
        return 1 / UNIT
    moment = lambda x: sum(n * math.exp(x * s) for s, n in times.items()) / total
    low, high = 1e-6, 1.0
    while moment(high) < 1:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if moment(middle) < 1 else (low, middle)
    return (low + high) / 2


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y) over x by Newton's method with a weak prior; y of n in each bin are positive."""
    w = np.zeros(2)
    rows = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        gradient = rows.T @ (y - n * p) - 1e-2 * w
        hessian = (rows * (n * p * (1 - p))[:, None]).T @ rows + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def scored(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", threshold: float = THRESHOLD, level: float = LEVEL, **options) -> DataFrame:
    """For every row of docs: doc_id, held_out, score, predicted, n_words, n_segments, best, best_start, best_stop, chance, passages.

    score is the probability of a toxic label; best the best segment's score (of equals the first's), at words best_start
    to best_stop; chance the expected number of as good segments in random text of that length; passages all segments
    whose own chance is at most level, in text order, as (start, stop, score, chance); n_segments counts all maximal
    segments. Labels of rows whose crc32(doc_id) mod 4 is 2 are never read into the model; nothing but the text enters
    a score. Null and empty texts have no segment. A row with a null id is scored and counts as not held out; a document
    labelled twice counts as toxic if either label says so. Without labels of both kinds every score is the share of
    toxic ones (0 without any). Empty tables give no rows; other columns are ignored.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    marks = _labels(labels, doc_id, toxic)
    found = materialize(scan(slim, fit_lexicon(slim, marks, **options), id_type), "segments")
    # of equal scores the first: the greatest of (score, -start)
    best = F.array_max(F.transform("segments", lambda s: F.struct(s["score"].alias("score"), (-s["start"]).alias("back"), s["stop"].alias("stop"))))
    found = found.withColumns({"n_segments": F.size("segments").cast("long"), **{n: F.coalesce(c, F.lit(0)).cast("long") for n, c in (("best", best["score"]), ("best_start", -best["back"]), ("best_stop", best["stop"]))}})
    times = {r["key"]: float(r["n"]) for r in found.select(F.explode("times")).groupBy("key").agg(F.sum("value").alias("n")).collect()}
    rate = decay(times)
    labelled = found.join(marks, "doc_id")
    clean = labelled.where("toxic = 0").agg(F.count("*"), F.sum((F.col("n_words") + 1) * F.exp(-rate * F.col("best")))).first()
    k = clean[0] / clean[1] if clean[0] else 1.0
    logs = F.log(F.lit(k) * (F.col("n_words") + 1))
    surely = F.lit(rate) * F.col("best") - logs
    chance = F.exp(-surely)
    passages = F.filter(F.transform("segments", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["score"].alias("score"), F.exp(logs - F.lit(rate) * s["score"]).alias("chance"))), lambda s: s["chance"] <= level)
    # minus the logarithm of P(S >= best), which is 1 where no segment scores
    alone = F.when(F.col("best") == 0, F.lit(0.0)).when(surely > 15, surely).otherwise(-F.log(-F.expm1(-chance)))
    found = found.withColumns({"chance": chance, "alone": alone, "passages": passages})
    found = found.withColumn("strength", F.greatest("alone", together(F.sort_array(F.transform("passages", lambda s: F.lit(rate) * s["score"] - logs), asc=False))))
    labelled, strength = found.join(marks, "doc_id"), F.col("strength")
    bins = labelled.groupBy(F.round(strength, 1).alias("x")).agg(F.sum("toxic").alias("y"), F.count("*").alias("n")).collect()
    x, y, n = (np.array([float(r[c]) for r in bins]) for c in ("x", "y", "n"))
    if y.sum() and (n - y).sum():
        slope, offset = logistic(x, y, n)
    else:
        share = y.sum() / n.sum() if n.sum() else 0.0
        slope, offset = 0.0, math.log(share / (1 - share)) if 0 < share < 1 else (-30.0 if share <= 0 else 30.0)
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(slope) * strength + offset))))
    return found.select(
        "doc_id", F.coalesce(~training(F.col("doc_id")), F.lit(False)).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"),
        "n_words", "n_segments", "best", "best_start", "best_stop", "chance", "passages",
    )
