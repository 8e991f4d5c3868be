"""Quality rules: an isolation forest over each document's rule statistics.

Trees cut the box that holds the sample at random, again and again, until a cell holds one good row or none; rows
that few cuts part from the good ones are anomalous. The forest is grown on a bounded sample of the labelled rows
(``fit_rows``, those with the smallest hashes of their ids): all of them span the box, the good ones fill the cells.
Every row is scored, and the threshold is calibrated on all labelled rows that pass the base rules: of the thresholds
that reject at most ``max_false`` of the good ones, the one that rejects most of the bad ones.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import least_hashed, materialize, slices, texts_of, tidied

TREES, TREE_ROWS, FIT_ROWS, MAX_FALSE, BINS, SEED = 100, 256, 25_600, 0.002, 10_000, 42
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
STATS = ", ".join(f"{c} long" for c in COUNTS)


def statistics(text: bytes) -> tuple[int, ...]:
    """COUNTS of a text: words, code points in words, symbols, lines equal to an earlier one, words in repeated 3-word
    windows, lines with a word, words in capitals, exclamation marks."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = len(b"".join(words).decode())
    repeat, n = 0, len(words)
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        inside = 0  # the first place past the windows counted so far
        for i, x in enumerate(windows):
            if times[x] > 1:
                repeat += i + 3 - max(i, inside)
                inside = i + 3
    return n, chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat, len(lines), sum(map(bytes.isupper, words)), text.count(b"!")


def features(counts: np.ndarray) -> np.ndarray:
    """What the forest sees of rows of COUNTS: shares, so that length alone is no anomaly, on a log scale."""
    n = np.maximum(counts[:, 0], 1)
    shares = np.stack([counts[:, 2] / n, counts[:, 3] / np.maximum(counts[:, 5], 1), counts[:, 4] / n, counts[:, 6] / n, counts[:, 7] / n], axis=1)
    return np.column_stack([counts[:, 1] / n, np.log2(1 + 64 * shares)])


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])


def _average_path(n: int | float) -> float:
    return 0.0 if n < 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


class Forest(NamedTuple):
    """Trees as arrays over nodes: feature (-1: leaf), cut, left child (right is the next), path length at a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    scale: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for rows that few splits isolate."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                f = self.feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] >= self.cut[node]
                node = np.where(inner, self.left[node] + right, node)
            total += self.path[node]
        return np.exp2(-total / (len(self.roots) * self.scale)) if len(self.roots) else np.zeros(len(x))


def grow(x: np.ndarray, box: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
    """A forest over rows x inside the box that rows box span; each tree takes tree_rows of x at random."""
    rng = np.random.default_rng(seed)
    size = min(tree_rows, len(x))
    depth = math.ceil(math.log2(max(size, 2))) + x.shape[1]
    feature, cut, left, path, roots = [], [], [], [], []

    def node() -> int:
        for column, value in ((feature, -1), (cut, 0.0), (left, 0), (path, 0.0)):
            column.append(value)
        return len(feature) - 1

    for _ in range(trees if size > 1 else 0):
        roots.append(node())
        todo = [(roots[-1], x[rng.choice(len(x), size, replace=False)], box.min(axis=0), box.max(axis=0), 0)]
        while todo:
            k, rows, low, high, level = todo.pop()
            able = np.flatnonzero(high > low)
            if level >= depth or not len(able) or len(rows) < 2:
                path[k] = level + _average_path(len(rows))
                continue
            f = int(rng.choice(able))
            c = float(rng.uniform(low[f], high[f]))
            right = rows[:, f] >= c
            feature[k], cut[k], left[k] = f, c, node()
            node()
            middle = [high.copy(), low.copy()]
            middle[0][f] = middle[1][f] = c
            todo += [(left[k], rows[~right], low, middle[0], level + 1), (left[k] + 1, rows[right], middle[1], high, level + 1)]
    return Forest(np.array(feature, dtype=int), np.array(cut), np.array(left, dtype=int), np.array(path), np.array(roots, dtype=int), _average_path(size) or 1.0)


def rule_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and COUNTS for every row."""
    id_type = docs.schema[doc_id].dataType.simpleString()

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 22):
            counts = np.array([statistics(x) for x in texts_of(batch, "text")], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts.T)], names=["doc_id", *COUNTS])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {id_type}, {STATS}")


class Model(NamedTuple):
    forest: Forest
    threshold: float

    def judge(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(base_failed, anomaly, kept) of rows of COUNTS."""
        failed, anomaly = base_failed(counts), self.forest.score(features(counts))
        return failed, anomaly, ~failed & (np.floor(anomaly * BINS) < self.threshold)


def _scored(stats: DataFrame, model: Model) -> DataFrame:
    id_type = stats.schema["doc_id"].dataType.simpleString()

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.stack([batch.column(k + 1).to_numpy() for k in range(len(COUNTS))], axis=1)
            failed, anomaly, kept = model.judge(counts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(failed), pa.array(anomaly), pa.array(kept)], names=["doc_id", *COUNTS, "base_failed", "anomaly", "kept"])

    return stats.mapInArrow(run, f"doc_id {id_type}, {STATS}, base_failed boolean, anomaly double, kept boolean")


def fit(stats: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", quality: str = "quality", fit_rows: int = FIT_ROWS, trees: int = TREES, tree_rows: int = TREE_ROWS, max_false: float = MAX_FALSE, seed: int = SEED) -> Model:
    """Grow the forest and calibrate its threshold. Without labelled rows nothing is rejected beyond the base rules."""
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(quality).alias("_quality")).where("doc_id is not null and _quality is not null").groupBy("doc_id").agg(F.min("_quality").alias("_quality"))
    labelled = stats.join(marks, "doc_id")
    sample = least_hashed(labelled, "doc_id", fit_rows, *COUNTS).select(*COUNTS, (F.col("_quality") > 0).cast("long")).toPandas().to_numpy(dtype=np.int64)
    seen = features(sample[:, :-1])
    forest = grow(seen[(sample[:, -1] > 0) & ~base_failed(sample)], seen, trees, tree_rows, seed)
    seen = _scored(stats, Model(forest, math.inf)).where("not base_failed").join(marks, "doc_id")
    counts = seen.groupBy(F.floor(F.col("anomaly") * BINS).alias("bin"), (F.col("_quality") > 0).alias("good")).count().collect()
    good, bad = np.zeros(BINS + 2), np.zeros(BINS + 2)
    for r in counts:
        (good if r["good"] else bad)[r["bin"]] += r["count"]
    above_good, above_bad = np.cumsum(good[::-1])[::-1], np.cumsum(bad[::-1])[::-1]
    able = above_good <= max_false * max(good.sum(), 1)
    gain = np.where(able, above_bad, -1)
    best = int(len(gain) - 1 - np.argmax(gain[::-1]))  # of equal gains the highest threshold
    return Model(forest, float(best) if bad.sum() else math.inf)


def judged(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """For every row of docs: doc_id, COUNTS, base_failed, anomaly, kept.

    Null and empty texts have no words and fail the base rules. Rows with a null id are judged but never labelled;
    repeated rows each get a row; a document labelled twice counts as its lower label. Empty tables give no rows or no
    labels; other columns are ignored.
    """
    stats = materialize(rule_statistics(docs, doc_id, text), "stats")
    return _scored(stats, fit(stats, labels, **options))


def keep_good(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that judged() keeps, with all their columns; the text is read twice and never shuffled."""
    model = fit(materialize(rule_statistics(docs, doc_id, text), "stats"), labels, **options)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 1 << 22):
            counts = np.array([statistics(x) for x in texts_of(batch, text)], dtype=np.int64)
            yield batch.filter(pa.array(model.judge(counts)[2]))

    return docs.mapInArrow(run, docs.schema)
