"""Token counts by a linear longest-match automaton.

Greedy word pieces take the longest vocabulary entry from the left, again and again. Over the vocabulary's trie each
node has a failure link, the node to go on from when the next byte has no edge, and the number of pieces that taking
the link completes. A word's pieces are counted in one pass over its bytes, with no piece built and no byte read twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.bpe import public_path
from weftline.llm.common import slices, texts_of, tidied

CACHE_WORDS = 500_000
_loaded: dict[str, "Automaton"] = {}


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def vocabulary(path: str) -> list[bytes]:
    """The entries of a byte-level tokenizer file as bytes, without its special tokens."""
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    special = {x["content"] for x in content.get("added_tokens", [])}
    letters = byte_letters()
    return [bytes(letters[c] for c in entry) for entry in content["model"]["vocab"] if entry not in special]


class Automaton:
    """goto is the trie (node * 256 + byte), link the failure links (-1: none), popped the pieces a link completes."""

    def __init__(self, entries: Iterable[bytes]) -> None:
        self.goto: dict[int, int] = {}
        level: list[tuple[int, int, int]] = []  # parent, byte, node, in the order of depth
        ends, depth = set(), [0]
        for entry in entries:
            node = 0
            for b in entry:
                key = node * 256 + b
                if key not in self.goto:
                    self.goto[key] = len(depth)
                    level.append((node, b, len(depth)))
                    depth.append(depth[node] + 1)
                node = self.goto[key]
            ends.add(node)
        ends.discard(0)
        self.link, self.popped = [-1] * len(depth), [0] * len(depth)
        for parent, b, node in sorted(level, key=lambda x: depth[x[2]]):
            if node in ends:
                self.link[node], self.popped[node] = 0, 1
                continue
            at, pieces = self.link[parent], self.popped[parent]
            while at >= 0 and at * 256 + b not in self.goto:
                at, pieces = self.link[at], pieces + self.popped[at]
            if at >= 0:
                self.link[node], self.popped[node] = self.goto[at * 256 + b], pieces

    def count(self, word: bytes) -> int:
        """How many pieces a word has; -1 if the vocabulary cannot spell it."""
        goto, link, popped = self.goto, self.link, self.popped
        node = pieces = 0
        for b in word:
            while (then := goto.get(node * 256 + b, -1)) < 0:
                if link[node] < 0:
                    return -1
                node, pieces = link[node], pieces + popped[node]
            node = then
        while node:
            if link[node] < 0:
                return -1
            node, pieces = link[node], pieces + popped[node]
        return pieces


class _Counts(dict):
    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = n = self.automaton.count(b" " + word)
        return n


def _counts(path: str) -> _Counts:
    if path not in _loaded:
        _loaded[path] = _Counts(Automaton(vocabulary(path)))
    return _loaded[path]


def token_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """For every row of docs: doc_id, n_words, n_pieces, n_unknown, longest (the most pieces of one word).

    A word is [^\\x20\\x09-\\x0D]+ with a blank before it. A word that the vocabulary cannot spell is one piece and
    counts in n_unknown. Null and empty texts have no words; repeated rows and null ids each give a row; an empty
    table gives no rows; other columns are ignored.
    """
    path = tokenizer or public_path()
    id_type = docs.schema[doc_id].dataType.simpleString()
    names = ["n_words", "n_pieces", "n_unknown", "longest"]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _counts(path)
        for batch in slices(batches, "text", 1 << 23):
            rows = []
            for x in texts_of(batch, "text"):
                counts = [known[w] for w in x.split()]
                unknown = counts.count(-1)
                rows.append((len(counts), sum(counts) + 2 * unknown, unknown, abs(max(counts, default=0))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=["doc_id", *names])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{c} long" for c in names))
