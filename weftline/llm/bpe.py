"""Byte-level BPE ids by the tokenizers library, with the ids of repeated words kept in a bounded cache.

Byte-level BPE first cuts a text into pieces (a word with its leading space, a run of punctuation, white space) and
merges inside a piece only. units_of() cuts at places that are always such borders, so the ids of a text are the ids
of its units in a row, and each distinct unit goes through the library once. It works on the bytes of many texts at a
time; texts with white space outside ASCII, or with the strings of special tokens (units of their own, as in the
library's defaults), are cut by a pattern. All this holds for one kind of tokenizer file; with any other kind (a
normaliser, another pre-tokeniser, a leading space, tokens that strip blanks) whole texts go to the library.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain, groupby

import numpy as np
import pyarrow as pa

from weftline.llm.common import memories, ragged

#: Unicode white space, and what of it is not ASCII.
_FAR_WS = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WS = "\t-\r " + _FAR_WS
_FAR = re.compile(f"[{_FAR_WS}]")
#: A run without white space, with the one space before it; white space but for the last before such a run; white space.
_UNITS = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Units that go through the library in one text; a newline between two of them is always a piece of its own.
_JOINED = re.compile(rf" ?[^{_WS}]+")
#: Bytes: white space; letters; marks that never share a piece with a letter before them.
_SPACE, _LETTER, _MARK = (np.isin(np.arange(256), np.frombuffer(x, dtype=np.uint8)) for x in (b"\t\n\x0b\x0c\r ", bytes(range(65, 91)) + bytes(range(97, 123)), b".,;:!?|"))
END_ID, CACHE_UNITS, JOIN = 0, 400_000, 1000
_loaded: dict[str, "Encoder"] = {}


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts_at_units(file: dict) -> bool:
    """Whether a tokenizer file's settings are those that _UNITS is right for."""
    before, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space", True) and before.get("use_regex", True)
    whole = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    tokens = all(not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in file.get("added_tokens") or [])
    return plain and whole and tokens and all(file.get(k) is None for k in ("normalizer", "truncation", "padding"))


def units_of(data: np.ndarray, sizes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The units of texts that follow each other in data, no white space of which is outside ASCII, and how many each has.

    A run of white space parts from what is before it; its last character parts from the rest of it where another run
    follows, and goes with that run if it is a space. A mark parts from a letter before it.
    """
    n, full = len(data), sizes > 0
    stops = np.cumsum(sizes)
    first = np.zeros(n + 1, dtype=bool)
    first[(stops - sizes)[full]] = first[n] = True
    space = _SPACE[data]
    begins = first.copy()
    begins[1:n] |= space[1:] & (~space[:-1] | (~np.append(space[2:], True) & ~first[2:]))
    begins[1:n] |= ~space[1:] & space[:-1] & (data[:-1] != 32)
    begins[1:n] |= _MARK[data[1:]] & _LETTER[data[:-1]]
    at = np.flatnonzero(begins)
    units = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))
    before = np.searchsorted(at, np.concatenate([[0], stops]))
    return units, np.diff(before)


class _Units(dict):
    """Unit -> number; numbers are given as units are first asked for, which fresh then lists."""

    def __init__(self) -> None:
        super().__init__({None: 0})
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        self.fresh.append(unit)
        self[unit] = k = len(self)
        return k


class Encoder:
    """Ids of whole texts, each followed by the end id."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache_units = Tokenizer.from_file(path), CACHE_UNITS
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.by_units = cuts_at_units(file)
        self.special = sorted((t["content"] for t in file.get("added_tokens") or []), key=len, reverse=True)
        self.bytes = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=np.int64)  # of each token: a letter stands for one
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = len(token)
        self._clear()

    def _clear(self) -> None:
        self.units = _Units()
        self.flat, self.used = np.full(1 << 16, END_ID, dtype="<u4"), 1
        self.start, self.size = np.zeros(1 << 12, dtype=np.int64), np.ones(1 << 12, dtype=np.int64)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, how many each text has) from the library."""
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(ids)), dtype="<u4"), np.array([len(x) for x in ids], dtype=np.int64)

    def _joined(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """_library() of units that _JOINED describes, JOIN of them in a text."""
        texts = ["\n".join(units[k : k + JOIN]) for k in range(0, len(units), JOIN)]
        ids, sizes, lo = [], [], 0
        for text, x in zip(texts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            got = np.array(x.ids, dtype="<u4")
            ends = np.cumsum(self.bytes[got])
            breaks = np.flatnonzero(np.frombuffer(text.encode(), dtype=np.uint8) == 10)
            at = np.searchsorted(ends, breaks + 1)  # the newlines' own ids
            n = min(JOIN, len(units) - lo)
            if len(at) == n - 1 and (ends[at] == breaks + 1).all() and (self.bytes[got[at]] == 1).all():
                sizes.append(np.diff(np.concatenate([[-1], at, [len(got)]])) - 1)
                ids.append(np.delete(got, at))
            else:  # not expected; the units by themselves
                a, b = self._library(units[lo : lo + n])
                ids.append(a)
                sizes.append(b)
            lo += n
        return np.concatenate(ids), np.concatenate(sizes)

    def _add(self, units: list[str]) -> None:
        """Ids of the units that _Units has just numbered, in that order."""
        can = np.fromiter((_JOINED.fullmatch(u) is not None and u not in self.special for u in units), dtype=bool, count=len(units))
        sizes, parts = np.zeros(len(units), dtype=np.int64), []
        for chosen, encoded in ((np.flatnonzero(can), self._joined), (np.flatnonzero(~can), self._library)):
            if len(chosen):
                ids, sizes[chosen] = encoded([units[i] for i in chosen.tolist()])
                parts.append((chosen, ids))
        have, total = len(self.units) - len(units), int(sizes.sum())
        while have + len(units) > len(self.start):
            self.start, self.size = np.concatenate([self.start, self.start]), np.concatenate([self.size, self.size])
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        for chosen, ids in parts:
            self.flat[self.used : self.used + len(ids)] = ids
            self.size[have + chosen] = sizes[chosen]
            self.start[have + chosen] = self.used + np.cumsum(sizes[chosen]) - sizes[chosen]
            self.used += len(ids)

    def _odd(self, text: str) -> bool:
        return not text.isascii() and _FAR.search(text) is not None or any(x in text for x in self.special)

    def _cut(self, text: str) -> list[str]:
        parts = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) if self.special else [text]
        return [u for k, x in enumerate(parts) for u in ([x] if k % 2 else _UNITS.findall(x))]

    def _numbers(self, texts: list[str]) -> np.ndarray:
        """The numbers of texts' units in a row, 0 after each text; none of them is odd."""
        raw = [x.encode() for x in texts]
        data, sizes = np.frombuffer(b"".join(raw), dtype=np.uint8), np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        if not len(data):
            return np.zeros(len(texts), dtype=np.int64)
        units, counts = units_of(data, sizes)
        coded = units.dictionary_encode()
        number = np.fromiter(map(self.units.__getitem__, coded.dictionary.to_pylist()), dtype=np.int64, count=len(coded.dictionary))
        return np.insert(number[coded.indices.to_numpy()], np.cumsum(counts), 0)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each has); null is empty, and every text ends in the end id."""
        if not len(texts):
            return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        texts = [x or "" for x in texts]
        if not self.by_units:
            ids, counts = self._library(texts)
            return np.insert(ids, np.cumsum(counts), END_ID).astype("<u4"), counts + 1
        if len(self.units) > self.cache_units:
            self._clear()
        parts = []
        for odd, some in groupby(texts, self._odd):
            parts += [np.array([*map(self.units.__getitem__, self._cut(x)), 0]) for x in some] if odd else [self._numbers(list(some))]
        at = np.concatenate(parts)
        if self.units.fresh:
            self._add(self.units.fresh)
            self.units.fresh = []
        sizes = self.size[at]
        counts = np.diff(np.concatenate([[0], np.cumsum(sizes)[at == 0]]))
        return self.flat[ragged(self.start[at], sizes)], counts

    def sentence_ends(self) -> np.ndarray:
        """For each id, whether a sentence or line ends after it."""
        out = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            out[i] = token.endswith((".", "!", "?")) or "Ċ" in token  # U+010A stands for the newline byte
        return out


def encoder(path: str, cache_units: int = CACHE_UNITS) -> Encoder:
    """The worker's encoder of a file; what it remembers of units is forgotten beyond cache_units."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
        memories.append(_loaded.clear)
    _loaded[path].cache_units = cache_units
    return _loaded[path]
