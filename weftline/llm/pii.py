"""Personal data: rules find plain forms, boosted trees judge candidates for disguised ones.

Rules: e-mail addresses, IPv4 addresses, card numbers that pass Luhn's check, international telephone numbers. Beyond
them generators with high recall propose overlapping spans: addresses written with words or brackets, numbers cut out of
longer runs of digits, numbers without their plus. Trees boosted on the logistic loss judge each by its format and
context. Labels come from the corpus itself: what the rules find, rewritten in place in a disguise, is personal; decoys
written in its place, and runs that fail the rules' checks, are not. Trees are grown on at most ``fit_rows`` labelled
candidates, those with the least hashes; each kind's threshold is calibrated on all of them.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import least_hashed, materialize, slices, texts_of, tidied

KINDS = ("email", "ip", "card", "phone")
FIT_ROWS, ROUNDS, DEPTH, RATE, CUTS, PRECISION, BINS, CONTEXT = 20_000, 60, 3, 0.3, 32, 0.98, 1000, 40

Span = tuple[int, int, int]  # kind, start, end

_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
#: How disguised addresses write their signs.
_AT = re.compile(r"\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?|\s(?:at|AT)\s|\s?[@＠]\s?")
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_DOT = re.compile(r"\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?|\s(?:dot|DOT|\.)\s|\.|．")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,3}(?![0-9A-Za-z])")
_GAP = re.compile(r"[ ().\-/_]{1,3}")
_CUES = re.compile(r"(?i)mail|contact|write|phone|tel|call|fax|mobile|card|visa|credit|pay|\bip\b|host|server|addr")
_MONEY = "$€£¥%#"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from their @, so that a long run of letters without one costs nothing."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = floor + len(text[floor:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        floor = domain.end() if domain else at + 1
        at = text.find("@", floor)


def base_spans(text: str) -> list[Span]:
    """What the rules find: leftmost matches of each kind that do not overlap, without those that fail its check."""
    out = [(0, *span) for span in _emails(text)]
    for m in _DOTTED.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def _addresses(text: str) -> Iterator[Span]:
    """Spans with something like an @ and labels with something like dots between them."""
    for m in _AT.finditer(text):
        start = m.start()
        while start and m.start() - start < 64 and text[start - 1] in _LOCAL:
            start -= 1
        if start == m.start():
            continue
        end, labels, at = 0, 0, m.end()
        while (label := _LABEL.match(text, at)) and labels < 8:
            end, labels = label.end(), labels + 1
            dot = _DOT.match(text, end)
            if not dot:
                break
            at = dot.end()
        if labels > 1:
            yield 0, start, end
    for m in _NUMBER.finditer(text):
        end, parts = m.end(), 1
        while parts < 4 and (dot := _DOT.match(text, end)) and (part := _NUMBER.match(text, dot.end())):
            end, parts = part.end(), parts + 1
        if parts == 4:
            yield 1, m.start(), end


def _numbers(text: str) -> Iterator[Span]:
    """Spans of whole groups of digits, cut out of runs of groups: possible cards, and telephones with or without a plus."""
    run: list[tuple[int, int]] = []

    def spans() -> Iterator[Span]:
        for i, (start, _) in enumerate(run):
            before = text[start - 1 : start]
            opens = before in ("+", "(") and before != "" or text.startswith("00", start)
            count = 0
            for j in range(i, len(run)):
                count += run[j][1] - run[j][0]
                if count > 19:
                    break
                whole, end = i == 0 and j == len(run) - 1, run[j][1]
                if count >= 12 and (whole or luhn(_digits(text[start:end]))):
                    yield 2, start, end
                if 7 <= count <= 15 and (opens or whole):
                    first = start - 1 if before in ("+", "(") and before else start
                    yield 3, first - (first > 1 and text[first - 1] == "+" and before == "("), end

    for m in _DIGITS.finditer(text):
        start, end = m.span()
        if text[start - 1 : start].isalpha() and start or text[end : end + 1].isalpha():
            yield from spans()
            run = []
            continue
        if run and not _GAP.fullmatch(text, run[-1][1], start):
            yield from spans()
            run = []
        run.append((start, end))
    yield from spans()


def candidates(text: str) -> list[Span]:
    return [*_addresses(text), *_numbers(text)]


FEATURES = (
    "kind_email", "kind_ip", "kind_card", "kind_phone", "digits", "length", "letters", "groups", "shortest", "longest", "first_group", "last_group", "luhn", "octets",
    "plus", "double_zero", "paren", "brackets", "blanks", "dashes", "dots", "slashes", "at_sign", "at_word", "dot_word", "labels", "last_label", "last_letters", "local", "local_digits",
    "before_kind", "after_kind", "digits_before", "digits_after", "cue", "money", "equals",
)


def _near(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in ".,;:!?\"'" else 5


def features(text: str, span: Span) -> list[float]:
    """FEATURES of a span: its format, and what stands within CONTEXT characters of it."""
    kind, start, end = span
    said, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    groups = [len(x) for x in _DIGITS.findall(said)] or [0]
    digits, at = _digits(said), _AT.search(said)
    domain = said[at.end() :] if at else ""
    labels = [x for x in _DOT.split(domain) if x]
    last = labels[-1] if labels else ""
    local = said[: at.start()] if at else ""
    return [
        *(float(kind == k) for k in range(4)), len(digits), len(said), sum(c.isalpha() for c in said), len(groups), min(groups), max(groups), groups[0], groups[-1],
        luhn(digits), all(len(x) < 4 and int(x) < 256 for x in _DIGITS.findall(said)), said.startswith("+"), said.startswith("00"), "(" in said, sum(said.count(c) for c in "[]{}<>()"),
        sum(c.isspace() for c in said), said.count("-"), said.count("."), said.count("/") + said.count("_"), "@" in said or "＠" in said, bool(at and at[0].strip().lower() == "at"),
        len(re.findall("(?i)\\bdot\\b", said)), len(labels), len(last), last.isalpha(), len(local), len(_digits(local)),
        _near(before[-1:]), _near(after[:1]), len(_digits(before[-12:])), len(_digits(after[:12])), len(_CUES.findall(before)), sum(c in _MONEY for c in before[-3:] + after[:3]), before.rstrip()[-1:] in ("=", ":"),
    ]


def _disguised(kind: int, said: str, way: int) -> str:
    """A way of writing personal data that the rules miss."""
    if kind == 0:
        at, dot = ((" at ", " dot "), ("[at]", "[dot]"), ("(at)", "."), (" @ ", " . "), ("＠", "."), (" [at] ", " [dot] "), (" AT ", " DOT "), ("[@]", "[.]"))[way % 8]
        local, _, domain = said.partition("@")
        if way & 8 and domain.count(".") > 1:  # shorter domains and names without digits are as personal
            domain = domain.partition(".")[2]
        if way & 16:
            local = "".join(c for c in local if not c.isdigit()).strip("._%+-") or local
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return said.replace(".", ("[.]", "(.)", " . ", " dot ", "[dot]", "(dot)", "．", "{.}")[way % 8])
    digits = _digits(said)
    if kind == 2:
        parts = [digits[k : k + 4] for k in range(0, len(digits), 4)]
        return (".", "/", "_", "  ", " - ", ". ", ".", "/")[way % 8].join(parts)
    rest = said.lstrip("+")
    sign = ("-", ".", " ")[way % 3]
    parts = [x for x in (digits[:-10], digits[-10:-7], digits[-7:-4], digits[-4:]) if x]
    return (rest, "00" + rest, sign.join(parts), f"({parts[-3]}) {parts[-2]}-{parts[-1]}" if len(parts) > 2 else rest, sign.join(parts[-3:]), "00" + sign.join(parts), rest, f"({parts[-3]}) {parts[-2]} {parts[-1]}" if len(parts) > 2 else rest)[way % 8]


def _decoy(kind: int, said: str, way: int) -> str:
    """Something of like shape in its place that is nobody's."""
    n = zlib.crc32(said.encode())
    two, four = f"{n % 28 + 1:02d}", f"{1900 + n % 130}"
    if kind == 0:
        domain = said.partition("@")[2]
        words = domain.split(".")
        return (f"seen at {domain}", f"is at {words[-1]}.{words[0]}", f"look at {words[0]} dot", f"Anne at {domain}", f"open at {n % 12}.{two}", f"v{n % 9} @ {n % 90}.{two}", f"or at {domain}", f"{two} @ {n % 100}.{n % 90 + 10}")[way % 8]
    if kind == 1:
        parts = said.split(".")
        parts[n % 4] = str(256 + n % 700)
        return _disguised(1, ".".join(parts), way >> 1)
    odd = "".join(str((n >> k) % 10) for k in range(16))
    odd = odd[:-1] + next(c for c in "0123456789" if not luhn(odd[:-1] + c))
    if kind == 2:
        return (odd, "-".join((odd[:4], odd[4:8], odd[8:12], odd[12:])), "  ".join((odd[:4], odd[4:8], odd[8:12], odd[12:])), "/".join((odd[:4], odd[4:8], odd[8:12], odd[12:])), odd[:13], f"{odd[:6]}.{odd[6:12]}", f"978-{odd[0]}-{odd[1:3]}-{odd[3:9]}-{odd[9]}", "_".join((odd[:4], odd[4:8], odd[8:12], odd[12:])))[way % 8]
    return (
        f"{four}-{two}-{two}", f"{four}-{int(four) + 9}", f"{two}.{two}.{four} {two}.{two}", f"978-{odd[0]}-{odd[1:3]}-{odd[3:9]}-{odd[9]}", odd[:10], f"{odd[:2]}.{odd[2:7]} {odd[7:9]}.{odd[9:14]}",
        f"{two}/{two}/{four}", " ".join(odd[k : k + 2] for k in range(0, 10, 2)), f"{four} {int(four) + 1} {int(four) + 2}", odd[:8], f"{odd[:3]} {odd[3:6]} {odd[6:9]}", f"{four}{two}{two}-{odd[:4]}",
    )[way % 12]


def labelled(text: str, spans: list[Span]) -> Iterator[tuple[int, int, int, list[float]]]:
    """(place, kind, 1 or 0, features): each of the rules' spans rewritten in a disguise and as a decoy, in its context;
    and the digit runs of the text itself that fail Luhn's check."""
    for kind, start, end in spans:
        said, way = text[start:end], zlib.crc32(text[start:end].encode()) >> 3
        before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
        for label, written in ((1, _disguised(kind, said, way)), (1, _disguised(kind, said, way + 3)), (0, _decoy(kind, said, way)), (0, _decoy(kind, said, way + 5))):
            here = before + written + after
            low, high = len(before), len(before) + len(written)
            for k, a, b in candidates(here):
                if label and (k, a, b) == (kind, low, high) or not label and a < high and b > low:
                    yield start, k, label, features(here, (k, a, b))
    taken = [(a, b) for _, a, b in spans]
    for k, a, b in _numbers(text):
        if k == 2 and not luhn(_digits(text[a:b])) and not _meets(taken, a, b):
            yield a, k, 0, features(text, (k, a, b))


def _meets(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether [a, b) overlaps one of the spans, in order of their starts."""
    at = bisect.bisect_left(taken, (b, 0))
    return any(taken[k][1] > a for k in range(max(0, at - 2), at))


class Trees(NamedTuple):
    """Complete trees of one depth as arrays (tree, node): feature, cut (left below it), and leaves' values."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of rows of FEATURES."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), dtype=int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] >= c[node])
            total += v[node - len(f)]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Trees:
    """Trees on the logistic loss, each split the best by gain over at most CUTS cuts a feature; classes weigh the same."""
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) if len(y) else np.zeros(0)
    cuts = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, CUTS)[1:])) if len(c) else np.zeros(1) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="right") for c, v in zip(cuts, x.T)], axis=1) if len(x) else np.zeros((0, x.shape[1]), dtype=int)
    margin, inner = np.zeros(len(y)), 2**DEPTH - 1
    trees = []
    for _ in range(rounds if len(y) and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
        feature, cut, node = np.zeros(inner, dtype=int), np.full(inner, np.inf), np.zeros(len(y), dtype=int)
        for k in range(inner):
            mine = np.flatnonzero(node == k)
            best = 1e-6
            g_all, h_all = gradient[mine].sum(), hessian[mine].sum()
            for f in range(x.shape[1] if len(mine) > 1 else 0):
                g, h = (np.bincount(binned[mine, f], w[mine], len(cuts[f]) + 1) for w in (gradient, hessian))
                g, h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
                gain = g**2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1)
                gain[(h < 0.05) | (h_all - h < 0.05)] = 0
                if len(gain) and gain.max() > best:
                    at = int(gain.argmax())
                    best, feature[k], cut[k] = gain[at], f, cuts[f][at]
            node[mine] = 2 * k + 1 + (x[mine, feature[k]] >= cut[k])
        leaf = node - inner
        value = RATE * np.bincount(leaf, gradient, inner + 1) / (np.bincount(leaf, hessian, inner + 1) + 1)
        margin += value[leaf]
        trees.append((feature, cut, value))
    if not trees:
        return Trees(np.zeros((0, inner), dtype=int), np.zeros((0, inner)), np.zeros((0, inner + 1)), -30.0)
    return Trees(*(np.stack(c) for c in zip(*trees)), 0.0)


class Model(NamedTuple):
    trees: Trees
    thresholds: tuple[float, ...]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Candidates over their kind's threshold that meet no rule's span; of those that overlap the surest, then the longest."""
        taken = sorted((a, b) for _, a, b in base)
        rows = sorted({s for s in candidates(text) if not _meets(taken, *s[1:])})
        if not rows:
            return []
        scores = self.trees.score(np.array([features(text, s) for s in rows], dtype=float))
        out, held = [], []
        for score, length, (kind, a, b) in sorted(((-p, s[1] - s[2], s) for p, s in zip(scores, rows))):
            if -score >= self.thresholds[kind] and not _meets(held, a, b):
                bisect.insort(held, (a, b))
                out.append((kind, a, b))
        return out


def _labelled_rows(docs: DataFrame) -> DataFrame:
    """Of every text: key, kind, label and features of the labelled candidates."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 22):
            rows = []
            for name, x in zip(batch.column(0).to_pylist(), texts_of(batch, "text")):
                text = x.decode()
                rows += [(f"{name}:{k}:{place}", kind, label, x) for k, (place, kind, label, x) in enumerate(labelled(text, base_spans(text)))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["key", "kind", "label", "features"])

    return docs.mapInArrow(run, "key string, kind long, label long, features array<double>")


def _stack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS, precision: float = PRECISION) -> Model:
    """Grow the trees and calibrate each kind's threshold: the least over which that share of the labelled candidates,
    all of them, is personal. A kind without personal ones, as in an empty table, has a threshold above 1."""
    rows = materialize(_labelled_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))), "labelled")
    sample = least_hashed(rows, "key", fit_rows, "kind").toPandas().sort_values("key")
    x = np.stack(sample["features"]) if len(sample) else np.zeros((0, len(FEATURES)))
    trees = boost(x, sample["label"].to_numpy(dtype=float))

    @tidied
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = np.floor(trees.score(_stack(b.column("features"))) * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("label"), pa.array(bins)], names=["kind", "label", "bin"])

    seen = np.zeros((len(KINDS), 2, BINS + 1))
    for r in rows.mapInArrow(score, "kind long, label long, bin long").groupBy("kind", "label", "bin").count().collect():
        seen[r.kind, r.label, r.bin] = r["count"]
    over = seen[:, :, ::-1].cumsum(axis=2)[:, :, ::-1]
    thresholds = []
    for bad, good in over:
        able = np.flatnonzero((good > 0) & (good >= precision * (good + bad)))
        thresholds.append(max(0.5, able[0] / BINS) if len(able) else 2.0)
    return Model(trees, tuple(thresholds))


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], s[0])))


def redact(text: str, spans: list[Span]) -> str:
    """text with each run of overlapping spans replaced by [KIND] of its first."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[0])):
        if a >= done:
            out += [text[done:a], f"[{KINDS[kind].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def found(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", with_text: bool = False, model: Model | None = None, **options) -> DataFrame:
    """For every row of docs: doc_id, n_email, n_ip, n_card, n_phone (the rules' spans), base_sha256 of those spans,
    spans (all, "kind:start:end" in code points, end exclusive, by start), n_added, and with_text the redacted text.

    A null or empty text has no spans; repeated rows and null ids each give a row; of candidates with equal scores the
    longer and then the first is taken; an empty table gives no rows; other columns are ignored.
    """
    known = docs.sparkSession.sparkContext.broadcast(model or fit(docs, doc_id=doc_id, text=text, **options))
    id_type = docs.schema[doc_id].dataType.simpleString()
    counts = [f"n_{k}" for k in KINDS]
    names = ["doc_id", *counts, "base_sha256", "spans", "n_added", *(["redacted"] if with_text else [])]

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 22):
            rows = []
            for x in texts_of(batch, "text"):
                said = x.decode()
                base = base_spans(said)
                more = known.value.added(said, base)
                rows.append((*(sum(s[0] == k for s in base) for k in range(4)), hashlib.sha256(_written(base).encode()).hexdigest(), _written(base + more), len(more), *([redact(said, base + more)] if with_text else [])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in zip(*rows))], names=names)

    kinds = ["long"] * 4 + ["string", "string", "long", "string"]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{n} {k}" for n, k in zip(names[1:], kinds)))
