"""The training-data operators against brute force: small fixtures with nulls, empty and long texts, ties, repeated rows,
empty tables and columns with clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from weftline.llm import bitplanes, bwt, common, decontam, hmm, isoforest, minimisers, packing, queries, simhash, superkmer, toxicity, wordpiece
from weftline.llm.bpe import encoder, public_path
from weftline.llm.common import Rolling, ragged, slices
from weftline.llm.components import components

DATA = "/root/testdata/sf0.001"
VOCABULARY = [f"w{i}" for i in range(40)] + ["été", "ñandú", "漢字", "😀"]


def corpus(seed: int = 5) -> list[tuple]:
    """(doc_id, text): shared passages, near copies, copies, periodic texts, nulls, blanks, a long text."""
    rng = random.Random(seed)
    say = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    passage, rows = say(60), []
    for i in range(40):
        words = say(rng.randint(0, 90))
        if i % 3 == 0:
            words[len(words) // 2 : len(words) // 2] = passage[rng.randint(0, 20) : rng.randint(35, 60)]
        rows.append((i, rng.choice([" ", "  ", "\n", "\t "]).join(words)))
    rows += [(40, rows[3][1]), (41, rows[3][1] + " tail"), (42, None), (43, ""), (44, " \n\t "), (45, "ab " * 300), (46, "ab " * 150 + "x"), (47, "A b c " * 60)]
    rows += [(48, " ".join(say(6000))), (50, "z" * 400), (49, "z" * 400), (51, "z" * 99)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    wide = [(i, t, "en", "cuts", i, b"k", -1, 0, 1, 2, 3) for i, t in rows]
    return spark.createDataFrame(wide, f"doc_id long, text string, {CLASHES}").repartition(5)


CLASHES = "lang string, cuts string, bucket long, kept binary, `sum` int, _doc int, _sum int, _cuts int, _key int"


def empty(docs):
    return docs.limit(0)


def with_nulls(spark, docs):
    """A null id, and a row that repeats."""
    extra = spark.createDataFrame([(i, t, "en", "", 0, b"", 0, 0, 0, 0, 0) for i, t in ((None, "w1 w2 w3 w4"), (3, "w1 w2"), (3, "w1 w2"))], docs.schema)
    return docs.where("doc_id <> 3").unionByName(extra)


# --- shared parts ---


def test_rolling_hashes_equal_slices():
    data = np.frombuffer(b"abcabcxabc", dtype=np.uint8)
    r = Rolling()
    p = r.prefix(data)
    h = r.of(p, np.array([0, 3, 7, 1]), np.array([3, 6, 10, 4]))
    assert h[0] == h[1] == h[2] != h[3]
    assert list(r.of_slices(data, np.array([0, 3, 7]), np.array([3, 6, 10]), limit=2)) == list(h[:3])
    assert ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]


def test_sliding_argmin_is_leftmost():
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 7, 11):
        v = rng.integers(0, 4, 60).astype(np.uint64)
        assert minimisers.sliding_argmin(v, width).tolist() == [i + int(np.argmin(v[i : i + width])) for i in range(60 - width + 1)]


def test_equal_hashes_are_settled_by_bytes():
    data = np.frombuffer(b"aabbaa", dtype=np.uint8)
    at, n, same = np.array([0, 2, 4]), np.array([2, 2, 2]), np.zeros(3, dtype=np.uint64)
    assert minimisers.owners(data, at, n, same, np.array([7, 1, 2]), np.zeros(3, dtype=np.int64)).tolist() == [2, 1, 2]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 packing, 2 token-id planes ---


def test_units_have_the_library_s_ids():
    bpe = encoder(public_path())
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "Z", "é", " ", "  ", "\n", "\t", ".", "'s", "'", "1", "漢", "́", "\x1c", " ", "<|endoftext|>", "😀", ",", "-"]) for _ in range(rng.randint(0, 40))) for _ in range(400)] + [None, ""]
    ids, counts = bpe.encode(texts)
    assert counts.sum() == len(ids)
    lo = 0
    for text, n in zip(texts, counts):
        assert ids[lo : lo + n].tolist() == bpe.tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        lo += n


def expected_ids(rows):
    t = encoder(public_path()).tokenizer
    return {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [0], dtype="<u4") for i, x in rows}


def test_packing_covers_every_id_once(docs, rows, spark):
    ids = expected_ids(rows)
    got = packing.pack(docs, window=64).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length, r.doc_id, r.start))
    for i, x in ids.items():
        at = 0
        for start, length in sorted(by_doc[i]):
            assert start == at
            at += length
        assert at == len(x)
    for pieces in by_sequence.values():
        at = 0
        for offset, length, *_ in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
        assert [p[2:] for p in sorted(pieces)] == sorted(p[2:] for p in pieces)
    assert packing.pack(empty(docs)).count() == 0
    odd = packing.pack(with_nulls(spark, docs)).collect()
    assert sum(r.length for r in odd if r.doc_id == 3) == 2 * sum(r.length for r in odd if r.doc_id == 3 and r.start == 0) / 2


def test_cuts_are_optimal():
    rng = random.Random(9)
    for _ in range(60):
        at = sorted(rng.sample(range(1, 40), rng.randint(3, 9)))
        window = max(b - a for a, b in zip([0, *at], at)) + rng.randint(0, 6)
        cost = [rng.randint(0, 5) for _ in at]
        best = math.inf
        for chosen in product((0, 1), repeat=len(at) - 1):
            cuts = [a for a, c in zip(at, (*chosen, 1)) if c]
            if all(b - a <= window for a, b in zip([0, *cuts], cuts)):
                best = min(best, sum(window - (b - a) for a, b in zip([0, *cuts], cuts)) + sum(c for a, c in zip(at, cost) if a in cuts))
        cuts = packing.best_cuts(np.array(at), np.array(cost), window)
        assert sum(window - (b - a) for a, b in zip([0, *cuts], cuts)) + sum(c for a, c in zip(at, cost) if a in cuts) == best


def test_cuts_in_chunks_cost_what_those_of_the_whole_stream_do(monkeypatch):
    monkeypatch.setattr(packing, "AHEAD", 8)
    rng, total = random.Random(2), [0, 0]
    for _ in range(30):
        sizes = [rng.randint(1, 60) for _ in range(600)]
        sentence = np.arange(50) % 7 == 0
        ids = np.array([rng.randrange(50) for _ in range(sum(sizes))], dtype="<u4")
        price = dict(zip(*(x.tolist() for x in packing.candidates(sentence[ids], np.cumsum(sizes), len(ids)))))
        for which, chunk in enumerate((len(sizes), 150)):
            stream, fill, lo = packing._Stream(64, sentence, 0), Counter(), 0
            for k in range(0, len(sizes), chunk):
                n = np.array(sizes[k : k + chunk])
                stream.add(list(range(k, k + len(n))), ids[lo : lo + n.sum()], n)
                lo += n.sum()
                for x in stream.pieces(last=k + chunk >= len(sizes)):
                    for s, n_ids in zip(x["sequence_id"].tolist(), x["length"].tolist()):
                        fill[s] += n_ids
            assert sum(fill.values()) == len(ids) and max(fill.values()) <= 64
            cuts = np.cumsum([fill[s] for s in sorted(fill)]).tolist()
            total[which] += sum(64 - x for x in fill.values()) + sum(price[c] for c in cuts)
    assert total[0] <= total[1] <= 1.05 * total[0]


def test_planes_round_trip(docs, rows, spark):
    for n, bits in ((0, 8), (1, 1), (1000, 1), (777, 8)):
        ids = np.random.default_rng(n).integers(0, 2**32 if n == 777 else 50000, n).astype("<u4")
        assert (bitplanes.from_planes(bitplanes.to_planes(ids, bits), n, bits) == ids).all()
    ids = expected_ids(rows)
    starts = dict(zip(sorted(ids), np.cumsum([0, *(len(ids[i]) for i in sorted(ids))])))
    for options in ({}, {"bits": 1, "block": 100}):
        got = bitplanes.round_trip(docs, **options).collect()
        assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == [(i, starts[i], len(ids[i]), zlib.crc32(ids[i].tobytes())) for i in sorted(ids)]
    assert bitplanes.round_trip(empty(docs)).count() == 0
    assert bitplanes.round_trip(with_nulls(spark, docs)).count() == len(rows) - 1 + 2


# --- 3 quality ---


def slow_statistics(text: bytes):
    words = text.split()
    lines = text.split(b"\n")
    seen, dup = set(), 0
    for x in lines:
        if x.split():
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(len(w.decode()) for w in words), sum(text.count(c.encode()) for c in "#*$%&|<>"), dup, len(marked)


def test_statistics(rows):
    for _, text in [*rows, (0, "a\na\n\n \n \nb<>|"), (1, "a b c a b c a b")]:
        raw = (text or "").encode()
        if len(raw) < 5000:
            assert isoforest.statistics(raw)[:5] == slow_statistics(raw)


def test_quality_on_labelled_rows(spark, docs):
    table, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = isoforest.judged(table, labels).join(labels.dropDuplicates(["doc_id"]), "doc_id").where("not base_failed").groupBy("quality").agg({"kept": "count"}).collect()
    assert got
    verdict = {r.doc_id: r.kept for r in isoforest.judged(table, labels).collect()}
    kept = isoforest.keep_good(table, labels)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, k in verdict.items() if k)
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    passed = {r.doc_id for r in isoforest.judged(table, labels).where("not base_failed").collect()}
    assert sum(verdict[i] for i in good & passed) >= 0.99 * len(good & passed)
    assert sum(verdict[i] for i in bad) <= 0.2 * len(bad)
    assert isoforest.judged(empty(docs), labels.limit(0)).count() == 0
    none = {r.doc_id: (r.base_failed, r.kept) for r in isoforest.judged(docs, labels.limit(0)).collect()}
    assert all(k == (not b) for b, k in none.values())
    assert isoforest.judged(with_nulls(spark, docs), labels).where("doc_id is null").count() == 1


# --- 4 SimHash ---


def slow_fingerprint(text: str | None) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints: dict[int, int]) -> dict[int, int]:
    comp, left = {}, set(prints)
    while left:
        todo, group = [left.pop()], []
        while todo:
            x = todo.pop()
            group.append(x)
            near = {y for y in left if (prints[x] ^ prints[y]).bit_count() <= 2}
            left -= near
            todo += near
        comp |= dict.fromkeys(group, min(group))
    return comp


@pytest.mark.parametrize("bucket_rows", [4096, 2])
def test_simhash_groups(docs, rows, bucket_rows):
    prints = {i: slow_fingerprint(t) for i, t in rows}
    comp = slow_components(prints)
    got = simhash.near_duplicates(docs, bucket_rows=bucket_rows).collect()
    assert {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in got} == {i: (prints[i], comp[i]) for i in prints}


@pytest.mark.parametrize("bucket_rows", [4096, 8])
def test_links_of_dense_prints(spark, bucket_rows):
    """Many prints around few centres, so that buckets are far over the bound."""
    rng = random.Random(8)
    prints = {rng.getrandbits(64) for _ in range(5)}
    for _ in range(250):
        x = rng.choice(sorted(prints))
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    edges = simhash.links(table, bucket_rows=bucket_rows).collect()
    assert all(((e.a ^ e.b) & (2**64 - 1)).bit_count() <= 2 for e in edges)
    index = dict(enumerate(sorted(prints)))
    want = slow_components(index)
    back = {signed(x): i for i, x in index.items()}
    parent = {i: i for i in index}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        a, b = sorted((find(back[e.a]), find(back[e.b])))
        parent[b] = a
    assert {i: find(i) for i in index} == want


def test_simhash_edges(docs, spark):
    assert simhash.near_duplicates(empty(docs)).count() == 0
    odd = with_nulls(spark, docs)
    got = simhash.near_duplicates(odd)
    assert got.count() == odd.count() and got.where("doc_id is null").count() == 1


# --- 5 toxicity ---


def slow_segments(scores):
    """Maximal segments by their definition: take the best, split, and go on on both sides."""
    best, span = 0, None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            s = sum(scores[a:b])
            if s > best or s == best and span and b - a < span[1] - span[0]:
                best, span = s, (a, b)
    if not span:
        return []
    a, b = span
    return slow_segments(scores[:a]) + [(a, b, best)] + [(x + b, y + b, s) for x, y, s in slow_segments(scores[b:])]


def test_segments_are_all_found():
    rng = random.Random(3)
    for _ in range(300):
        scores = [rng.choice([-5, -3, -2, -1, 1, 2, 4, 7]) for _ in range(rng.randint(0, 14))]
        fast, slow = toxicity.segments(scores), slow_segments(scores)
        assert sorted(s for *_, s in fast) == sorted(s for *_, s in slow) and all(sum(scores[a:b]) == s for a, b, s in fast)
    rate = toxicity.decay({-2: 90, 3: 10})
    assert abs(0.9 * math.exp(-2 * rate) + 0.1 * math.exp(3 * rate) - 1) < 1e-6


def test_passages_count_together(spark):
    cases = [[], [4.0], [9.0, 5.0], [4.0, 3.5, 3.1], [30.0, 3.0], [3.2] * 8]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, x array<double>").select("k", toxicity.together(F.col("x")).alias("y"))
    for k, y in rows.collect():
        sums = [(r, sum(cases[k][:r])) for r in range(1, len(cases[k]) + 1)]
        chances = [math.exp(-t) * t ** (r - 1) / (math.factorial(r) * math.factorial(r - 1)) * 2 ** (r - 1) for r, t in sums]
        assert y is None if not sums else abs(y + math.log(min(chances))) < 1e-9


def test_least_hashed_rows(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    want = df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(300).collect()
    assert sorted(common.least_hashed(df, "doc_id", 300).collect()) == sorted(want)
    assert common.least_hashed(df, "doc_id", 20_000).count() == 20_000 and common.least_hashed(df.limit(0), "doc_id", 5).count() == 0


def test_toxicity_on_held_out_rows(spark, docs):
    table, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in toxicity.scored(table, labels).collect()}
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for i, r in got.items())
    for r in got.values():
        assert all(p.chance <= toxicity.LEVEL and p.score <= r.best and (p.score < r.best or math.isclose(p.chance, r.chance)) for p in r.passages) and len(r.passages) <= r.n_segments
        assert all(0 <= p.start < p.stop <= r.n_words for p in r.passages) and all(p.stop <= q.start for p, q in zip(r.passages, r.passages[1:]))
        assert (r.best > 0 and r.chance <= toxicity.LEVEL) == any((p.start, p.stop, p.score) == (r.best_start, r.best_stop, r.best) for p in r.passages)
    assert max(len(r.passages) for r in got.values()) > 1
    held = [(got[i].score, y) for i, y in marks.items() if got[i].held_out]
    bad, good = [s for s, y in held if y], [s for s, y in held if not y]
    assert sum((a > b) + (a == b) / 2 for a in bad for b in good) / (len(bad) * len(good)) > 0.75
    assert sum(s >= 0.3 for s in good) / len(good) < 0.1
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - toxic else toxic end toxic")
    again = {r.doc_id: r.score for r in toxicity.scored(table, flipped).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in got.items())
    assert toxicity.scored(empty(docs), labels.limit(0)).count() == 0
    odd = toxicity.scored(with_nulls(spark, docs), labels.limit(0)).collect()
    assert len(odd) == docs.count() + 2 and all(0 <= r.score <= 1 and r.predicted == 0 for r in odd)


# --- 6 word pieces ---


def slow_pieces(entries, word):
    at = n = 0
    while at < len(word):
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in entries), 0)
        if not size:
            return -1
        at, n = at + size, n + 1
    return n


def test_automaton_counts_greedy_pieces(docs, rows, spark):
    rng = random.Random(3)
    for _ in range(200):
        entries = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        machine = wordpiece.Automaton(entries)
        for _ in range(20):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 14)))
            assert machine.count(word) == slow_pieces(entries, word)
    entries = set(wordpiece.vocabulary(public_path()))
    got = {r.doc_id: (r.n_words, r.n_pieces, r.n_unknown) for r in wordpiece.token_counts(docs).collect()}
    for i, text in rows:
        words = (text or "").encode().split()
        assert got[i] == (len(words), sum(slow_pieces(entries, b" " + w) for w in words), 0)
    assert wordpiece.token_counts(empty(docs)).count() == 0
    assert wordpiece.token_counts(with_nulls(spark, docs)).where("doc_id is null or doc_id = 3").count() == 3


# --- 7 language model ---


def test_chain_against_all_paths():
    rng = np.random.default_rng(0)
    k, c = 3, 4
    chain = hmm.Chain(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(c), k))
    rows = [rng.integers(0, c, n) for n in (1, 3, 5, 2)]
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, c))
    for row, likelihood in zip(rows, hmm.forward(chain, rows)):
        total, s, m, e = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros((k, c))
        for path in product(range(k), repeat=len(row)):
            w = chain.start[path[0]] * chain.emit[path[0], row[0]]
            for a, b, o in zip(path, path[1:], row[1:]):
                w *= chain.move[a, b] * chain.emit[b, o]
            total += w
            s[path[0]] += w
            for a, b in zip(path, path[1:]):
                m[a, b] += w
            for q, o in zip(path, row):
                e[q, o] += w
        assert abs(math.log(total) - likelihood) < 1e-9
        start, move, emit = start + s / total, move + m / total, emit + e / total
    got = hmm.expected(chain, rows)
    assert np.allclose(got[0], start, rtol=1e-4) and np.allclose(got[1], move, rtol=1e-4) and np.allclose(got[2], emit, rtol=1e-4)
    assert np.allclose(got[3], hmm.forward(chain, rows).sum(), rtol=1e-5)


def test_probabilities_of_all_texts_of_a_length_sum_to_one():
    """Over every sequence of classes that ends in the end and has no other end, with the chance of going on."""
    rng = np.random.default_rng(1)
    k, c = 2, 3
    chain = hmm.Chain(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(c), k))
    for n in (1, 2, 4):
        assert abs(np.exp(hmm.forward(chain, [np.array(x) for x in product(range(c), repeat=n)])).sum() - 1) < 1e-9


def slow_likelihood(chain, row):
    alpha = chain.start * chain.emit[:, row[0]]
    total = 0.0
    for x in row[1:]:
        total += math.log10(alpha.sum())
        alpha = (alpha / alpha.sum()) @ chain.move * chain.emit[:, x]
    return total + math.log10(alpha.sum())


@pytest.mark.parametrize("slice_bytes", [1 << 22, 2000])
def test_language_model(docs, rows, spark, monkeypatch, slice_bytes):
    chains, once = [], hmm._round
    monkeypatch.setattr(hmm, "_round", lambda *a: chains.append(once(*a)) or chains[-1])
    got = {r.doc_id: r for r in hmm.scored(docs, states=3, frequent=20, tails=8, rounds=3, gain=-1.0, slice_bytes=slice_bytes).collect()}
    counts, tokens = Counter(), {i: [*(t or "").encode().lower().split(), b""] for i, t in rows}
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    top = [b"", *sorted(counts.keys() - {b""}, key=lambda w: (-counts[w], w))[:20]]
    kind = lambda w: top.index(w) if w in top else 21 + hmm.tail_of(w, 8)
    class_n, class_v = Counter(), Counter()
    for w, c in counts.items():
        class_n[kind(w)] += c
        class_v[kind(w)] += 1
    assert len(chains) == 3 and chains[0][1] < chains[1][1] < chains[2][1]  # Baum-Welch climbs
    for i, w in tokens.items():
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        inside = sum(math.log10((counts[x] + 0.1) / (class_n[kind(x)] + 0.1 * (class_v[kind(x)] + 1))) for x in w)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(counts[x] > 0 for x in w), n, zlib.crc32(str(i).encode()) % 10 == 0)
        assert abs(r.base_score - base) < 1e-6 * len(w)
        assert abs(r.score - inside - slow_likelihood(chains[-1][0], [kind(x) for x in w])) < 1e-6 * len(w)


def test_language_model_edges(docs, rows, spark):
    assert hmm.scored(empty(docs), rounds=1).count() == 0
    assert hmm.scored(with_nulls(spark, docs), rounds=1).count() == len(rows) + 2
    named = {r.doc_id: r.n_tokens for r in hmm.scored(docs.selectExpr("concat('d', doc_id) doc_id", "text"), rounds=1).collect()}
    assert named == {f"d{i}": len((t or "").encode().split()) + 1 for i, t in rows}


# --- 8 decontamination ---


def slow_overlaps(docs, items, window=13, share=0.8):
    import re

    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w]
    out = set()
    for i, t in docs:
        d = words(t)
        for j, u in items:
            x = words(u)
            n = min(window, len(x))
            if n and any(sum(a == b for a, b in zip(d[p : p + n], x[q : q + n])) >= math.ceil(share * n - 1e-9) for p in range(len(d) - n + 1) for q in range(len(x) - n + 1)):
                out.add((i, j))
    return out


def test_decontamination_finds_substituted_passages(spark):
    rng = random.Random(6)
    items = [(j, " ".join(rng.choice("abcdefghijklmnop") * 2 for _ in range(rng.choice([13, 20, 40])))) for j in range(12)] + [(90, None), (91, ""), (92, "one two")]
    rows = []
    for i in range(60):
        words = ["".join(rng.choice("qrstuvwxyz") for _ in range(3)) for _ in range(rng.randint(0, 40))]
        if i % 2:
            x = items[i % 12][1].split()
            at = rng.randint(0, len(x) - 13)
            x = x[at : at + 13]
            for k in rng.sample(range(13), i % 5):
                x[k] = "XX"
            words[len(words) // 2 : len(words) // 2] = [w.upper() if i % 3 else w for w in x]
        rows.append((i, " ".join(words)))
    rows += [(100, None), (101, ""), (None, items[0][1]), (7, rows[7][1])]
    d = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, item_id int, pos int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = slow_overlaps([r for r in rows if r[0] is not None], items)
    assert len({i for i, _ in want}) >= 18
    for limit in (10**6, 3):
        got = decontam.contaminated(d, b, broadcast_seeds=limit).collect()
        assert len(got) == len({(r.doc_id, r.item_id) for r in got}) and {(r.doc_id, r.item_id) for r in got} == want
    kept = decontam.drop_contaminated(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {i for i, _ in want}
    assert decontam.contaminated(d.limit(0), b).count() == 0 and decontam.contaminated(d, b.limit(0)).count() == 0


def short_items(seed: int = 8):
    """Items of 1 to 13 words, and documents that hold them with 0 to 3 substitutions, whole and cut, or share an id."""
    rng = random.Random(seed)
    items = [(n * 10 + k, " ".join(rng.choice("abcdefghijklmnop") * 2 for _ in range(n))) for n in range(1, 14) for k in range(2)]
    docs = []
    for i in range(260):
        x = items[i % len(items)][1].split()
        for k in rng.sample(range(len(x)), min(len(x), rng.randint(0, 3))):
            x[k] = "YY"
        words = ["".join(rng.choice("qrstuvwxyz") for _ in range(3)) for _ in range(rng.randint(0, 20))]
        at = rng.randint(0, len(words))
        docs.append((i, " ".join(words[:at] + x[: rng.choice([len(x), len(x), len(x) - 1])] + words[at:])))
    half = items[-3][1].split()
    docs += [(300, " ".join(half[:6])), (300, " ".join(half[6:])), (301, None), (302, " "), (303, items[0][1])]
    return docs, [*items, (900, None), (901, " \n"), (131, "of two texts")]


def test_decontamination_is_whole_for_short_items(spark):
    docs, items = short_items()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = slow_overlaps(docs, items)
    assert {len(dict(items)[j].split()) for _, j in want if j != 131} >= set(range(1, 13))
    rows = [sorted(decontam.contaminated(d, b, broadcast_seeds=limit).collect()) for limit in (10**6, 3)]
    assert rows[0] == rows[1] and {(r.doc_id, r.item_id) for r in rows[0]} == want


def test_decontamination_equals_its_sql(spark, tmp_path):
    import duckdb

    docs, items = short_items(9)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = decontam.contaminated(*(spark.read.parquet(f"{tmp_path}/{name}.parquet") for name in ("documents", "benchmark")))
    found = con.execute(queries.ORACLES["op8_decontamination"])
    names = [x[0] for x in found.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(found.fetchall())


# --- 9 and 10 substrings ---


def slow_words(rows, w=13):
    words, first = {i: (t or "").encode().split() for i, t in rows}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - w + 1):
            first.setdefault(tuple(words[i][k : k + w]), i)
    out = {}
    for i, x in words.items():
        gone = {k + j for k in range(len(x) - w + 1) if first[tuple(x[k : k + w])] < i for j in range(w)}
        kept = [y for k, y in enumerate(x) if k not in gone]
        out[i] = (len(x), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def test_repeated_words(docs, rows, spark):
    want = slow_words(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in superkmer.digests(docs).collect()} == want
    assert sum(x[1] for x in want.values()) > 500
    assert superkmer.digests(empty(docs)).count() == 0
    odd = superkmer.digests(with_nulls(spark, docs)).where("doc_id is null or doc_id = 3").collect()
    assert len(odd) == 3 and all(r.n_removed == 0 for r in odd)
    kept = superkmer.without_repeats(docs, n_chars="bucket")
    assert kept.columns == docs.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    for i, t in rows:
        n, gone, digest = want[i]
        if not gone:
            assert texts[i] == t
        elif gone == n:
            assert i not in texts
        else:
            assert hashlib.sha256(texts[i].encode()).hexdigest() == digest


def test_a_bucket_settles_collisions(monkeypatch, rows):
    """All window hashes equal: the bytes decide."""
    texts = [(i, (t or "").encode()) for i, t in sorted(rows, key=lambda r: r[0]) if t and len(t) < 2000][:8]
    args = ([i for i, _ in texts], [0] * len(texts), [t for _, t in texts], 13, 3, 1)
    blobs = [x for _, kind, x in superkmer._split(*args) if kind == minimisers.RUNS]
    want = superkmer._count(blobs, 13)
    monkeypatch.setattr(superkmer._rolling, "of_slices", lambda data, a, b: np.zeros(len(a), dtype=np.uint64))
    assert superkmer._count(blobs, 13).tolist() == want.tolist()


def test_transform_equals_sorting():
    rng = random.Random(1)
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for _ in range(40):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 8))]
        sizes = np.array([len(x) for x in strings])
        columns = bwt.transform(np.frombuffer(b"".join(strings), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes, memory=rng.choice([1 << 20, 8]))
        suffixes = [strings[s][len(strings[s]) - n :] for s, n in zip(columns.now["string"].tolist(), columns.now["length"].tolist())]
        assert suffixes == sorted(x[k:] for x in strings for k in range(len(x) + 1))
        assert columns.now["prefix"].tolist() == [0, *(shared(a, b) for a, b in zip(suffixes, suffixes[1:]))]
        before = [strings[s][len(strings[s]) - n - 1] if n < len(strings[s]) else bwt.END for s, n in zip(columns.now["string"].tolist(), columns.now["length"].tolist())]
        assert columns.now["symbol"].tolist() == before
        columns.close()


def slow_bytes(rows, w=100):
    texts, first = {i: (t or "").encode() for i, t in rows}, {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - w + 1):
            first.setdefault(texts[i][k : k + w], (i, k))
    out = {}
    for i, x in texts.items():
        gone = np.zeros(len(x) + 1, dtype=bool)
        for k in range(len(x) - w + 1):
            if first[x[k : k + w]] != (i, k):
                gone[k : k + w] = True
        gone = gone[:-1]
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out[i] = (len(x), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(x) else 0, hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_bytes(docs, rows, spark):
    want = slow_bytes(rows)
    for options in ({}, {"memory": 1 << 10, "group_bytes": 1 << 12}):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in bwt.digests(docs, **options).drop("kept").collect()}
        assert got == want
    assert sum(x[1] for x in want.values()) > 2000
    assert bwt.digests(empty(docs)).count() == 0
    odd = bwt.digests(with_nulls(spark, docs)).where("doc_id is null or doc_id = 3").collect()
    assert len(odd) == 3 and all(r.n_removed == 0 for r in odd)


@pytest.mark.parametrize("run", [superkmer.digests, superkmer.without_repeats, bwt.digests, bitplanes.round_trip])
def test_ids_that_are_not_numbers_are_refused(docs, run):
    with pytest.raises(TypeError, match="integer"):
        run(docs.withColumn("doc_id", docs.doc_id.cast("string")))


def test_slices_keep_rows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 50, "c"])], names=["text"])
    got = [x.column(0).to_pylist() for x in slices(iter([batch]), "text", 20)]
    assert sum(got, []) == batch.column(0).to_pylist() and len(got) == 3


# --- the pipeline ---


def test_pipeline_against_plain_python(spark):
    """run() on the smallest tables: each stage's rows from the previous stage's by brute force."""
    import corpus_pipeline
    from test_jaccard import slow_kept

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    verdict = {r.doc_id for r in isoforest.judged(table, labels).where("kept").collect()}
    rows = {r.doc_id: r.text for r in table.collect() if r.doc_id in verdict}
    kept = slow_kept(list(rows.items()))
    rows = {i: t for i, t in rows.items() if i in kept}
    cut = slow_words(list(rows.items()))
    first, left = {}, {}
    for i in sorted(rows):
        w = rows[i].encode().split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, t in rows.items():
        w = t.encode().split()
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        assert len(gone) == cut[i][1]
        if not gone:
            left[i] = t
        elif len(gone) < len(w):
            left[i] = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
    bad = {i for i, _ in slow_overlaps(list(left.items()), items)}
    ids = expected_ids([(i, t) for i, t in left.items() if i not in bad])
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in got} == set(ids) and len(corpus_pipeline.STAGES) == 5
    for r in got:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert Counter({i: len(x) for i, x in ids.items()}) == sum((Counter({r.doc_id: r.length}) for r in got), Counter())
