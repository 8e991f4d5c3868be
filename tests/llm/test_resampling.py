"""Importance resampling against plain Python: nulls, repeated rows and ids, long texts in pieces, ties, empty tables, clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from weftline.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASHES = "doc_id long, text string, bucket int, buckets string, total boolean, n_words int, score long, row int, rank int, part int, _id int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "b", True, 2, 3, 4, 5, 6, 7) for r in rows], CLASHES).repartition(3)


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute(docs, target, buckets=resampling.BUCKETS):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    corpus, wanted = Counter(), Counter()
    for rows, into in ((docs, corpus), (target, wanted)):
        for _, text in rows:
            into.update(map(bucket, features(text)[1]))
    total, aim = sum(corpus.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (total + buckets) / ((corpus[b] + 1) * (aim + buckets)))) for b in range(buckets)]
    out = []
    for doc, text in docs:
        words, grams = features(text)
        weight = sum(gain[bucket(f)] for f in grams) // len(grams) if grams else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append((doc, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = Counter((r[0], r[3]) for r in able[: 25 * len(able) // 100])
    return out, [(r[0], r[3]) for r in able[: 25 * len(able) // 100]], drawn


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Été", "漢字", "ABC", "x1Y2", "naïve-ish", "😀ok"]
    say = lambda n: rng.choice([" ", "\n", "--", " | "]).join(rng.choice(words) for _ in range(n))
    docs = [(i, say(rng.randint(0, 90))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, " \n"), (None, say(40)), (203, say(9000)), (204, "z" * 5000), (205, "Ab,aB;" * 3000)]
    docs += [(7, docs[7][1])] * 9 + [(206, docs[9][1]), (207, docs[9][1])]
    return docs, [(i, say(30).replace("w1", "w2")) for i in range(12)] + [(90, None)]


def test_scores_and_ranks(spark, rows):
    docs, target = rows
    out, drawn, _ = brute(docs, target)
    got = resampling.resampled(frame(spark, docs), frame(spark, target)).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r.n_words) for r in got), key=key) == sorted(out, key=key)
    assert [(r.doc_id, r.score) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_long_texts_in_pieces(spark, rows, monkeypatch):
    docs, target = rows
    for text in ("a b c d e f g " * 50, "", "x" * 300, "a " + "y" * 300 + " b"):
        words = resampling.words_of(text.encode())
        whole = resampling._Counter(resampling.BUCKETS).counts([words])
        monkeypatch.setattr(resampling.pieces_of, "__defaults__", (20,))
        cut = resampling._Counter(resampling.BUCKETS).long_counts(words)
        assert [x.tolist() for x in cut] == [x.tolist() for x in whole]
        assert len(list(resampling.pieces_of(words))) > 1 or len(words) <= 320


def test_empty_tables(spark, rows):
    docs, target = rows
    assert resampling.resampled(frame(spark, docs).limit(0), frame(spark, target)).count() == 0
    got = resampling.resampled(frame(spark, docs), frame(spark, target).limit(0)).collect()
    assert len(got) == len(docs) and {r.doc_id: r.weight for r in got}[3] == {d[0]: d[2] for d in brute(docs, [])[0]}[3]
