"""Near-duplicates of the pipeline against all pairs by brute force."""

from __future__ import annotations

import random

import pytest

from weftline.llm import jaccard, simhash

DATA = "/root/testdata/sf0.001"


def slow_sets(text: str | None) -> frozenset:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def slow_kept(rows: list[tuple], share: float = 0.8) -> set:
    sets, left, kept = {i: slow_sets(t) for i, t in rows}, {i for i, _ in rows}, set()
    near = lambda x, y: x == y or len(x & y) >= share * len(x | y) - 1e-9
    while left:
        todo, group = [left.pop()], []
        while todo:
            x = todo.pop()
            group.append(x)
            found = {y for y in left if near(sets[x], sets[y])}
            left -= found
            todo += found
        kept.add(min(group))
    return kept


def near_copies() -> list[tuple]:
    """Texts with copies that differ in a few words, about the bound of 0.8; a passage that most texts share; oddities."""
    rng = random.Random(11)
    say = lambda n: [f"v{rng.randrange(500)}" for _ in range(n)]
    passage, rows = say(40), []
    for _ in range(60):
        base = say(rng.choice([3, 5, 6, 20, 60, 200])) + (passage if rng.random() < 0.7 else [])
        rows.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(words + say(rng.randrange(3))))
    rows += [" ".join(passage)] * 3 + ["", None, " \n", "One", "one", "a b c d e", "A b c  d e", "a b c d f"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("often, small", [(4, 16), (1, 1), (1, 2)])
def test_near_copies_go(spark, monkeypatch, often, small):
    monkeypatch.setattr(jaccard, "SAMPLE", often)
    monkeypatch.setattr(jaccard, "OFTEN", often)
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = slow_kept(rows)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(want)


def test_pipeline_stage_drops_near_copies(spark):
    import corpus_pipeline

    words = [f"u{i}" for i in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join(w if i % 90 else "edit" for i, w in enumerate(words))), (3, " ".join(words[:150] + words[:150][::-1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert slow_kept(rows) == {1, 3}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {1, 3}


def test_no_rows(spark):
    assert simhash.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_large_family_makes_few_pairs(spark):
    """400 texts that differ in a word or two: one stays, and the pairs to verify grow with the family, not its square."""
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(w if k not in (i % 300, 7 * i % 300) else f"e{i}" for k, w in enumerate(base))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    met = jaccard.prefixes_met(docs.select("text"))
    assert met.where(met.kind == jaccard.NEXT).select("a", "b").distinct().count() < 12 * 400
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == slow_kept(rows)


def test_texts_about_a_family_are_not_paired_with_all_of_it(spark, monkeypatch):
    """Half of 500 texts have too many edits for a link to the others: neither the rows in cells nor the pairs to verify grow with the square."""
    rng, made = random.Random(5), {}
    base, keep = [f"w{i}" for i in range(150)], jaccard.materialize
    rows = []
    for i in range(500):
        words = list(base)
        for k in rng.sample(range(150), rng.randrange(8)):
            words[k] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    crossing = jaccard._crossing

    def counted(met, roots, share):
        members, cells = crossing(met, roots, share)
        made["cells"] = cells.count()
        return members, cells

    def kept(df, tag):
        made[tag] = (out := keep(df, tag)).count()
        return out

    monkeypatch.setattr(jaccard, "SAMPLE", 2)
    monkeypatch.setattr(jaccard, "_crossing", counted)
    monkeypatch.setattr(jaccard, "materialize", kept)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == slow_kept(rows)
    assert made["likely"] < 4 * len(rows) and made["cells"] < 4 * made["members"]


def test_odd_rows(spark):
    """Null ids, rows that repeat, ids that repeat with other texts, and columns with clashing names."""
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f"), (None, "g h i j k l"), (6, "m n o p q r"), (6, "m n o p q r"), (6, "s t u v w x"), (7, None), (3, ""), (None, " ")]
    docs = spark.createDataFrame([(*r, 1, "y", 0) for r in rows], "doc_id long, text string, _row int, stays string, sig int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(5, "a b c d e f"), (None, "g h i j k l"), (6, "m n o p q r"), (6, "s t u v w x"), (3, "")], key=str)


def test_stage_on_the_smallest_tables(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, DATA).select("doc_id").collect()}
    assert got == slow_kept([(r.doc_id, r.text) for r in docs.collect()])
