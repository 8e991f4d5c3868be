"""Decontamination with long items and texts, rows that share an id, and both joins."""

from __future__ import annotations

import random
import time

import pytest

from weftline.llm import decontam

SCHEMA = "doc_id long, text string, row long, `_row` string, words int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "r", 2) for r in rows], SCHEMA).repartition(3)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("bounds", [{}, {"broadcast_seeds": 5}, {"broadcast_words": 5}])
def test_long_items_and_texts(spark, bounds):
    rng = random.Random(1)
    say = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    item, text = say(14_000), say(48_000)
    text[30_000:30_040] = item[9_000:9_040]
    began = time.time()
    got = decontam.contaminated(frame(spark, [(1, " ".join(text)), (2, " ".join(say(60)))]), items(spark, [(7, " ".join(item)), (8, " ".join(say(40)))]), **bounds).collect()
    assert [(r.doc_id, r.item_id, r.matched_words, r.doc_start, r.item_start) for r in got] == [(1, 7, 13, 30_000, 9_000)]
    assert time.time() - began < 60


@pytest.mark.parametrize("bounds", [{}, {"broadcast_seeds": 5}])
def test_rows_that_share_an_id_are_judged_one_by_one(spark, bounds):
    rng = random.Random(2)
    say = lambda n: " ".join(f"v{rng.randint(0, 10**6)}" for _ in range(n))
    leak, clean = say(30), say(50)
    rows = [(1, f"{say(5)} {leak} {say(5)}"), (1, clean), (1, clean), (2, None), (3, ""), (None, leak), (4, leak)]
    kept = decontam.drop_contaminated(frame(spark, rows), items(spark, [(9, leak), (10, None), (None, clean)]), **bounds)
    assert kept.columns == ["doc_id", "text", "row", "_row", "words"]
    assert sorted(((r.doc_id or 0), r.text or "") for r in kept.collect()) == sorted([(1, clean), (1, clean), (2, ""), (3, ""), (0, leak)])
    assert decontam.drop_contaminated(frame(spark, rows), items(spark, [(9, leak)]).limit(0)).count() == len(rows)
    assert decontam.drop_contaminated(frame(spark, rows).limit(0), items(spark, [(9, leak)])).count() == 0
