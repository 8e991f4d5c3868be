"""Offers and the ladder over pairs in blocks, against plain Python and without the bound of one task."""

from __future__ import annotations

import pytest
from conftest import DATA
from test_whole_matching import plain

from weftline.operators import matching
from weftline.operators.offers import offers_of
from weftline.plans.assignment import _edges, _juniors, _room
from weftline.plans.catalogue import QUERIES
from weftline.policy import Policy


@pytest.fixture(scope="module")
def t(spark):
    return lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")


def test_short_looks_give_the_same_offers(spark, t):
    edges = [tuple(r) for r in _edges(t).collect()]
    got = {(r.paper_id, r.person_id) for r in offers_of(*_room(t, 4, 2), *_juniors(t), rows=1, least=16).collect()}
    assert got == plain(edges, True)


def test_queries_have_no_bound_and_the_ladder_is_the_plain_one(spark, t, monkeypatch):
    edges = [(p, r, s, (p + r) % 3 > 0) for p, r, s in map(tuple, _edges(t).collect())]
    people = {r for _, r, *_ in edges}
    of = lambda *k: {r for r in people if r % 8 in k}
    steps = matching.ladder(sorted({p for p, *_ in edges}), {"senior": of(1), "almost_senior": of(2), "junior": of(3), "out_of_area": of(3, 4), "almost_not": of(3)}, Policy(per_paper=3))
    cap = dict.fromkeys(people, 3)
    picks = matching.phases(edges, steps, cap, "sequential")
    picks += matching.surplus(edges, picks, cap, base=3, extra=1, class_of=steps[3]["class_of"], limit=steps[3]["limit"], mode="sequential")
    monkeypatch.setattr(matching, "KERNEL_EDGES", 10)
    assert sorted(map(tuple, QUERIES["phase_ladder"](spark, DATA).collect())) == sorted(picks)
    assert QUERIES["sequential_match"](spark, DATA).count() > 100


def test_lowest_means(spark):
    means = spark.range(100).selectExpr("id paper_id", "cast(id * 37 % 10 as double) mean")
    got = {r.paper_id for r in matching._lowest(means, 25, lambda df: df.localCheckpoint()).collect()}
    assert got == {p for _, p in sorted((p * 37 % 10, p) for p in range(100))[:25]}
