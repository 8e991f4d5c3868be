"""Greedy, rounds, phases, surplus and flow against brute force on seeded instances."""

from __future__ import annotations

import itertools
import random

import pytest

from weftline.operators.flow import balanced, load_bounds
from weftline.operators.matching import greedy, ladder, phases, proposals, rounds, surplus
from weftline.policy import Policy


def instance(seed: int):
    rng = random.Random(seed)
    papers, people = range(rng.randint(1, 6)), [f"r{i}" for i in range(rng.randint(1, 8))]
    pairs = [(p, r) for p in papers for r in people if rng.random() < 0.75]
    scores = rng.sample(range(1000), len(pairs))
    edges = [(p, r, s / 1000) for (p, r), s in zip(pairs, scores)]
    return edges, {p: rng.randint(1, 4) for p in papers}, {r: rng.randint(1, 3) for r in people}, rng


def blocking(edges, taken, target, cap, class_of=None, limit=None):
    by_p, by_r = {}, {}
    for p, r, s in taken:
        by_p.setdefault(p, {})[r] = s
        by_r.setdefault(r, {})[p] = s
    out = []
    for p, r, s in edges:
        if r in by_p.get(p, {}):
            continue
        held, mine = by_p.get(p, {}), by_r.get(r, {})
        if not (len(mine) < cap[r] or s > min(mine.values())):
            continue
        full = [c for c in (class_of or {}).get(r, ()) if sum(c in class_of.get(x, ()) for x in held) >= (limit or {}).get(c, 99)]
        if full:
            inside = [v for x, v in held.items() if all(c in class_of.get(x, ()) for c in full)]
            if inside and s > min(inside):
                out.append((p, r))
        elif len(held) < target[p] or s > min(held.values()):
            out.append((p, r))
    return out


@pytest.mark.parametrize("block", range(5))
def test_greedy_is_stable_and_keeps_caps(block):
    for seed in range(block * 50, block * 50 + 50):
        edges, target, cap, rng = instance(seed)
        class_of = {r: (["a"] if rng.random() < 0.5 else []) + (["b"] if rng.random() < 0.3 else []) for r in cap}
        limit = {"a": 1, "b": 2}
        for classes, limits in (({}, {}), ({r: [c for c in v if c == "a"] for r, v in class_of.items()}, limit)):
            taken = greedy(edges, target, cap, classes, limits)
            assert len({(p, r) for p, r, _ in taken}) == len(taken)
            assert all(sum(q == p for q, _, _ in taken) <= target[p] for p in target)
            assert all(sum(x == r for _, x, _ in taken) <= cap[r] for r in cap)
            assert not blocking(edges, taken, target, cap, classes, limits)
        taken = greedy(edges, target, cap, class_of, limit)
        for p, c in itertools.product(target, limit):
            assert sum(c in class_of[r] for q, r, _ in taken if q == p) <= limit[c]


def test_offers_in_turn_equal_greedy_where_classes_do_not_cross():
    for seed in range(200):
        edges, target, cap, rng = instance(seed)
        class_of = {r: ["a"] if rng.random() < 0.5 else [] for r in cap}
        for classes, limit, held in (({}, {}, {}), (class_of, {"a": 1}, {}), (class_of, {"a": 2, ("a", 0): 1}, {("a", 1): 1})):
            assert sorted(proposals(edges, target, cap, classes, limit, held)) == sorted(greedy(edges, target, cap, classes, limit, held))


def test_offers_with_crossing_classes():
    edges = [(1, "a", 1.0), (1, "e", 0.9), (1, "f", 0.5), (1, "g", 0.4), (2, "x1", 3.0), (2, "x2", 2.0), (2, "a", 1.5)]
    class_of = {"a": ["j"], "e": ["j", "x"], "f": ["x"], "g": ["x"]}
    caps, limit = dict.fromkeys(["a", "e", "f", "g", "x1", "x2"], 1), {"j": 1, "x": 2}
    got = proposals(edges, {1: 3, 2: 3}, caps, class_of, limit)
    assert [r for p, r, _ in got if p == 1] == ["f", "g"] and sorted(r for p, r, _ in got if p == 2) == ["a", "x1", "x2"]
    assert blocking(edges, got, {1: 3, 2: 3}, caps, class_of, limit) == [(1, "e")]
    for seed in range(200):
        edges, target, cap, rng = instance(seed)
        class_of = {r: [c for c in "ab" if rng.random() < 0.5] for r in cap}
        got = proposals(edges, target, cap, class_of, {"a": 1, "b": 2})
        assert all(sum(q == p for q, _, _ in got) <= n for p, n in target.items()) and all(sum(x == r for _, x, _ in got) <= n for r, n in cap.items())
        assert all(sum(c in class_of[r] for q, r, _ in got if q == p) <= n for p in target for c, n in (("a", 1), ("b", 2)))


def test_ties_stay_with_who_came_first():
    assert proposals([(1, "a", 0.5), (2, "a", 0.5)], {2: 1, 1: 1}, {"a": 1}) == [(2, "a", 0.5)]
    assert proposals([], {1: 1}, {}) == [] and proposals([(1, "a", 0.5)], {1: 0}, {"a": 1}) == proposals([(1, "a", 0.5)], {1: 1}, {"a": 0}) == []


@pytest.mark.parametrize("mode", ["greedy", "sequential"])
def test_ladder_releases_in_order(mode):
    pools = {"senior": {"s"}, "almost_senior": {"t"}, "junior": {"j", "k"}, "out_of_area": set(), "almost_not": {"k"}}
    edges = [(1, "s", 0.2, False), (1, "j", 0.9, True), (1, "k", 0.8, True), (2, "t", 0.1, False), (2, "p", 0.7, False), (1, "q", 0.05, True)]
    steps = ladder([1, 2], pools, Policy(per_paper=3, max_juniors=1))
    caps = dict.fromkeys("sjktpq", 1)
    picks = phases(edges, steps, caps, mode)
    assert {(p, r): n for p, r, _, n in picks} == {(1, "s"): "senior anchor (area released)", (2, "t"): "almost-senior anchor", (1, "j"): "fill", (1, "q"): "fill", (2, "p"): "fill (area released)"}
    short = phases([e for e in edges if e[1] != "q"], steps, caps, mode)
    assert (1, "k", 0.8, "fill (limits released)") in short
    more = surplus([*edges, (1, "z", 0.3, False)], picks, {**caps, "z": 1}, base=3, extra=1, class_of=steps[3]["class_of"], limit=steps[3]["limit"], mode=mode)
    assert more == [(1, "z", 0.3, "surplus (area released)")]


def test_rounds_equal_greedy(spark):
    for seed in (3, 11):
        edges, target, cap, _ = instance(seed)
        e = spark.createDataFrame(edges, "paper_id long, person_id string, score double")
        t = spark.createDataFrame(list(target.items()), "paper_id long, target int")
        c = spark.createDataFrame(list(cap.items()), "person_id string, cap int")
        assert sorted((r.paper_id, r.person_id) for r in rounds(e, t, c).collect()) == sorted((p, r) for p, r, _ in greedy(edges, target, cap))


def test_phases_and_surplus():
    edges = [(1, "a", 0.9, True), (1, "b", 0.8, True), (1, "c", 0.7, False), (2, "a", 0.6, True), (2, "c", 0.5, True)]
    steps = [{"name": "anchor", "target": {1: 1, 2: 1}, "people": {"a"}, "total": False}, {"name": "fill", "target": {1: 2, 2: 2}}, {"name": "released", "target": {1: 3, 2: 2}, "gated": False}]
    picks = phases(edges, steps, {"a": 1, "b": 1, "c": 2})
    assert [(p, r, n) for p, r, _, n in picks] == [(1, "a", "anchor"), (1, "b", "fill"), (2, "c", "fill"), (1, "c", "released")]
    more = surplus([(1, "d", 0.4), (2, "d", 0.3)], [(1, "a", 0.9), (2, "c", 0.5)], {"a": 1, "c": 1, "d": 1}, base=1, extra=2)
    assert [x[:2] for x in more] == [(2, "d")]


def test_flow_is_optimal():
    for seed in range(40):
        rng = random.Random(seed)
        n, k = rng.randint(2, 5), rng.randint(2, 3)
        people = list(range(k))
        edges = [(p, r, rng.randint(0, 99) / 100) for p in range(n) for r in people]
        lower, upper = n // k, -(-n // k)
        got = balanced(edges, people, lower, upper)
        score = {(p, r): s for p, r, s in edges}
        best = max(sum(score[p, r] for p, r in enumerate(x)) for x in itertools.product(people, repeat=n) if all(lower <= x.count(r) <= upper for r in people))
        assert abs(sum(s for _, _, s in got) - best) < 1e-9
    with pytest.raises(ValueError):
        balanced([(0, 0, 1.0), (1, 0, 1.0)], [0], 0, 1)


def test_load_bounds():
    assert load_bounds(56, 15, 0.1) == (3, 4)
    assert load_bounds(10, 5, 0.5) == (1, 3)
