"""Matching queries over whole tables, against plain Python."""

from __future__ import annotations

from collections import Counter

import pytest
from conftest import DATA

from weftline.operators import matching
from weftline.plans.assignment import _edges
from weftline.plans.catalogue import QUERIES


@pytest.fixture(scope="module")
def edges(spark):
    return [tuple(r) for r in _edges(lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")).collect()]


def plain(edges, classes):
    """Edges from the best down while both ends, and the class on that paper, have room."""
    papers, people, juniors, out = Counter(), Counter(), Counter(), set()
    for p, r, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        junior = classes and r % 4 == 1
        if papers[p] < 4 and people[r] < 2 and not (junior and juniors[p]):
            papers[p] += 1
            people[r] += 1
            juniors[p] += junior
            out.add((p, r))
    return out


@pytest.mark.parametrize("name, classes", [("greedy_match", True), ("sequential_match", True), ("greedy_rounds", False)])
def test_greedy_takes_the_best_of_all_edges(spark, edges, name, classes):
    got = {(r.paper_id, r.person_id) for r in QUERIES[name](spark, DATA).collect()}
    assert got == plain(edges, classes) and len(got) > 100


def test_ladder_and_its_reports(spark, edges):
    got = [tuple(r) for r in QUERIES["phase_ladder"](spark, DATA).collect()]
    score, base = {(p, r): s for p, r, s in edges}, [x for x in got if not x[3].startswith("surplus")]
    per, load = Counter(p for p, *_ in base), Counter(r for _, r, *_ in got)
    assert len({x[:2] for x in got}) == len(got) and all(score[p, r] == s for p, r, s, _ in got)
    assert max(per.values()) <= 3 and max(load.values()) <= 3 and all(n <= 4 for n in Counter(p for p, *_ in got).values())
    assert all((p + r) % 3 > 0 for p, r, _, n in got if n in ("senior anchor", "fill", "surplus")) and all(r % 8 == 1 for _, r, _, n in got if n.startswith("senior"))
    assert all(n <= 1 for n in Counter(p for p, r, _, n in got if r % 8 == 3 and "limits" not in n).values())
    relaxed = Counter(p for p, _, _, n in base if n not in ("senior anchor", "fill"))
    papers = {p for p, *_ in edges}
    want = {(p, relaxed[p], 3 - per[p]) for p in papers if relaxed[p] or per[p] < 3}
    assert {(r.paper_id, r.relaxed, r.missing) for r in QUERIES["relaxed_papers"](spark, DATA).collect()} == want
    extra = Counter(p for p, _, _, n in got if n.startswith("surplus"))
    assert {(r.paper_id, r.added) for r in QUERIES["surplus_papers"](spark, DATA).collect()} == set(extra.items())
    slates = {r.person_id: r for r in QUERIES["person_slates"](spark, DATA).collect()}
    assert {i: r.n_papers for i, r in slates.items()} == {i: load[i] for i in {r for _, r, _ in edges}}
    assert all(r.papers == [p for p, x, s, _ in sorted(got, key=lambda x: (-x[2], x[0])) if x == i] for i, r in slates.items() if r.n_papers)


def test_rounds_that_run_out_raise(spark):
    rows = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (2, 1, 0.7)], "paper_id long, person_id long, score double")
    targets, caps = rows.select("paper_id").distinct().selectExpr("paper_id", "1 target"), rows.select("person_id").distinct().selectExpr("person_id", "1 cap")
    with pytest.raises(RuntimeError, match="rounds"):
        matching.rounds(rows, targets, caps, most=1)


def test_balanced_loads_admit_no_better_move_or_swap(spark):
    got = {r.paper_id: (r.person_id, r.score) for r in QUERIES["balanced_flow"](spark, DATA).collect()}
    e = {r.vec_id: r.embedding for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    papers, chairs = sorted(i for i in e if i % 5 == 0), sorted(i for i in e if i % 50 == 1)
    score = {(p, r): round(sum(float(x) * float(y) for x, y in zip(e[p], e[r])), 6) for p in papers for r in chairs}
    load, mean = Counter(r for r, _ in got.values()), len(papers) / len(chairs)
    assert set(got) == set(papers) and set(load) <= set(chairs)
    low, high = min(load[r] for r in chairs), max(load[r] for r in chairs)
    assert 0.9 * mean - 1 < low <= high < 1.1 * mean + 1
    for p in papers:
        for q in papers:
            a, b = got[p][0], got[q][0]
            assert score[p, b] + score[q, a] <= score[p, a] + score[q, b] + 3e-6
        for r in chairs:
            if load[r] < high and load[got[p][0]] > low:
                assert score[p, r] <= score[p, got[p][0]] + 3e-6
