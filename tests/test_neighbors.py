"""Nearest neighbours over the whole table against brute force."""

from __future__ import annotations

import numpy as np
from conftest import DATA

from weftline.plans.catalogue import QUERIES


def test_neighbors_come_from_all_rows(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, m = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    sims = m @ m.T
    np.fill_diagonal(sims, -np.inf)
    got = {}
    for r in QUERIES["nearest_neighbors"](spark, DATA).collect():
        got.setdefault(r.vec_id, {})[r.rank] = r
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    at = {int(v): k for k, v in enumerate(ids)}
    for v, found in got.items():
        best = np.sort(sims[at[v]])[::-1]
        for rank in (1, 2, 3):
            r = found[rank]
            assert r.other != v and abs(r.affinity - best[rank - 1]) < 2e-6 and abs(sims[at[v], at[r.other]] - r.affinity) < 2e-6


def test_queries_in_parts_find_the_same(spark):
    from weftline.operators.pairs import nearest

    rows = spark.read.parquet(f"{DATA}/embeddings.parquet")
    found = [sorted(map(tuple, nearest(rows.where("vec_id % 9 = 0"), rows, "vec_id", "embedding", 3, held_bytes=size).collect())) for size in (1 << 30, 4000)]
    assert found[0] == found[1] and found[0]
    assert nearest(rows.limit(0), rows, "vec_id", "embedding", 3).count() == 0


def test_few_products_at_a_time_find_the_same(spark):
    from weftline.operators.pairs import nearest

    rows = spark.read.parquet(f"{DATA}/embeddings.parquet")
    found = [sorted(map(tuple, nearest(rows.where("vec_id % 9 = 0"), rows, "vec_id", "embedding", 3, cells=size).collect())) for size in (1 << 19, 300)]
    assert found[0] == found[1] and found[0]


def test_every_row_has_its_neighbors(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, m = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    near = np.round(m @ m.T, 6)
    want = set()
    for i, v in enumerate(ids):
        first = [j for j in np.lexsort((ids, -near[i])) if j != i][:3]
        want |= {(int(v), int(ids[j]), rank) for rank, j in enumerate(first, 1)}
    assert {(r.vec_id, r.other, r.rank) for r in QUERIES["nearest_neighbors"](spark, DATA).collect()} == want and len(want) == 3 * len(ids)


def test_equal_products_fall_by_id_in_any_block(spark):
    from weftline.operators.pairs import nearest

    rows = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(40)], "id long, v array<double>")
    want = {(i, j, rank) for i in range(40) for rank, j in enumerate(([x for x in range(1, 40, 2) if x != i] if i % 2 else [x for x in range(40) if x != i])[:3], 1)}
    for sizes in ({}, {"cells": 40, "block": 7}, {"held_bytes": 100}):
        assert {(r.id, r.other, r.rank) for r in nearest(rows, rows, "id", "v", 3, **sizes).collect()} == want
    assert nearest(rows.limit(2), rows.limit(2), "id", "v", 3).count() == 2
