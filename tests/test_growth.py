"""Work that grows with the input, not with its square: dumps, co-author pairs and co-author conflicts."""

from __future__ import annotations

import io
import random
import time
from itertools import product

from conftest import DATA
from pyspark.sql import functions as F

from weftline.operators import conflicts
from weftline.plans.catalogue import QUERIES
from weftline.sources import bibliography


def test_records_of_a_block_cost_their_own_bytes():
    data = b"<dblp>" + b"".join(b'<article key="%d"><ee/><title>t</title></article>' % i for i in range(40_000)) + b"</dblp>"
    took, rows = {}, {}
    for block in (1 << 12, 1 << 20):
        began = time.perf_counter()
        rows[block] = list(bibliography.cut(io.BytesIO(data).read, 0, float("inf"), bibliography.KINDS, block))
        took[block] = time.perf_counter() - began
    assert rows[1 << 12] == rows[1 << 20] and len(rows[1 << 20]) == 40_000
    assert took[1 << 20] < 5 * took[1 << 12]


def test_ranges_of_large_dumps_are_bounded(tmp_path, monkeypatch):
    (tmp_path / "d.xml").write_bytes(b"<dblp>" + b'<www key="homepages/a"/>' * 1000)
    monkeypatch.setattr(bibliography, "TASKS", 7)
    parts = bibliography.DumpReader({"path": str(tmp_path / "d.xml"), "range": "100"}).partitions()
    assert len(parts) <= 8 and parts[-1].end == 6 + 24 * 1000


def test_pairs_are_dealt_by_a_number_of_rows(spark):
    plan = QUERIES["coauthor_pairs"](spark, DATA)._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_only_names_that_match_meet(spark):
    rng = random.Random(3)
    name = lambda: sorted(rng.sample("abcdefg", rng.randint(0, 4)))
    authors = [(p % 40, f"a{p}", name(), rng.choice([[], ["1"], ["1", "2"]])) for p in range(60)]
    index = [(r % 30, name(), rng.choice(["", "1", "3"]), r % 4, 2000 + r % 3, "w") for r in range(50)]
    left = spark.createDataFrame(authors, "paper_id long, author string, tokens array<string>, numbers array<string>")
    right = spark.createDataFrame(index, "person_id long, tokens array<string>, number string, shared long, latest_year int, latest_title string")
    for least in (1, 2):
        want: dict = {}
        n = 0
        for (p, a, x, numbers), (r, y, number, shared, year, _) in product(authors, index):
            if min(len(x), len(y)) >= least and (set(x) <= set(y) or set(y) <= set(x)):
                if x == y and numbers and number and number not in numbers:
                    continue
                n += 1
                rank = (x != y, -shared, -year, a, " ".join(y))
                want[p, r] = min(want.get((p, r), rank), rank)
        known = lambda rows: rows.where(f"size(tokens) >= {least}")
        assert conflicts._met(known(left), known(right).withColumnRenamed("tokens", "their_tokens"), least).count() == n
        got = conflicts.coauthor_conflicts(left, right, least=least).collect()
        assert {(r.paper_id, r.person_id): (r.match != "exact", -r.shared, -r.latest_year, r.author) for r in got} == {k: v[:4] for k, v in want.items()} and len(got) == len(want)


def test_conflicts_of_equal_names_are_compared_as_a_block(spark, monkeypatch):
    """Names that many share are compared once, and the pairs are those of each person with each author, in any number of tasks."""
    people = [(r, ["a", f"n{r % 3}"], [["a", f"n{r % 2}"]], [str(r % 4)] if r % 5 else None) for r in range(60)]
    authors = [(p % 70, p, ["a", f"n{p % 4}"], [["a", f"n{p % 3}"]], [str(p % 5), None]) for p in range(90)]
    left = spark.createDataFrame(people, "person_id long, tokens array<string>, declared array<array<string>>, institutions array<string>")
    right = spark.createDataFrame(authors, "paper_id long, author long, tokens array<string>, declared array<array<string>>, institutions array<string>")
    want: dict = {}
    for (r, mine, declared, inst), (p, _, tokens, theirs, places) in product(people, authors):
        found = [(0, " ".join(x)) for x in declared if x == tokens] + [(1, " ".join(x)) for x in theirs if x == mine] + [(2, x) for x in inst or () if x in places]
        if found:
            want[p, r] = min([*found, *([want[p, r]] if (p, r) in want else [])])
    kinds = ("person_declared", "author_declared", "institution")
    met = []
    for block, dealt in ((1024, 1 << 25), (7, 40)):
        monkeypatch.setattr(conflicts, "BLOCK", block)
        monkeypatch.setattr(conflicts._dealt_join, "__kwdefaults__", {"dealt": dealt})
        got = conflicts.collaborator_conflicts(left, right).collect()
        assert {(x.paper_id, x.person_id): (kinds.index(x.kind), x.evidence) for x in got} == want and len(got) == len(want)
        index = left.select("person_id", "tokens", *[F.lit(x).alias(c) for x, c in (("", "number"), (1, "shared"), (2000, "latest_year"), ("w", "latest_title"))])
        names = right.select("paper_id", F.col("author").cast("string").alias("author"), "tokens", F.array().cast("array<string>").alias("numbers"))
        got = conflicts.coauthor_conflicts(names, index).collect()
        assert {(x.paper_id, x.person_id) for x in got} == {(a[0], x[0]) for x, a in product(people, authors) if x[1] == a[2]} and len({(x.paper_id, x.person_id) for x in got}) == len(got)
        met.append(sorted(map(tuple, got)))
    assert met[0] == met[1]
    rows = conflicts._blocks(right.withColumn("tokens", F.array_sort("tokens")), ["paper_id", "author"], ["tokens"], "_l").collect()
    assert sum(len(x._l) for x in rows) == 90 and max(len(x._l) for x in rows) < 90
