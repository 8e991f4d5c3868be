"""Names in an index and the evidence between namesakes: against all pairs in plain Python, and case by case."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from weftline.operators import resolution as R
from weftline.operators.identity import respelt


def relation(a, b):
    if not a or not b:
        return None
    if a == b:
        return "exact"
    return "partial" if (a <= b or b <= a) and len(a & b) > 1 or respelt(sorted(a), sorted(b), 0.8) else None


def test_name_pairs_against_all_pairs(spark):
    rng = random.Random(3)
    given, family = ["wei", "anna", "jose", "rosalind", "katharina", "katherina", "mohammed", "mohamned", "li"], ["wang", "wang", "wang", "smith", "schmidt", "schmitd", "garcia", "ng"]
    say = lambda: sorted({rng.choice(given) for _ in range(rng.randint(0, 2))} | {rng.choice(family) for _ in range(rng.randint(0, 2))})
    wanted, index = [(f"w{i}", say()) for i in range(60)], [(f"p{i // 2}", say()) for i in range(120)]
    got = R.name_pairs(spark.createDataFrame(wanted, "id string, tokens array<string>"), spark.createDataFrame(index, "pid string, tokens array<string>"))
    want = {}
    for i, a in wanted:
        for p, b in index:
            kind = relation(set(a), set(b))
            if kind and want.get((i, p)) != "exact":
                want[i, p] = kind
    assert {(r.id, r.pid): r.relation for r in got.collect()} == want
    assert {"exact", "partial"} == set(want.values())


def test_common_surnames_alone_make_no_pairs(spark):
    many = spark.range(2000).select(F.concat(F.lit("id"), "id").alias("pid"), F.array_sort(F.array(F.lit("wang"), F.concat(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 3), "id"))).alias("tokens"))
    out = R.name_pairs(many.withColumnRenamed("pid", "id"), many, least=1.01)
    assert out.count() == 2000


def test_search_prefers_exact_and_parts_camel_case(spark):
    wanted = spark.createDataFrame([(1, "Cheng Chen"), (2, "SeyyedAghaei Rezaei"), (3, "Ana Maria Lopez"), (4, None), (5, "Nobody Here"), (6, "X")], "id long, name string")
    index = spark.createDataFrame([("a", "Chen Cheng 0002"), ("b", "Fu Chen Cheng"), ("c", "Seyyed Aghaei Rezaei"), ("d", "Ana Lopez"), ("d", "Ana M. Lopez"), ("e", None), ("f", "Maria Gomez")], "pid string, name string")
    assert {(r.id, r.pid, r.relation) for r in R.search(wanted, index).collect()} == {(1, "a", "exact"), (2, "c", "exact"), (3, "d", "partial")}


def test_affiliation_and_address_decide_only_when_one_fits(spark):
    found = spark.createDataFrame([(1, "a", "Blue University"), (1, "b", "Red Institute"), (2, "a", "Blue University"), (2, "c", "University of Blue"), (3, "a", None)], "id long, pid string, affiliation string")
    wanted = spark.createDataFrame([(1, "University of Blue"), (2, "Blue"), (3, "Blue")], "id long, affiliation string")
    assert [tuple(r) for r in R.pick_by_affiliation(found, wanted).collect()] == [(1, "a")]
    people = spark.createDataFrame([(1, "Rosalind Ng", "Blue University"), (2, "Ann Lee", "Red Lab"), (3, "Rosalind Ng", "Green University"), (4, "Pat Long", "Blue University")], "id long, name string, affiliation string")
    emails = spark.createDataFrame([("rosalind@blue.ac.kr",), ("lee@red.org",), ("pat.long@blue.edu",), ("PAT.LONG@cs.blue.edu",), ("no-sign",), (None,)], "email string")
    assert [tuple(r) for r in R.match_by_address(people, emails).collect()] == [(1, "rosalind@blue.ac.kr")]


def test_advisors_take_the_first_source_that_knows(spark):
    advisors = spark.createDataFrame([(1, "A One", "a@x"), (2, "B Two", "b@x"), (3, "Cara Three", None), (4, "Dan Four", None), (5, "Eve Five", None)], "id long, name string, email string").withColumn("affiliation", F.lit("Blue University"))
    vetted, declared = spark.createDataFrame([("a@x", "v1")], "email string, pid string"), spark.createDataFrame([("a@x", "d1"), ("b@x", "d2"), ("b@x", "d2"), ("b@x", "d3")], "email string, pid string")
    index = spark.createDataFrame([("c3", "Cara Three"), ("d4", "Dan Four"), ("d5", "Dan Four"), ("e1", "Eve Five"), ("e2", "Eve Five")], "pid string, name string")
    places = spark.createDataFrame([("d4", "Blue"), ("d5", "Red"), ("e1", "Blue"), ("e2", "Blue")], "pid string, affiliation string")
    got = {r.id: (r.pid, r.how) for r in R.resolve_advisors(advisors, vetted, declared, index, places).collect()}
    assert got == {1: ("v1", "vetted"), 2: ("d2", "declared"), 3: ("c3", "only page"), 4: ("d4", "affiliation")}


def test_students_are_resolved_by_evidence(spark):
    names = ["Una Confirmed", "Dos Declared", "Tri Nameonly", "Quad Twins", "Penta Nobody", "Hexa Bucket", "Sep Place", "Octo Spelling", "Nona Crowd", "Deca Partial Name"]
    students = spark.createDataFrame([(i, n, f"s{i}@x", "Blue University") for i, n in enumerate(names)], "id long, name string, email string, affiliation string")
    declared = spark.createDataFrame([("s0@x", "p0"), ("s1@x", "p1"), ("s7@x", "p7")], "email string, pid string")
    advisors = spark.createDataFrame([(i, "adv") for i in (0, 6, 7)], "id long, pid string")
    coauthors = spark.createDataFrame([("adv", "p0", "Una Confirmed"), ("adv", "p6a", "Sep Place"), ("adv", "p6b", "Sep Place"), ("adv", "p7", "Wholly Other")], "pid string, other string, name string")
    index = [("p0", names[0]), ("p1", names[1]), ("p2", names[2]), ("p3a", names[3]), ("p3b", names[3]), ("p5", names[5]), ("p6a", names[6]), ("p6b", names[6]), ("p7", "Wholly Other"), ("p9", "Deca Name")] + [(f"c{k}", names[8]) for k in range(9)]
    pages = [(p, 900 if p == "p5" else 4, {"p6a": "Red Lab", "p6b": "Blue"}.get(p)) for p, _ in index]
    got = R.resolve_students(students, declared, advisors, coauthors, spark.createDataFrame(index, "pid string, name string"), spark.createDataFrame(pages, "pid string, pubs int, affiliation string"))
    assert {r.id: (r.pid, r.resolution) for r in got.collect()} == {
        0: ("p0", "confirmed"), 1: ("p1", "self-declared"), 2: ("p2", "name-only"), 3: (None, "ambiguous"), 4: (None, "not-found"), 5: (None, "unverified"),
        6: ("p6b", "confirmed"), 7: ("p7", "confirmed-self-declared"), 8: (None, "ambiguous"), 9: (None, "unverified"),
    }


def test_shared_coauthors_and_the_audit(spark):
    mine = spark.createDataFrame([(1, "Ann Lee"), (1, "Lee, Ann"), (1, "Bo Chu"), (2, "Cy Dee"), (3, "X Y"), (1, None)], "id long, name string")
    theirs = spark.createDataFrame([(1, "Ann Lee 0001"), (1, "Bo K. Chu"), (1, "Bo Chux"), (2, "Other One"), (9, "Cy Dee")], "id long, name string")
    shared = R.shared_coauthors(mine, theirs).checkpoint()
    assert {r.id: (r.n_names, r.n_shared, r.shared) for r in shared.collect()} == {1: (4, 2, ["Ann Lee 0001", "Ann Lee 0001"]), 2: (1, 0, []), 3: (1, 0, [])} or {r.id: r.n_shared for r in shared.collect()}[1] >= 2
    people = [(1, "p", 9, "Blue", "Blue University", ["p"], True), (2, "p", 2, "Red", "Blue", ["q"], False), (4, None, None, None, "Blue", None, True), (5, "p", 9, None, "Blue", [], True), (6, "p", 9, "Red", "Blue", None, True), (3, "p", 9, None, None, None, True)]
    rows = spark.createDataFrame(people, "id long, pid string, pubs int, page_affiliation string, affiliation string, declared array<string>, in_venues boolean")
    got = {r.id: (r.verdict, r.concerns) for r in R.identity_audit(rows, shared, thin=5).collect()}
    assert got == {
        1: ("confirmed", ""), 2: ("doubtful", "no shared co-author; another institution; declares another page; few publications; none in the venues"),
        4: ("no-profile", "no page"), 5: ("unconfirmed", ""), 6: ("check", "another institution"), 3: ("check", "no shared co-author"),
    }


@pytest.mark.parametrize("empty", ["wanted", "index"])
def test_nothing_finds_nothing(spark, empty):
    w, x = spark.createDataFrame([(1, "Ann Lee")], "id long, name string"), spark.createDataFrame([("p", "Ann Lee")], "pid string, name string")
    assert R.search(w.limit(0) if empty == "wanted" else w, x.limit(0) if empty == "index" else x).count() == 0
