"""Columns, names, readers, sinks, connectors and streams on small cases."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import conflicts, country, diffs, eventlog, identity, metrics
from weftline.policy import Policy
from weftline.sources import connectors, readers, sinks


def one(spark, column, value="x", kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("o")).first().o


def test_text_columns(spark):
    assert one(spark, T.fold, "  Éva-María  O'Neil ") == "eva maria o neil"
    assert one(spark, T.token_set, "Zoë Q. Adams 0002") == ["adams", "zoe"]
    assert one(spark, T.homonym_number, "Ann Lee 0003") == "0003"
    assert one(spark, T.parse_pid, "https://x.org/pod/12/3456.html") == "12/3456"
    assert one(spark, T.parse_pid, " l/AnnLee-1 ") == "l/AnnLee-1"
    assert one(spark, T.parse_pid, "nothing here") is None
    assert one(spark, T.split_ids, "a; -,b;;") == ["a", "", "b"]
    assert one(spark, T.split_ids, None) == []
    assert one(spark, T.normalise_doi, "https://doi.org/10.1145/ABC.12).") == "10.1145/abc.12"
    assert one(spark, T.tag_names, "~~ex-rr pc-Light track_3#7") == ["ex-rr", "pc-light", "track_3"]
    assert one(spark, T.registrable_domain, "a@mail.b.edu") == "b.edu"
    assert one(spark, T.registrable_domain, "name only") == ""
    assert one(spark, T.local_part, "Ann.Lee@x.org") == "ann lee"
    assert one(spark, T.camel_words, "AnnLee") == "Ann Lee"
    assert one(spark, T.strip_markup, "<p>a &amp;  b</p>") == "a & b"
    assert one(spark, lambda c: T.one_tier(c), "pc-full pc-light") is None
    assert one(spark, lambda c: T.structural_role(c, F.lit("x-area-chairs")), "pc") == "area-chair"
    lines = one(spark, T.collaborator_lines, "Ann Lee (U of X)\n\nAll (Y Corp)")
    assert [(x.name, x.institution) for x in lines] == [("Ann Lee", "U of X"), ("All", "Y Corp")]


def test_names():
    assert identity.compare_names(["ann", "lee"], ["ann", "lee"]) == (3, "exact")
    assert identity.compare_names(["lee", "ann"], ["ann", "lee"])[1] == "reordered"
    assert identity.compare_names(["annlee"], ["lee", "ann"])[1] == "glued"
    assert identity.compare_names(["ann", "lee"], ["ann", "may", "lee"])[1] == "variant"
    assert identity.compare_names(["christopher", "lee"], ["kristopher", "lee"]) == (1, "similar")
    assert identity.compare_names(["ann"], ["bob"]) == (0, "none")
    assert identity.compare_names("jon smithson".split(), "jon lee smithsen".split()) == (2, "variant")
    assert identity.compare_names(["fredericson"], ["frederickson"]) == (1, "similar")
    assert identity.compare_names(["lee"], ["ann", "lee"]) == (0, "none")
    assert identity.compare_names("xin chen".split(), "xin cen".split()) == (0, "none")
    assert identity.compare_names("kristopher smithson".split(), "christopher smithsen".split()) == (0, "none")
    assert identity.respelt(["jansen", "eva"], ["jansan", "eva"])
    assert not identity.respelt(["jansen", "jansun", "eva"], ["jansan", "otto", "eva"])  # one partner for two


def test_confidence_of_pairs(spark):
    cases = [
        ((3, True, False, False, False, False), "high"), ((0, True, False, True, False, False), "review"), ((3, False, True, True, True, True), "low"), ((0, False, True, False, False, False), None),
        ((3, False, False, False, False, True), "high"), ((3, False, False, False, False, False), "medium"), ((2, False, False, False, True, False), "medium"), ((2, False, False, False, False, False), "low"),
        ((1, False, False, True, False, False), "low"), ((0, False, False, True, True, True), None),
    ]
    rows = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, strength int, a boolean, b boolean, c boolean, d boolean, e boolean")
    got = rows.select("i", identity.confidence(*[F.col(x) for x in ("strength", "a", "b", "c", "d", "e")]).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [x for _, x in cases]


def test_short_names_are_no_conflict(spark):
    rows = [(["ann"], ["ann"], None), (["ann", "lee"], ["ann", "lee"], "exact"), (["ann", "lee"], ["ann", "lee", "may"], "partial"), (["ann"], ["ann", "lee"], None), (["ann", "lee"], ["ann", "may"], None)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>, want string").select("want", T.names_match(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_log_anomalies(spark):
    from weftline.operators import eventlog

    rows = [(1, 1, "on", "a", 7), (1, 2, "on", "b", 7), (1, 3, "off", "a", 7), (1, 4, "off", "a", 7), (2, 1, "off", "a", 7), (2, 2, "on", "a", 7), (2, 3, "off", "a", 8), (3, 1, "on", "a", 7), (3, 2, "off", "a", 7), (3, 3, "on", "b", 9)]
    df = spark.createDataFrame(rows, "k int, seq int, verb string, who string, paper int")
    got = {(r.k, r.seq): r.anomaly for r in eventlog.anomalies(df, "k", "seq", "verb", "on", "off", "who", "paper").collect()}
    assert got == {(1, 2): "reassigned", (1, 3): "other address", (1, 4): "not assigned", (2, 1): "not assigned", (2, 3): "other paper"}


def test_levels(spark):
    from weftline.operators import seniority
    from weftline.policy import Policy

    rows = [("a", "One Title.", "X", 2001), ("a", "one title", "X", 2001), ("a", "", "X", 2001), ("a", "Later", "X", 2002), ("b", "t1", "Z", 1990), ("b", "t2", "Z", 1991), ("b", "t3", "Z", 1992), ("c", "u1", "X", 1990), ("c", "u2", "X", 1991), ("c", "u3", "Z", 1992), ("d", "v1", "X", 2000), ("d", "v2", "X", 2001), ("d", "v3", "X", None)]
    got = {r.k: (r.pubs, r.career, r.window, r.level) for r in seniority.classify(spark.createDataFrame(rows, "k string, title string, venue string, year int"), "k", ["X"], current_year=2001, policy=Policy(seniority_window=2, senior_rate=1.0, junior_pubs=3, out_of_area_career=2)).collect()}
    assert got == {"a": (2, 2, 1, "junior"), "b": (3, 0, 0, "out-of-area"), "c": (3, 2, 0, "typical"), "d": (2, 2, 2, "senior")}


def test_country_domains_and_cells(spark):
    from weftline.operators import country

    got = spark.createDataFrame([(x,) for x in ("a@b.ly", "a@b.uk", "a@b.de", "a@b.zz", "a@b.eu", "a@b.com", "nobody")], "m string").select(country.country_from_email(F.col("m")).alias("c")).collect()
    assert [r.c for r in got] == [None, "GB", "DE", None, None, None, None]
    cells = spark.createDataFrame([(x,) for x in (" de ", "The Netherlands", "nowhere", None)], "m string").select(country.country_from_cell(F.col("m"), {"netherlands": "NL"}).alias("c")).collect()
    assert [r.c for r in cells] == ["DE", "NL", None, None]


def test_accounts_by_waterfall(spark):
    accounts = spark.createDataFrame([("a@x.org", "Ann Lee"), ("bob@x.org", "Bob Ray"), ("c@x.org", "Cy Dee")], "email string, name string")
    people = spark.createDataFrame([("A@x.org", "other"), ("q@z.org", "Lee Ann"), ("bob@else.org", "nobody known"), ("Cy Dee", "")], "email string, name string")
    got = {r.email: (r.match, r.how) for r in identity.match_accounts(people, accounts).collect()}
    assert got == {"A@x.org": ("a@x.org", "email"), "q@z.org": ("a@x.org", "name"), "bob@else.org": ("bob@x.org", "local-part"), "Cy Dee": ("c@x.org", "name")}


def test_homonyms_and_windows(spark):
    people = spark.createDataFrame([("r", "p1", [["me", "self"]])], "person_id string, pid string, own_tokens array<array<string>>")
    rows = spark.createDataFrame([("p1", "Ann Lee 0002", 2026, "w"), ("p1", "Bob Ray", 2010, "old"), ("p1", "Self Me", 2026, "own")], "pid string, name string, year int, title string")
    index = conflicts.coauthor_index(people, rows, years=5, current_year=2026)
    assert [r.tokens for r in index.collect()] == [["ann", "lee"]]
    authors = spark.createDataFrame([(1, "Ann Lee", ["ann", "lee"], ["0001"]), (2, "Ann Lee", ["ann", "lee"], []), (3, "Ann M Lee", ["ann", "lee", "may"], [])], "paper_id int, author string, tokens array<string>, numbers array<string>")
    assert {r.paper_id: r.match for r in conflicts.coauthor_conflicts(authors, index).collect()} == {2: "exact", 3: "partial"}


def test_country_names_of_any_length_and_outranked_regions(spark):
    names = [("congo", "CG", None), ("democratic republic of the congo", "CD", None), ("saint vincent and the grenadines", "VC", None), ("saint vincent", "XX", None), ("a", "CN", "HK"), ("b", "HK", "CN")]
    names = spark.createDataFrame(names, "name string, country string, outranks string")
    rows = spark.createDataFrame([(1, "Lab, Democratic Republic of the Congo"), (2, "Saint Vincent and the Grenadines"), (3, "x b y a"), (4, ""), (5, None), (6, "of the Congo")], "k long, t string")
    assert {r.k: r.country for r in country.country_from_text(rows, "k", "t", names).collect()} == {1: "CD", 2: "VC", 3: "CN", 6: "CG"}
    assert country.country_from_text(rows, "k", "t", names.limit(0)).count() == 0


def test_country_from_text(spark):
    names = spark.createDataFrame([("Korea", "KR", None), ("China", "CN", None), ("Hong Kong", "HK", "CN")], "name string, country string, outranks string")
    rows = spark.createDataFrame([(1, "Univ of Hong Kong, China"), (2, "KAIST Korea"), (3, "Nowhere")], "k int, t string")
    assert {r.k: r.country for r in country.country_from_text(rows, "k", "t", names).collect()} == {1: "HK", 2: "KR"}


def test_readers_and_sinks(spark, tmp_path):
    log = tmp_path / "log.csv"
    log.write_text("date,ipaddr,email,roles,affected_email,via,paper,action\n2026-08-02,,Chair@x.org,,R@x.org,,1,Review 7 unassigned\n2026-08-01,,chair@x.org,,r@x.org,,1,\"Review 7 assigned: primary, round R1\"\n2026-08-01,,chair@x.org,,s@x.org,,2,\"Review 8 assigned: primary, round R1\"\n")
    rows = eventlog.parse_actions(readers.action_log(spark, str(log)))
    assert [(r.review, r.kind, r["round"]) for r in eventlog.live(rows, "review", "sequence", "verb", "assigned").collect()] == [(8, "primary", "R1")]
    out = tmp_path / "up.csv"
    picks = spark.createDataFrame([(2, "b@x.org", 0.5), (1, "a@x.org", 0.9)], "paper_id int, person_id string, score double")
    names = spark.createDataFrame([("a@x.org", "account@x.org")], "person_id string, account_email string")
    sinks.write_upload(picks, names, str(out))
    assert out.read_text().splitlines() == ["paper,action,email,round", "all,clearreview,all,R1", "1,primaryreview,account@x.org,R1", "2,primaryreview,b@x.org,R1"]
    back = {(r.paper_id, r.person_id) for r in readers.assignments(spark, str(out)).collect()}
    assert back == {(1, "account@x.org"), (2, "b@x.org")}
    bad = tmp_path / "bad.csv"
    bad.write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        readers.assignments(spark, str(bad))
    papers = tmp_path / "papers.json"
    papers.write_text(json.dumps([{"pid": 1, "title": "T", "topics": ["M"], "authors": [{"email": "a@x.org"}]}]))
    assert readers.papers(spark, str(papers)).first().authors[0].email == "a@x.org"
    cache = tmp_path / "cache.json"
    cache.write_text(json.dumps({"p1": [[2024, "one"], [None, "no year"]]}))
    assert [(r.pid, r.year, r.title) for r in readers.title_cache(spark, str(cache)).collect()] == [("p1", 2024, "one")]
    assert readers.csv(spark, str(tmp_path / "none.csv"), required=False).count() == 0
    xml = tmp_path / "bib.xml"
    xml.write_text('<dblp><www key="homepages/1/2"><author>Ann Lee</author><note>U</note></www><article key="j/1"><author>Ann Lee</author><author>Bob Ray</author><title>T</title><year>2020</year><journal>J</journal><ee>https://doi.org/10.1000/1</ee></article></dblp>')
    who = readers.bibliography_people(spark, str(xml))
    works, together = readers.bibliography_works(spark, str(xml), who)
    assert [(r.pid, r.doi) for r in works.collect()] == [("1/2", "10.1000/1")] and [r.name for r in together.collect()] == ["Bob Ray"]


def test_tags(spark):
    placed = spark.createDataFrame([(5, 2)], "paper_id int, track int")
    assert sinks.paper_tags(spark, placed, 3).count() == 4
    assert [r.tag for r in sinks.stray_tags(spark.createDataFrame([(["~~Track_9#1", "track_2", "x"],)], "tags array<string>"), 3).collect()] == ["track_9"]
    with pytest.raises(ValueError):
        sinks.disable_users(spark.createDataFrame([("a",), ("a",)], "email string"), {"a"})


class _Answer:
    def __init__(self, code, after=None):
        self.status_code, self.headers = code, {"Retry-After": after} if after else {}

    def raise_for_status(self):
        if self.status_code >= 400:
            raise RuntimeError("status")


def test_patience():
    waits, answers = [], [_Answer(429, "7"), _Answer(503), ConnectionError(), _Answer(200)]

    class Session:
        def get(self, *_, **__):
            x = answers.pop(0)
            if isinstance(x, Exception):
                raise x
            return x

    assert connectors.get_with_retry(Session(), "u", sleep=waits.append).status_code == 200
    assert waits[0] == 7 and len(waits) == 3 and connectors.backoff(15, 9) == connectors.CEILING_S
    failed = []
    got = connectors.fetch_all("abcdefg", lambda k: 1 / 0, cached=[{"a": 1}], sleep=lambda s: None, on_error=lambda k, e: failed.append(k))
    assert got == {"a": 1} and failed == list("bcdef")


def test_diffs(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b")], "paper_id int, person_id string")
    new = spark.createDataFrame([(1, "b"), (1, "c")], "paper_id int, person_id string")
    r = diffs.by_paper(diffs.changed_pairs(old, new)).first()
    assert (r.removed, r.added) == (["a"], ["c"])


def test_policy():
    with pytest.raises(ValueError):
        Policy(country_majority=0)
    assert Policy().per_paper == 5


def test_a_vector_cache_is_read_by_many_tasks(spark, tmp_path):
    entries = {f"p{i} \u00e9, {i}": {"vector": [i / 7, -1e-9, float(i)], "fingerprint_key": None if i % 5 == 0 else f"k:{i}"} for i in range(400)}
    want = sorted((k, e["vector"], e["fingerprint_key"]) for k, e in entries.items())
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        for indent, size in ((None, "2k"), (1, "2k"), (None, before)):
            (tmp_path / "cache.json").write_text(json.dumps(entries, indent=indent))
            spark.conf.set(name, size)
            got = readers.embedding_cache(spark, str(tmp_path / "cache.json"))
            assert sorted(map(tuple, got.collect())) == want
            assert size == before or got.rdd.getNumPartitions() > 8
    finally:
        spark.conf.set(name, before)
    (tmp_path / "empty.json").write_text("{}")
    assert readers.embedding_cache(spark, str(tmp_path / "empty.json")).count() == 0
    (tmp_path / "bad.json").write_text('{"a}b": {"vector": [1.0], "fingerprint_key": "x"}}')
    with pytest.raises(Exception, match="not an entry"):
        readers.embedding_cache(spark, str(tmp_path / "bad.json")).collect()


def test_rosters_are_completed_with_where_each_field_is_from(spark):
    from weftline.operators.rosters import complete

    schema = "k string, name string, area string, form string"
    form = spark.createDataFrame([("a", "Ann", " ", "x"), ("a", "Abe", None, "x"), ("b", None, "arch", "x"), (None, "N", "n", "x")], schema)
    tagged = spark.createDataFrame([("b",), ("c",), ("c",), ("d",)], "k string")
    one = spark.createDataFrame([("b", "Bob", "z", ""), ("c", "", "mem", ""), ("x", "Xa", "q", "")], schema)
    two = spark.createDataFrame([("a", "Zed", "net", ""), ("c", "Cy", "other", "")], schema)
    got = {r.k: tuple(r)[1:] for r in complete(form, tagged, [("one", one), ("two", two)], "k", ["name", "area"]).collect()}
    assert got == {
        "a": ("form", "Abe", "form", "net", "two", []), "b": ("both", "Bob", "one", "arch", "form", []),
        "c": ("tagged", "Cy", "two", "mem", "one", []), "d": ("tagged", None, None, None, None, ["name", "area"]),
    }
    assert complete(form.limit(0), tagged.limit(0), [("one", one)], "k", ["name"]).count() == 0


def test_rollups_equal_separate_sums(spark):
    rows = spark.createDataFrame([("r", None, 1), ("r", "t", 2), (None, "t", 4), (None, None, 8)], "role string, tier string, v int")
    got = {tuple(r) for r in metrics.rollups(rows, ["role", "tier"], [["role", "tier"], ["role"], []], {"v": F.sum("v")}).collect()}
    assert got == {("role+tier", "r", None, 1), ("role+tier", "r", "t", 2), ("role+tier", None, "t", 4), ("role+tier", None, None, 8), ("role", "r", None, 3), ("role", None, None, 12), ("all", None, None, 15)}


def test_names_in_ids_and_cells(spark):
    row = spark.sql("select 1 x").select(
        T.pid_name(F.lit("o/KunleOlukotun")).alias("a"), T.pid_name(F.lit("12/345")).alias("b"), T.pid_name(F.lit("w/WeiZhang12")).alias("c"), T.split_people(F.lit(" A B (or C) / D or E ")).alias("d"),
        T.split_people(F.lit(None).cast("string")).alias("e"), T.is_everyone(F.lit(" All ")).alias("f"), T.role_label(F.lit("trc")).alias("g"), T.role_label(F.lit("x")).alias("h"), T.split_people(F.lit("Victor Orton")).alias("i"),
    ).first()
    assert tuple(row) == ("Kunle Olukotun", None, "Wei Zhang", ["A B", "C", "D", "E"], [], True, "TRC members", None, ["Victor Orton"])


def test_token_relation(spark):
    from weftline.operators.identity import token_relation

    cases = [(["ann", "lee"], ["ann", "lee"], "exact"), (["ann", "lee"], ["ann", "bo", "lee"], "partial"), (["lee"], ["ann", "lee"], None), ([], [], None), (["ann", "schmidt"], ["ann", "schmitt"], "partial"), (["ann", "lee"], ["bo", "kim"], None)]
    rows = spark.createDataFrame(cases, "a array<string>, b array<string>, want string").select("want", token_relation()("a", "b").alias("got"))
    assert all(r.want == r.got for r in rows.collect())


def test_paper_people(spark):
    from weftline.operators.conflicts import paper_people

    slots = spark.createDataFrame([(1, "A@x.org ", "Wei Zhang", "X"), (1, "b@y.org", "Bo Kim", "Y"), (1, "b@y.org", "Bo Kim", "Y"), (2, None, "", None)], "paper_id long, email string, name string, affiliation string")
    declared, known = spark.createDataFrame([("a@x.org", "p1")], "email string, pid string"), spark.createDataFrame([("p1", "Wei Zhang 0012"), ("p1", "W. L. Zhang Li")], "pid string, name string")
    got = {(r.email, tuple(r.tokens)): r.numbers for r in paper_people(slots, declared, known).collect()}
    assert got == {("a@x.org", ("wei", "zhang")): ["0012"], ("a@x.org", ("li", "zhang")): [""], ("b@y.org", ("bo", "kim")): []}


def test_encoder_sees_each_text_once(spark):
    from weftline.operators.pairs import encoded

    rows = spark.createDataFrame([(i, "ab" * (i % 7)) for i in range(100)] + [(100, None)], "k long, t string")
    load = lambda: lambda texts: [[len(x), 1.0] for x in texts]
    got = {r.k: r.vector for r in encoded(rows, "k", "t", load, batch=8).collect()}
    assert len(got) == 101 and got[100] == [0.0, 1.0] and all(abs(v[0] / v[1] - 2 * (k % 7)) < 1e-9 for k, v in got.items() if k < 100)
    assert encoded(rows.limit(0), "k", "t", load).count() == 0


def test_pinned_pairs_and_patches(spark):
    from weftline.operators.matching import outside, seed_used
    from weftline.operators.pairs import pinned_scores

    pairs = lambda rows: spark.createDataFrame(rows, "paper_id long, person_id string")
    papers, people = spark.createDataFrame([(1, [1.0, 0.0])], "paper_id long, vector array<double>"), spark.createDataFrame([("a", [0.6, 0.8])], "person_id string, vector array<double>")
    got = pinned_scores(pairs([(1, "a"), (1, "b"), (2, "a")]), pairs([(2, "a")]), papers, people).collect()
    assert sorted((r.paper_id, r.person_id, r.affinity, r.missed) for r in got if r.affinity is not None) == [(1, "a", 0.6, False)] and sum(r.missed for r in got) == 1
    used = seed_used(pairs([(1, "a"), (1, "b"), (2, "a"), (3, "a"), (1, "a")]), pairs([(0, "b")]), pairs([(1, ""), (2, "")]))
    assert [tuple(r) for r in used.collect()] == [("a", 2)] and [r[0] for r in outside(pairs([(1, "a"), (2, "a")]), pairs([(1, "")])).collect()] == [2]


def test_percentiles_of_ties_and_nulls(spark):
    from weftline.operators.metrics import percentiles

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.0, 2.5, 9.0])) for _ in range(400)] + [("one", 3.0)]
    got = {r.k: (r.p0, r.p50, r.p95) for r in percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95}).collect()}
    for k, values in got.items():
        mine = sorted((v for x, v in rows if x == k), key=lambda v: (v is not None, v or 0))
        assert values == tuple(mine[round(q * (len(mine) - 1))] for q in (0.0, 0.5, 0.95))
    assert len(got) == 4


def test_layout():
    from weftline.sources.layout import Layout

    assert Layout("s3://b/").path("report", "x.txt") == "s3://b/outputs/reports/x.txt"
    with pytest.raises(ValueError):
        Layout("/r").path("other", "x")


def test_collaborators_of_papers_with_several_authors_are_not_shuffled_as_pairs(spark):
    from weftline.operators.conflicts import collaborator_conflicts

    kind = "tokens array<string>, declared array<array<string>>, institutions array<string>"
    people = spark.createDataFrame([(1, ["a", "b"], [["c", "d"], ["e", "f"], ["g"]], ["x", "y"]), (2, ["c", "d"], [], ["z"]), (3, ["q"], None, ["x", None])], f"person_id long, {kind}")
    authors = spark.createDataFrame([(7, "p", ["e", "f"], [["a", "b"]], ["x"]), (7, "q", ["c", "d"], [["q"]], ["y"]), (8, "r", ["g"], [["c", "d"], ["a", "b"]], ["z"]), (9, "s", ["k", "l"], [], ["y", "x", None])], f"paper_id long, author string, {kind}")
    out = collaborator_conflicts(people, authors)
    got = sorted((r.paper_id, r.person_id, r.kind, r.evidence) for r in out.collect())
    assert got == [(7, 1, "person_declared", "c d"), (7, 3, "institution", "x"), (8, 1, "author_declared", "a b"), (8, 2, "author_declared", "c d"), (9, 1, "institution", "x"), (9, 3, "institution", "x")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


def test_duplicate_pairs_are_made_once_without_a_shuffle_of_pairs(spark):
    from pyspark.sql import functions as F

    from weftline.operators.identity import duplicate_pairs

    rows = spark.createDataFrame([(1, ["x", "y", None]), (2, ["y", "x"]), (3, ["z", "y"]), (1, ["z"]), (4, None), (5, [None])], "id long, keys array<string>")
    out = duplicate_pairs(rows, "id", F.col("keys"))
    assert sorted(map(tuple, out.collect())) == [(1, 2), (1, 3), (2, 3)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]
