"""Queries on conflicts, countries and vectors, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import vectors as V
from weftline.operators import conflicts, country, pairs
from weftline.operators.blocks import Scored
from weftline.plans.registry import Registry

_r = Registry()
query, QUERIES, ORACLES = _r.query, _r.queries, _r.oracles

#: papers and people from the embeddings: vec_id % 5 = 0 are papers
PAPERS_SQL = "papers as (select vec_id paper_id, list_distinct([label, cast(vec_id // 5 % 10 as int)]) topics, embedding::double[] v from embeddings where vec_id % 5 = 0)"
PEOPLE_SQL = "people as (select vec_id person_id, [label, (label + 1) % 10] areas, embedding::double[] v from embeddings where vec_id % 5 <> 0)"
GATED_SQL = f"""{PAPERS_SQL}, {PEOPLE_SQL},
gate as (select distinct paper_id, person_id from (select paper_id, unnest(topics) area from papers) join (select person_id, unnest(areas) area from people) using (area)),
scored as (select paper_id, person_id, round(list_dot_product(p.v, r.v), 6) affinity from gate join papers p using (paper_id) join people r using (person_id) where (paper_id * 7 + person_id * 13) % 23 <> 0)"""


def papers_of(e):
    return e.where("vec_id % 5 = 0").select(F.col("vec_id").alias("paper_id"), F.transform(F.array_distinct(F.array(F.col("label"), F.expr("cast(vec_id div 5 % 10 as int)"))), lambda x: x.cast("string")).alias("topics"), F.col("embedding").alias("vector"))


def people_of(e):
    return e.where("vec_id % 5 <> 0").select(F.col("vec_id").alias("person_id"), F.transform(F.array(F.col("label"), (F.col("label") + 1) % 10), lambda x: x.cast("string")).alias("areas"), F.col("embedding").alias("vector"))


def _barred(paper, person):
    return (paper * 7 + person * 13) % 23 == 0


def scored_of(e):
    """Gated pairs that no conflict bars, with affinities, in blocks."""
    return Scored(papers_of(e), people_of(e), _barred)


@query(f"with {GATED_SQL} select paper_id, person_id, affinity, rank from (select *, row_number() over (partition by paper_id order by affinity desc, person_id) rank from scored) where rank <= 5")
def topk_gated(t):
    return scored_of(t("embeddings")).best(5)


@query(f"with {GATED_SQL} select paper_id, count(*) n_eligible, round(avg(affinity), 4) mean_affinity from scored group by 1")
def pool_floor(t):
    return scored_of(t("embeddings")).sums(1).select("paper_id", F.col("n").alias("n_eligible"), F.round("mean", 4).alias("mean_affinity"))


@query("""
with p as (select vec_id, embedding::double[] v from embeddings),
s as (select a.vec_id, b.vec_id other, round(list_dot_product(a.v, b.v), 6) affinity from p a join p b on a.vec_id <> b.vec_id)
select vec_id, other, affinity, rank from (select *, row_number() over (partition by vec_id order by affinity desc, other) rank from s) where rank <= 3""")
def nearest_neighbors(t):
    """Every row against all others, block by block."""
    e = t("embeddings")
    return pairs.nearest(e, e, "vec_id", "embedding", 3)


@query("""
with x as (select label, vec_id % 3 + 1.0 w, unnest(embedding::double[]) x, generate_subscripts(embedding, 1) - 1 place from embeddings),
m as (select label, place, sum(w * x) / sum(w) m from x group by 1, 2), n as (select label, sqrt(sum(m * m)) n from m group by 1)
select label, cast(place as int) place, round(m / n, 6) x from m join n using (label)""")
def pool_vectors(t):
    pooled = V.pool(t("embeddings"), ["label"], "embedding", F.col("vec_id") % 3 + F.lit(1.0))
    return pooled.select("label", F.posexplode("vector").alias("place", "x")).select("label", "place", F.round("x", 6).alias("x"))


@query("""
with a as (select vec_id, label, row_number() over (partition by label order by vec_id) r from embeddings), b as (select vec_id, label, row_number() over (partition by label order by vec_id % 7, vec_id) r from embeddings),
x as (select label, list(vec_id) s from a where r <= 10 group by 1), y as (select label, list(vec_id) s from b where r <= 10 group by 1)
select label, round(1.0 - len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))), 6) disagreement from x join y using (label)""")
def jaccard_disagreement(t):
    e = t("embeddings").select("vec_id", "label")
    one = pairs.top_k(e, "label", [F.asc("vec_id")], 10)
    other = pairs.top_k(e, "label", [F.asc(F.col("vec_id") % 7), F.asc("vec_id")], 10)
    return pairs.disagreement(one, other, "label", "vec_id", 10).withColumn("disagreement", F.round("disagreement", 6))


@query("""
select vec_id, label, turn from (select vec_id, label, row_number() over (partition by label order by vec_id % 13 desc, vec_id) turn from embeddings) order by turn, label limit 25""")
def stratified_sample(t):
    return pairs.stratified(t("embeddings").select("vec_id", "label"), "label", [F.desc(F.col("vec_id") % 13), F.asc("vec_id")], 25)


@query("select doc_id, sha256(coalesce(lang, '') || chr(0) || coalesce(source, '') || chr(0) || coalesce(text, '')) content_key from documents")
def content_keys(t):
    return t("documents").select("doc_id", pairs.content_key(F.col("lang"), F.col("source"), F.col("text")).alias("content_key"))


@query("select user_id, event_id, round(cast(concat('0x', sha256('2027:' || user_id || ':' || event_id)[1:13]) as bigint) / 4503599627370496.0, 9) score from events")
def random_scores(t):
    return t("events").select("user_id", "event_id", F.round(pairs.hash_score(2027, F.col("user_id"), F.col("event_id")), 9).alias("score"))


@query("""
with l as (select l_orderkey, l_suppkey, year(o_orderdate) y from lineitem join orders on l_orderkey = o_orderkey where year(o_orderdate) >= 1997),
s as (select a.l_suppkey a, b.l_suppkey b, count(distinct a.l_orderkey) shared, max(a.y) latest_year from l a join l b using (l_orderkey) where a.l_suppkey < b.l_suppkey group by 1, 2)
select a, b, shared, latest_year from s where shared >= 3""")
def coauthor_pairs(t):
    lines = t("lineitem").select("l_orderkey", "l_suppkey")
    # Tasks by rows, as an aggregation holds all pairs of its task, of which few are equal.
    parts = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), lines.count() // 1_000_000)
    years = t("orders").where(F.year("o_orderdate") >= 1997).select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("y"))
    rows = lines.repartition(parts, "l_orderkey").join(years, "l_orderkey").distinct()
    both = rows.alias("l").join(rows.select("l_orderkey", F.col("l_suppkey").alias("b")).alias("r"), "l_orderkey").where(F.col("l_suppkey") < F.col("b"))
    each = both.select(F.col("l_suppkey").alias("a"), "b", "y").repartition(parts, "a", "b")
    return each.groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("y").alias("latest_year")).where("shared >= 3")


@query("""
with a as (select distinct l_partkey paper_id, l_suppkey person_id from lineitem where l_linenumber = 1), b as (select distinct l_partkey paper_id, l_suppkey person_id from lineitem where l_quantity > 40), c as (select distinct l_partkey paper_id, l_suppkey person_id from lineitem where l_returnflag = 'R'),
u as (select *, 0 rank, 'own' layer from a union all select *, 1, 'coauthor' from b union all select *, 2, 'collaborator' from c),
d as (select distinct l_partkey paper_id, l_suppkey person_id from lineitem where l_linestatus = 'F')
select paper_id, person_id, arg_min(layer, rank) layer, string_agg(layer, ',' order by layer) layers, bool_or(d.paper_id is not null) declared from u left join d using (paper_id, person_id) group by 1, 2""")
def conflict_layers(t):
    rows = t("lineitem").select(F.col("l_partkey").alias("paper_id"), F.col("l_suppkey").alias("person_id"), "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    layer = lambda c: rows.where(c).select("paper_id", "person_id").distinct()
    return conflicts.merge_layers([("own", layer("l_linenumber = 1")), ("coauthor", layer("l_quantity > 40")), ("collaborator", layer("l_returnflag = 'R'"))], layer("l_linestatus = 'F'"))


@query("""
with p as (select s_suppkey person_id, [s_suppkey % 50, s_suppkey % 7 + 50, s_suppkey % 11 + 60] tok, s_suppkey % 9 + 1 shared from supplier),
a as (select p_partkey paper_id, [p_partkey % 50, p_partkey % 7 + 50, p_partkey % 11 + 60][1:2 + p_partkey % 2] tok from part),
m as (select paper_id, person_id, shared, case when list_sort(a.tok) = list_sort(p.tok) then 'exact' when len(list_intersect(a.tok, p.tok)) = len(a.tok) then 'partial' end match
  from (select *, unnest(tok) t from a) a join (select *, unnest(tok) t from p) p on a.t = p.t)
select distinct paper_id, person_id, match, shared from m where match is not null""")
def coauthor_conflicts(t):
    name = lambda k, n: F.array_sort(F.slice(F.array(*[F.concat(F.lit("tok"), x.cast("string")) for x in (k % 50, k % 7 + 50, k % 11 + 60)]), F.lit(1), n))
    k, q = F.col("s_suppkey"), F.col("p_partkey")
    index = t("supplier").select(k.alias("person_id"), name(k, F.lit(3)).alias("tokens"), F.lit("").alias("number"), (k % 9 + 1).alias("shared"), F.lit(2000).alias("latest_year"), F.lit("w").alias("latest_title"))
    authors = t("part").select(q.alias("paper_id"), q.cast("string").alias("author"), name(q, (q % 2 + 2).cast("int")).alias("tokens"), F.array().cast("array<string>").alias("numbers"))
    return conflicts.coauthor_conflicts(authors, index).select("paper_id", "person_id", "match", "shared")


@query("""
with p as (select s_suppkey person_id, s_suppkey % 40 me, s_suppkey % 30 declared, s_suppkey % 60 inst from supplier), a as (select p_partkey paper_id, p_partkey % 40 me, p_partkey % 35 declared, p_partkey % 80 inst from part),
u as (select paper_id, person_id, 1 k from a join p on p.declared = a.me union all select paper_id, person_id, 2 from a join p on a.declared = p.me union all select paper_id, person_id, 3 from a join p on a.inst = p.inst)
select paper_id, person_id, ['person_declared', 'author_declared', 'institution'][min(k)] kind from u group by 1, 2""")
def collaborator_conflicts(t):
    name = lambda x: F.array(F.lit("aa"), F.concat(F.lit("n"), x.cast("string")))
    k, q = F.col("s_suppkey"), F.col("p_partkey")
    people = t("supplier").select(k.alias("person_id"), name(k % 40).alias("tokens"), F.array(name(k % 30)).alias("declared"), F.array((k % 60).cast("string")).alias("institutions"))
    authors = t("part").select(q.alias("paper_id"), q.alias("author"), name(q % 40).alias("tokens"), F.array(name(q % 35)).alias("declared"), F.array((q % 80).cast("string")).alias("institutions"))
    return conflicts.collaborator_conflicts(people, authors).select("paper_id", "person_id", "kind")


@query("""
with a as (select l_orderkey paper_id, case when l_suppkey % 5 = 0 then null else n_name end country from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
p as (select paper_id, count(*) n_authors, count(country) n_placed from a group by 1), m as (select paper_id, country, count(*) n from a where country is not null group by 1, 2),
b as (select paper_id, max(n) n_top, arg_max(country, (n, country)) c from m group by 1)
select paper_id, n_authors, n_placed, n_top, n_placed < n_authors * 0.5 thin, case when not n_placed < n_authors * 0.5 and n_top > n_placed * 0.5 then c end country from p left join b using (paper_id)""")
def country_majority(t):
    nations = t("supplier").join(F.broadcast(t("nation").select("n_nationkey", "n_name")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")  # 25 nations
    rows = t("lineitem").join(nations, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("paper_id"), F.when(F.col("l_suppkey") % 5 != 0, F.col("n_name")).alias("country"))
    return country.paper_countries(rows)


@query("""
with d as (select doc_id, [lower(x) for x in regexp_extract_all(coalesce(text, ''), '[A-Za-z]{4,}')] wanted, [[source, lang], regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,}')[3:6], regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,}')[5:]] notes from documents),
n as (select doc_id, wanted, unnest(notes) note, generate_subscripts(notes, 1) i from d), s as (select doc_id, array_to_string(note, ' ') note, i, len(list_intersect(list_distinct(note), wanted)) shared from n)
select doc_id, arg_min(note, (-shared, i)) note, max(shared) shared from s where shared > 0 group by 1""")
def best_note(t):
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]{4,})"), 1)
    wanted = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Za-z]{4,})"), 1), F.lower)
    rows = t("documents").select("doc_id", wanted.alias("wanted"), F.array(F.array("source", "lang"), F.slice(words, 3, 4), F.slice(words, F.lit(5), F.size(words))).alias("notes"))
    return country.best_note(rows, "doc_id", "wanted", "notes")


@query(r"""
select c_custkey, case when tld in ('com', 'org', 'net', 'io') or len(tld) <> 2 then null when tld = 'uk' then 'GB' else upper(tld) end country
from (select c_custkey, ['com', 'uk', 'de', 'io', 'fr', 'info'][c_custkey % 6 + 1] tld from customer)""")
def country_from_email(t):
    tld = F.element_at(F.array(*[F.lit(x) for x in ("com", "uk", "de", "io", "fr", "info")]), (F.col("c_custkey") % 6 + 1).cast("int"))
    return t("customer").select("c_custkey", country.country_from_email(F.concat(F.lit("a@b."), tld)).alias("country"))


@query(f"""
with {PAPERS_SQL}, {PEOPLE_SQL}, a as (select p.paper_id, r.person_id, case when (p.paper_id + r.person_id) % 4 = 0 then 0.5 end affinity from papers p join people r on r.person_id between p.paper_id + 1 and p.paper_id + 4)
select a.paper_id, a.person_id, round(coalesce(affinity, case when a.person_id % 7 > 0 then list_dot_product(p.v, r.v) end), 6) affinity, affinity is null and a.person_id % 7 = 0 missed
from a join papers p using (paper_id) join people r using (person_id)""")
def backfill_affinity(t):
    e = t("embeddings")
    near = papers_of(e).select("paper_id", F.explode(F.sequence(F.col("paper_id") + 1, F.col("paper_id") + 4)).alias("person_id"))
    rows = near.join(people_of(e).select("person_id"), "person_id", "left_semi").withColumn("affinity", F.when((F.col("paper_id") + F.col("person_id")) % 4 == 0, 0.5))
    return pairs.backfill(rows, papers_of(e), people_of(e).where("person_id % 7 > 0")).select("paper_id", "person_id", F.round("affinity", 6).alias("affinity"), "missed")


_PLACES = (
    ("congo", "CG", None), ("democratic republic of the congo", "CD", None), ("hong kong", "HK", "CN"), ("china", "CN", None), ("korea", "KR", None), ("france", "FR", None),
    ("saint vincent", "XX", None), ("saint vincent and the grenadines", "VC", None),
)
_AFFILIATIONS = ("Institute, Democratic Republic of the Congo", "Hong Kong University of Science, China", "Korea Advanced Institute, Daejeon, Korea", "The Hand Lab", "Blue Universit\u00e9", "Nowhere College")
_NOTES = (("p1", 0, "Red Lab, France"), ("p1", 1, "Blue University, Saint Vincent and the Grenadines"), ("p2", 0, "Blue Lab, Congo"), ("p3", 0, "Green, China"))
_rows = lambda rows: ", ".join("(" + ", ".join("null" if x is None else str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)
_NORMAL = "regexp_replace(trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g')), '^the ', '')"


def _named_sql(source: str, text: str) -> str:
    """Of each k of source the country that its text names."""
    return f"""(with x as (select k, {_NORMAL.format(text)} t from {source}), w as (select k, string_split(t, ' ') w from x),
m as (select k, country, outranks, len(parts) n, i from (select *, unnest(range(1, len(w) + 1)) i from w) join (select string_split(name, ' ') parts, * from n) on w[i:i + len(parts) - 1] = parts),
b as (select *, country in (select outranks from m y where y.k = m.k and outranks is not null) beaten from m)
select k, country from (select *, row_number() over (partition by k order by beaten, n desc, i desc) r from b) where r = 1)"""


@query(f"""
with n(name, country, outranks) as (values {_rows(_PLACES)}), notes(pid, place, note) as (values {_rows(_NOTES)}),
p as (select c_custkey k, [{", ".join(f"'{x}'" for x in _AFFILIATIONS)}][c_custkey % 6 + 1] a, 'u@x.' || ['de', 'com', 'uk', 'jp'][c_custkey // 6 % 4 + 1] e, 'p' || c_custkey % 5 pid, c_custkey % 7 = 0 told from customer),
s as (select k, note, place, len(list_filter(list_distinct(string_split({_NORMAL.format("note")}, ' ')), lambda x: x not in {country.NOTE_WORDS} and list_contains(string_split({_NORMAL.format("a")}, ' '), x))) c from p join notes using (pid)),
q as (select k, note from (select *, row_number() over (partition by k order by c desc, place) r from s where c > 0) where r = 1),
f as (select p.k, case when told then 'BR' end account, case when a = 'The Hand Lab' then 'CH' end hand, nt.country notes, tx.country affiliation, case when e like '%.de' then 'DE' when e like '%.uk' then 'GB' when e like '%.jp' then 'JP' end email
  from p left join {_named_sql("q", "note")} nt on nt.k = p.k left join {_named_sql("p", "a")} tx on tx.k = p.k)
select k, coalesce(account, hand, notes, affiliation, email) country, case when account is not null then 'account' when hand is not null then 'hand' when notes is not null then 'notes' when affiliation is not null then 'affiliation' when email is not null then 'email' else 'unresolved' end layer from f""")
def country_layers(t):
    """Where each customer is by account, curated table, page notes, affiliation and address, with the layer that told."""
    k = F.col("c_custkey")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    people = t("customer").select(
        k.alias("k"), pick(_AFFILIATIONS, k % 6).alias("affiliation"), F.concat(F.lit("u@x."), pick(("de", "com", "uk", "jp"), F.expr("c_custkey div 6 % 4"))).alias("email"),
        F.concat(F.lit("c"), k.cast("string"), F.lit("@y")).alias("account_email"), F.concat(F.lit("p"), (k % 5).cast("string")).alias("pid"),
    )
    spark = people.sparkSession
    accounts = people.where("k % 7 = 0").select(F.upper("account_email").alias("email"), F.lit("br").alias("country"))
    hand = spark.createDataFrame([("hand lab", "CH")], "affiliation string, country string")
    return country.resolve_countries(people, "k", spark.createDataFrame(_PLACES, "name string, country string, outranks string"), accounts=accounts, hand=hand, notes=spark.createDataFrame(_NOTES, "pid string, place int, note string"))
