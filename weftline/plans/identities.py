"""Queries on names, pages and co-authors, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.text import fold
from weftline.operators import resolution
from weftline.plans.people import FOLD_SQL
from weftline.plans.registry import Registry

_r = Registry()
query, QUERIES, ORACLES = _r.query, _r.queries, _r.oracles

_WORDS_SQL = f"list_filter(string_split({FOLD_SQL.format('text')}, ' '), lambda x: len(x) > 1)"


@query(f"""
with w as (select {_WORDS_SQL} w from documents), a as (select distinct list_sort(list_distinct(w[1:4])) a from w where len(w) > 0), b as (select distinct list_sort(list_distinct(w[2:4])) b from w where len(w) > 1)
select array_to_string(b, ' ') wanted, array_to_string(a, ' ') found, case when a = b then 'exact' else 'partial' end relation
from a join b on a = b or (len(list_intersect(a, b)) >= 2 and (list_has_all(a, b) or list_has_all(b, a)))""")
def name_containment(t):
    """Every text's first four words as a name in the index, its second to fourth as one that is looked for; no respellings."""
    words = F.filter(F.split(fold(F.col("text")), " "), lambda x: F.length(x) > 1)
    name = lambda start, n: F.array_sort(F.array_distinct(F.slice(words, start, n)))
    docs = t("documents")
    index = docs.select(name(1, 4).alias("tokens")).distinct().withColumn("pid", F.array_join("tokens", " "))
    wanted = docs.select(name(2, 3).alias("tokens")).distinct().withColumn("id", F.array_join("tokens", " "))
    return resolution.name_pairs(wanted, index, least=1.01).select(F.col("id").alias("wanted"), F.col("pid").alias("found"), "relation")


SHARED_SQL = """
x as (select distinct l_suppkey id, l_returnflag flag, l_linenumber line, p_name, p_type from lineitem join part on l_partkey = p_partkey),
o as (select distinct id, p_name || ' ' || lower(p_type) name from x where flag = 'R' and line < 3), h as (select distinct id, p_type || ' ' || p_name name from x where flag = 'A'),
ok as (select *, array_to_string(list_sort(list_distinct(list_filter(string_split(lower(name), ' '), lambda w: len(w) > 1))), ' ') k from o), hk as (select id, array_to_string(list_sort(list_distinct(list_filter(string_split(lower(name), ' '), lambda w: len(w) > 1))), ' ') k, min(name) found from h group by 1, 2),
s as (select ok.id, count(*) n_names, count(found) n_shared, list(found order by ok.name) filter (where found is not null) shared from ok left join hk using (id, k) group by 1)"""


def _shared(t):
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    mine = rows.where("l_returnflag = 'R' and l_linenumber < 3").select(F.col("l_suppkey").alias("id"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name"))
    theirs = rows.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("id"), F.concat_ws(" ", "p_type", "p_name").alias("name"))
    return resolution.shared_coauthors(mine, theirs)


@query(f"with {SHARED_SQL} select id, n_names, n_shared, coalesce(array_to_string(shared, '; '), '') shared from s")
def shared_coauthors(t):
    """Names that two sources have of each supplier, agreed on as sets of tokens."""
    return _shared(t).select("id", "n_names", "n_shared", F.array_join("shared", "; ").alias("shared"))


@query(f"""
with {SHARED_SQL}, p as (select s_suppkey id, case when s_suppkey % 11 > 0 then 'p' || s_suppkey % 50 end pid, s_suppkey % 30 pubs, 'campus' || s_nationkey a, 'campus' || s_suppkey % 3 b, 'p' || s_suppkey % 7 declared, s_suppkey % 4 > 0 in_venues from supplier),
c as (select p.*, coalesce(n_shared, 0) > 0 proven, shared, list_filter([case when coalesce(n_shared, 0) = 0 and coalesce(n_names, 0) > 0 then 'no shared co-author' end, case when a <> b then 'another institution' end,
  case when declared <> pid then 'declares another page' end, case when pubs < 15 then 'few publications' end, case when pubs < 15 and not in_venues then 'none in the venues' end], lambda x: x is not null) c from p left join s using (id))
select id, case when pid is null then 'no-profile' when proven and len(c) = 0 then 'confirmed' when proven then 'confirmed-with-notes' when len(c) = 0 then 'unconfirmed' when len(c) > 1 then 'doubtful' else 'check' end verdict,
  case when pid is null then 'no page' else array_to_string(c, '; ') end concerns, case when pid is null then '' else coalesce(array_to_string(shared[1:4], ', '), '') end evidence from c""")
def page_evidence(t):
    """Whether each supplier's page is theirs, by co-authors, institution, what they declare and how much there is."""
    k = F.col("s_suppkey")
    named = lambda c: F.concat(F.lit("p"), c.cast("string"))
    people = t("supplier").select(
        k.alias("id"), F.when(k % 11 > 0, named(k % 50)).alias("pid"), (k % 30).alias("pubs"), F.concat(F.lit("University of Campus"), (k % 3).cast("string")).alias("page_affiliation"),
        F.concat(F.lit("campus"), F.col("s_nationkey").cast("string"), F.lit(" College")).alias("affiliation"), F.array(named(k % 7)).alias("declared"), (k % 4 > 0).alias("in_venues"),
    )
    return resolution.identity_audit(people, _shared(t)).select("id", "verdict", "concerns", "evidence")
