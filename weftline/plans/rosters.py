"""Queries on rosters, students, audits and evidence, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import matching, metrics, rosters, seniority
from weftline.operators.pairs import top_k
from weftline.plans.people import CLASSIFY_SQL, _classified
from weftline.plans.registry import Registry
from weftline.policy import Policy

_r = Registry()
query, QUERIES, ORACLES = _r.query, _r.queries, _r.oracles


@query("""
select c_custkey, case when s_suppkey is null then 'no_account' when s_suppkey % 7 = 0 then 'disabled' when not s_suppkey % 3 > 0 then 'role_removed' end problem
from customer left join supplier on s_suppkey = c_custkey""")
def prune_problem(t):
    rows = t("customer").join(t("supplier"), F.col("c_custkey") == F.col("s_suppkey"), "left")
    return rows.select("c_custkey", rosters.prune_problem(F.col("s_suppkey"), F.col("s_suppkey") % 7 == 0, F.col("s_suppkey") % 3 > 0).alias("problem"))


@query("""
with a as (select distinct o_custkey k from orders where o_orderstatus = 'F'), b as (select c_custkey k from customer where c_acctbal > 0), p as (select c_custkey k from customer where c_nationkey < 5)
select coalesce(a.k, b.k) k, case when a.k is null then 'right_only' when b.k is null then 'left_only' else 'both' end side, p.k is not null in_pool
from a full join b on a.k = b.k left join p on p.k = coalesce(a.k, b.k)""")
def reconcile_rosters(t):
    c = t("customer").withColumnRenamed("c_custkey", "k")
    return rosters.reconcile(t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), c.where("c_acctbal > 0").select("k"), "k", c.where("c_nationkey < 5").select("k"))


@query("""
select c_custkey, case when s_suppkey is not null then 'regular' when c_mktsegment <> 'BUILDING' then 'promoted' else 'reserve' end state
from customer left join supplier on s_suppkey = c_custkey""")
def split_promoted(t):
    people = t("customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "reserve").otherwise("full").alias("tier"))
    return rosters.split_promoted(people, t("supplier").select(F.col("s_suppkey").alias("c_custkey")), "c_custkey", "tier").select("c_custkey", "state")


@query("""
with p as (select distinct l_suppkey student, l_partkey paper_id, l_partkey % 3 = 0 gated from lineitem), b as (select distinct l_suppkey student, l_partkey paper_id from lineitem where l_returnflag = 'R'),
f as (select *, count(*) filter (where gated) over (partition by student) n from p anti join b using (student, paper_id))
select student, paper_id, gated, n < 120 released from f where gated or n < 120""")
def student_pool(t):
    rows = t("lineitem").select(F.col("l_suppkey").alias("student"), F.col("l_partkey").alias("paper_id"), "l_returnflag")
    pairs = rows.select("student", "paper_id").distinct().withColumn("gated", F.col("paper_id") % 3 == 0)
    return rosters.student_pool(pairs, rows.where("l_returnflag = 'R'"), 120)


@query("""
with c as (select c_custkey, c_acctbal < 0 thin, c_nationkey % 5 = 0 place, c_custkey % 4 = 0 nobody from customer)
select c_custkey, case when cast(thin as int) + cast(place as int) + cast(nobody as int) = 0 then 'ok' when cast(thin as int) + cast(place as int) + cast(nobody as int) = 1 then 'check' else 'suspect' end verdict,
  array_to_string(list_filter([case when thin then 'thin record' end, case when place then 'other place' end, case when nobody then 'no shared coauthor' end], lambda x: x is not null), '; ') concerns from c""")
def identity_audit(t):
    verdict, concerns = rosters.identity_verdict({"thin record": F.col("c_acctbal") < 0, "other place": F.col("c_nationkey") % 5 == 0, "no shared coauthor": F.col("c_custkey") % 4 == 0})
    return t("customer").select("c_custkey", verdict.alias("verdict"), concerns.alias("concerns"))


@query("""
select p_partkey, p_size from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 49) and p_partkey not in (select l_partkey from lineitem where l_linenumber = 7)""")
def snapshot_gaps(t):
    cached = t("lineitem").withColumnRenamed("l_partkey", "p_partkey")
    return rosters.gaps(t("part").select("p_partkey", "p_size"), [cached.where("l_quantity > 49"), cached.where("l_linenumber = 7")], "p_partkey")


@query("""
with f as (select s_suppkey k, 'fresh' v from supplier where s_suppkey % 3 = 0) select k, v from f union all select s_suppkey, s_name from supplier where s_suppkey % 2 = 0 and s_suppkey % 3 <> 0""")
def cache_upsert(t):
    s = t("supplier")
    return rosters.upsert(s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")), s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("k"), F.lit("fresh").alias("v")), "k")


@query("""
with w as (select distinct o_custkey k from orders), c as (select c_custkey k, case c_custkey % 4 when 0 then 'found' when 1 then 'not_found' when 2 then 'error' end status from customer where c_custkey % 5 <> 0)
select k, status is not null tried from w left join c using (k) where status is null or status = 'error'""")
def pending_lookups(t):
    k = F.col("c_custkey")
    cache = t("customer").where("c_custkey % 5 <> 0").select(k.alias("k"), F.when(k % 4 == 0, "found").when(k % 4 == 1, "not_found").when(k % 4 == 2, "error").alias("status"))
    return rosters.pending(t("orders").select(F.col("o_custkey").alias("k")), cache, "k", "status")


@query("""
select l_suppkey, l_partkey, count(*) n from lineitem where (l_suppkey, l_partkey) not in (select l_suppkey, l_partkey from lineitem where l_discount > 0.09) group by 1, 2""")
def publication_exclusions(t):
    rows = t("lineitem").select("l_suppkey", "l_partkey", "l_discount")
    kept, _ = rosters.apply_exclusions(rows, rows.where("l_discount > 0.09"), ["l_suppkey", "l_partkey"])
    return kept.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))


@query("""
with c as (select o_custkey, o_orderpriority v, count(*) n from orders group by 1, 2) select o_custkey, arg_min(v, (-n, v)) v, max(n) n from c group by 1""")
def modal_affiliation(t):
    return rosters.modal(t("orders").select("o_custkey", F.col("o_orderpriority").alias("v")), "o_custkey", "v")


@query("""
select case when s_suppkey is null then 'unresolved' when s_nationkey = c_nationkey then 'agree' else 'disagree' end kind, count(*) n from customer left join supplier on s_suppkey = c_custkey group by 1""")
def country_validation(t):
    found = t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("country"))
    return rosters.agreement(found, t("customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("country")), "k", "country")


@query(f"""
with c as ({CLASSIFY_SQL})
select person_id, "level" = 'senior' senior, "level" = 'junior' junior, "level" = 'out-of-area' out_of_area, "level" <> 'senior' and "window" >= 2 almost_senior, "level" = 'junior' and career >= 4 almost_not_junior, "level" = 'out-of-area' and career >= 2 almost_not_out_of_area from c""")
def seniority_pools(t):
    p = Policy(seniority_window=3, junior_pubs=5, out_of_area_career=3, almost_senior_window=2, almost_junior_pubs=4, almost_out_of_area_career=2)
    return seniority.pools(_classified(t), p).select("person_id", "senior", "junior", "out_of_area", "almost_senior", "almost_not_junior", "almost_not_out_of_area")


@query("""
with c as (select l_partkey k, l_suppkey person_id, bool_or(l_returnflag = 'R') declared from lineitem group by 1, 2)
select k, count(distinct person_id) people, round(avg(declared::int), 6) declared_rate from c group by 1 having count(distinct person_id) >= 20 and avg(declared::int) < 0.25""")
def collision_suspects(t):
    rows = t("lineitem").groupBy(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("person_id")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("declared"))
    return metrics.collision_suspects(rows, "k", least=20, rate=0.25).withColumn("declared_rate", F.round("declared_rate", 6))


@query("""
with b as (select distinct l_partkey paper_id, l_suppkey person_id from lineitem where l_linenumber <= 2)
select case when p_partkey is null then 'paper gone' when s_suppkey is null then 'person gone' else 'stands' end outcome, count(*) n
from b left join part on p_partkey = paper_id and p_size > 5 left join supplier on s_suppkey = person_id and s_suppkey % 9 <> 0 where person_id % 2 = 0 group by 1""")
def load_pins(t):
    baseline = t("lineitem").where("l_linenumber <= 2").select(F.col("l_partkey").alias("paper_id"), F.col("l_suppkey").alias("person_id")).distinct()
    person = F.col("s_suppkey").alias("person_id")
    kept, dropped = matching.load_pins(baseline, t("supplier").where("s_suppkey % 2 = 0").select(person), t("part").where("p_size > 5").select(F.col("p_partkey").alias("paper_id")), t("supplier").where("s_suppkey % 9 <> 0").select(person))
    return kept.select(F.lit("stands").alias("outcome")).unionByName(dropped.select(F.col("why").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))


@query("""
with m as (select conv_id, turn, role, len(coalesce(text, '')) n from conversations) select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by n desc, turn) rn from m) where rn <= 2""")
def longest_turns(t):
    rows = t("conversations").select("conv_id", "turn", "role", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return top_k(rows, "conv_id", [F.desc("n"), F.asc("turn")], 2).select("conv_id", "turn", "role")


@query("""
with f as (select c_custkey k, case when c_custkey % 5 > 0 then c_name end as name, case when c_custkey % 7 > 0 then c_mktsegment else ' ' end area from customer where c_custkey % 3 > 0), g as (select s_suppkey k from supplier),
a as (select p_partkey k, min(p_name) as name, min(case when p_partkey % 2 = 0 then p_brand end) area from part group by 1), b as (select s_suppkey k, s_name as name, 'area ' || s_nationkey area from supplier),
r as (select coalesce(f.k, g.k) k, case when g.k is null then 'form' when f.k is null then 'tagged' else 'both' end origin, f.name fn, nullif(trim(f.area), '') fa from f full join g on f.k = g.k)
select r.k, origin, coalesce(fn, a.name, b.name) as name, case when fn is not null then 'form' when a.name is not null then 'parts' when b.name is not null then 'reserve' end name_from,
  coalesce(fa, a.area, b.area) area, case when fa is not null then 'form' when a.area is not null then 'parts' when b.area is not null then 'reserve' end area_from,
  array_to_string(list_filter([case when coalesce(fn, a.name, b.name) is null then 'name' end, case when coalesce(fa, a.area, b.area) is null then 'area' end], lambda x: x is not null), ',') missing
from r left join a on a.k = r.k left join b on b.k = r.k""")
def roster_completion(t):
    """Customers who filled in a form and suppliers who are only tagged, their profiles completed from parts and suppliers."""
    c, s, p = t("customer"), t("supplier"), t("part")
    k = F.col("c_custkey")
    form = c.where(k % 3 > 0).select(k.alias("k"), F.when(k % 5 > 0, F.col("c_name")).alias("name"), F.when(k % 7 > 0, F.col("c_mktsegment")).otherwise(" ").alias("area"))
    parts = p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("area"))
    reserve = s.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.concat(F.lit("area "), F.col("s_nationkey").cast("string")).alias("area"))
    out = rosters.complete(form, s.select(F.col("s_suppkey").alias("k")), [("parts", parts), ("reserve", reserve)], "k", ["name", "area"])
    return out.withColumn("missing", F.array_join("missing", ","))


@query("""
with r as (select c_mktsegment role, case when c_acctbal < 0 then 'light' when c_acctbal < 5000 then 'full' end tier, o_orderstatus reason, o_totalprice v from orders join customer on o_custkey = c_custkey)
select case when grouping(role) = 0 and grouping(tier) = 0 and grouping(reason) = 0 then 'role+tier+reason' when grouping(role) = 0 and grouping(tier) = 0 then 'role+tier' when grouping(role) = 0 then 'role' when grouping(reason) = 0 then 'reason' else 'all' end grain,
  role, tier, reason, count(*) n, round(max(v), 2) most from r group by grouping sets ((role, tier, reason), (role, tier), (role), (reason), ())""")
def audit_rollups(t):
    """Totals by role, tier and reason at five grains in one pass; a tier that is unknown stays apart from all tiers."""
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    tier = F.when(F.col("c_acctbal") < 0, "light").when(F.col("c_acctbal") < 5000, "full")
    rows = rows.select(F.col("c_mktsegment").alias("role"), tier.alias("tier"), F.col("o_orderstatus").alias("reason"), "o_totalprice")
    grains = [["role", "tier", "reason"], ["role", "tier"], ["role"], ["reason"], []]
    return metrics.rollups(rows, ["role", "tier", "reason"], grains, {"n": F.count("*"), "most": F.round(F.max("o_totalprice"), 2)})
