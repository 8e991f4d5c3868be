"""Queries on people, texts, selection and logs, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import conflicts, dedup, eventlog, identity, selection, seniority
from weftline.plans.registry import Registry
from weftline.policy import Policy

_r = Registry()
query, QUERIES, ORACLES = _r.query, _r.queries, _r.oracles
YEAR = 2001

FOLD_SQL = "trim(regexp_replace(lower(strip_accents(coalesce({0}, ''))), '[^a-z0-9]+', ' ', 'g'))"


@query("""
select user_id, event_id, event_type, value from (
  select *, row_number() over (partition by user_id order by ts desc, event_id) rn from events) where rn = 1""")
def latest_row(t):
    return dedup.latest_row(t("events"), F.col("user_id"), "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query("""
select event_type, count(*) kept, sum(dropped) dropped from (
  select user_id, first(event_type order by value desc, event_id) event_type, count(*) - 1 dropped from events group by user_id) group by event_type""")
def collapse_accounts(t):
    kept, dropped = dedup.collapse(t("events"), "user_id", F.col("value"), "event_id")
    lost = dropped.groupBy("kept_position").agg(F.count("*").alias("n"))
    rows = kept.join(lost, kept["event_id"] == lost["kept_position"], "left")
    return rows.groupBy("event_type").agg(F.count("*").alias("kept"), F.sum(F.coalesce("n", F.lit(0))).alias("dropped"))


@query(r"""
select doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda x: regexp_matches(x, '\p{L}'))) n_sentences from documents""")
def sentence_count(t):
    return t("documents").select("doc_id", T.sentence_count(F.col("text")).cast("long").alias("n_sentences"))


@query(r"""
with d as (select doc_id, lang, n_chars, doc_id % 9 = 0 gone, split_part(coalesce(text, ''), '.', 1) title, coalesce(text, '') body, case when doc_id % 11 = 0 then 0 else 1 end n_authors from documents)
select doc_id, array_to_string(list_filter([
  case when len(list_filter(regexp_split_to_array(title, '\s+'), lambda x: x <> '')) < 3 then 'title under three words' end,
  case when trim(body) = '' then 'no abstract' end,
  case when lang = 'es' then 'no topics' end,
  case when n_authors < 1 then 'no authors' end,
  case when gone then 'withdrawn' end], lambda x: x is not null), '; ') reasons from d""")
def selection_gaps(t):
    body = F.coalesce("text", F.lit(""))
    gaps = selection.selection_gaps(
        "complete", F.col("doc_id"), set(), title=F.substring_index(body, ".", 1), abstract=body, n_topics=F.when(F.col("lang") == "es", 0).otherwise(1),
        n_authors=F.when(F.col("doc_id") % 11 == 0, 0).otherwise(1), gone=F.col("doc_id") % 9 == 0, status=F.lit("submitted"),
    )
    return t("documents").select("doc_id", F.array_join(gaps, "; ").alias("reasons"))


@query(r"""
with d as (select doc_id, case doc_id % 13 when 0 then ' Test' when 1 then 'TBD' else split_part(coalesce(text, ''), '.', 1) end title, coalesce(text, '') body, lang, doc_id % 9 = 0 gone from documents)
select doc_id from d where trim(title) <> '' and lower(trim(title)) not in ('test')
  and len(list_filter(regexp_split_to_array(body, '[.!?]+'), lambda x: regexp_matches(x, '\p{L}'))) >= 2 and not gone""")
def registered_papers(t):
    """Texts as papers; some have a placeholder for a title, others what looks like one and is none."""
    body = F.coalesce("text", F.lit(""))
    title = F.when(F.col("doc_id") % 13 == 0, " Test").when(F.col("doc_id") % 13 == 1, "TBD").otherwise(F.substring_index(body, ".", 1))
    gaps = selection.registration_gaps(title, body, F.lit(1), F.col("doc_id") % 9 == 0)
    return selection.split_selected(t("documents").withColumn("gaps", gaps))[0].select("doc_id")


@query("""
with o as (select o_custkey, o_orderkey, year(o_orderdate) y from orders),
m as (select *, count(*) filter (where y >= 1999) over (partition by o_custkey) n, row_number() over (partition by o_custkey order by y desc, o_orderkey) rk from o)
select o_custkey, o_orderkey, y from m where (n >= 10 and y >= 1999) or (n < 10 and rk <= 10)""")
def window_fallback(t):
    rows = t("orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("y"))
    p = Policy()
    return dedup.recent_or_latest(rows, ["o_custkey"], "y", [F.asc("o_orderkey")], years=3, current_year=YEAR, least=p.title_min, fallback=p.title_fallback)


@query("""
select p_type, p_brand, min(p_partkey) p_partkey, max(p_size) p_size from part group by 1, 2""")
def dedup_titles(t):
    rows = t("part").select("p_type", F.concat(F.upper("p_brand"), F.when(F.col("p_partkey") % 2 == 0, ". ").otherwise("")).alias("title"), "p_size", "p_partkey", "p_brand")
    out = dedup.dedup_titles(rows, ["p_type"], "title", "p_size", "p_partkey")
    return out.join(rows.select("p_partkey", "p_brand"), "p_partkey").select("p_type", "p_brand", "p_partkey", "p_size")


CLASSIFY_SQL = """
with c as (select o_custkey person_id, count(*) filter (where o_orderpriority = '1-URGENT') career_0, count(*) filter (where o_orderpriority = '2-HIGH') career_1,
  count(*) filter (where o_orderpriority = '1-URGENT' and year(o_orderdate) between 1999 and 2001) window_0, count(*) filter (where o_orderpriority = '2-HIGH' and year(o_orderdate) between 1999 and 2001) window_1,
  count(*) filter (where hit) career, count(*) filter (where hit and year(o_orderdate) between 1999 and 2001) "window", min(year(o_orderdate)) filter (where hit) first_year, max(year(o_orderdate)) filter (where hit) last_year, count(*) pubs
  from (select *, o_orderpriority in ('1-URGENT', '2-HIGH') hit from orders) group by 1)
select *, case when "window" >= 0.8 * 3 - 1e-9 then 'senior' when pubs < 5 then 'junior' when career < 3 then 'out-of-area' else 'typical' end "level" from c"""


def _classified(t):
    rows = t("orders").select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("title"), F.col("o_orderpriority").alias("venue"), F.year("o_orderdate").alias("year"))
    return seniority.classify(rows, "person_id", ["1-URGENT", "2-HIGH"], current_year=YEAR, policy=Policy(seniority_window=3, junior_pubs=5, out_of_area_career=3))


@query(CLASSIFY_SQL)
def classify(t):
    return _classified(t)


@query(f"""
with c as ({CLASSIFY_SQL}), s as (select o_custkey person_id, sum(case when o_orderstatus = 'F' then 1.0 else 0.5 end) score from orders group by 1),
n as (select person_id, list_position(['out-of-area', 'junior', 'typical', 'senior'], "level") k, case when score >= 6 then 4 when score >= 2 then 3 else 1 end b, "level" from c join s using (person_id))
select person_id, "level", ['out-of-area', 'junior', 'typical', 'senior'][greatest(k, b)] promoted from n""")
def service_promotion(t):
    score = t("orders").groupBy(F.col("o_custkey").alias("person_id")).agg(F.sum(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.5)).alias("score"))
    return _classified(t).join(score, "person_id").select("person_id", "level", seniority.promote(F.col("level"), F.col("score")).alias("promoted"))


@query("""
with w as (select l_orderkey, l_suppkey, case when l_linenumber % 5 = 0 then null when l_linenumber % 2 = 0 then 'light' else 'full' end tier from lineitem),
p as (select distinct l_suppkey person_id, case when l_suppkey % 3 = 0 then 'light' when l_suppkey % 3 = 1 then 'full' else 'reserve' end tier,
  case when l_suppkey % 10 = 0 then 2 end ov, l_suppkey % 7 a, l_suppkey % 4 b from w),
e as (select distinct person_id, tier, coalesce(ov, case tier when 'light' then 7 when 'reserve' then 4 else 15 end) cap, unnest([a, b]) area from p)
select area, count(*) n_people, count(*) filter (where tier = 'light') n_light, count(*) filter (where tier = 'full') n_full, count(*) filter (where tier = 'reserve') n_reserve, sum(cap) capacity from e group by 1""")
def area_capacity(t):
    k = F.col("l_suppkey")
    tier = F.element_at(F.array(F.lit("light"), F.lit("full"), F.lit("reserve")), (k % 3 + 1).cast("int"))
    people = t("lineitem").select(k).distinct().select(k.alias("person_id"), tier.alias("tier"), seniority.capacity(F.when(k % 10 == 0, 2), tier).alias("cap"), (k % 7).alias("a"), (k % 4).alias("b"))
    return seniority.area_capacity(people, ["a", "b"], "tier", "cap")


@query("""
with u as (select loads, ceil(greatest(s.n * 5 - c.cap, 0) / loads) reserves from (select count(*) n from orders) s, (select sum(case when s_suppkey % 2 = 0 then 7 else 15 end) cap from supplier) c, (select unnest([2, 3, 4, 6, 8]) loads))
select loads, cast(reserves as bigint) reserves from u""")
def reserve_need(t):
    slots = t("orders").agg((F.count("*") * 5).alias("slots"))
    cap = t("supplier").agg(F.sum(F.when(F.col("s_suppkey") % 2 == 0, 7).otherwise(15)).alias("cap"))
    loads = slots.crossJoin(cap).select("*", F.explode(F.array(*[F.lit(x) for x in (2, 3, 4, 6, 8)])).alias("loads"))  # two single rows
    return loads.select("loads", seniority.reserves_needed(F.col("slots"), F.col("cap"), F.col("loads")).cast("long").alias("reserves"))


@query("""
with s as (select 'customer#' || lpad(cast(s_suppkey as varchar), 9, '0') as name, s_nationkey, s_suppkey from supplier),
by_key as (select s_suppkey k, min(s_suppkey) v from supplier where s_suppkey % 2 = 0 group by 1),
by_name as (select s_suppkey % 1000 k, min(s_suppkey) v from supplier where s_suppkey % 3 = 0 group by 1),
by_nation as (select s_nationkey k, min(s_suppkey) v from supplier group by 1)
select c_custkey, coalesce(a.v, b.v, n.v) as match, case when a.v is not null then 'key' when b.v is not null then 'name' when n.v is not null then 'nation' end how
from customer left join by_key a on a.k = c_custkey left join by_name b on b.k = c_custkey % 1000 left join by_nation n on n.k = c_nationkey""")
def waterfall_match(t):
    s = t("supplier")
    steps = [
        ("key", F.col("c_custkey"), identity.lookup(s.where("s_suppkey % 2 = 0"), F.col("s_suppkey"), "s_suppkey")),
        ("name", F.col("c_custkey") % 1000, identity.lookup(s.where("s_suppkey % 3 = 0"), F.col("s_suppkey") % 1000, "s_suppkey")),
        ("nation", F.col("c_nationkey"), identity.lookup(s, F.col("s_nationkey"), "s_suppkey")),
    ]
    return identity.waterfall(t("customer").select("c_custkey", "c_nationkey"), steps).select("c_custkey", "match", "how")


@query("""
with a as (select distinct c_custkey, unnest([c_custkey, c_custkey * 2]) address from customer), b as (select s_suppkey * 3 address from supplier)
select c_custkey from customer where c_custkey not in (select c_custkey from a join b using (address))""")
def drop_barred(t):
    people = t("customer").select("c_custkey", F.col("c_custkey").cast("string").alias("one"), (F.col("c_custkey") * 2).cast("string").alias("two"))
    barred = t("supplier").select((F.col("s_suppkey") * 3).cast("string").alias("address"))
    return identity.without(people, barred, ["one", "two"], "c_custkey").select("c_custkey")


@query("""
with o as (select l_orderkey, list(l_partkey order by l_linenumber) ps, list(l_suppkey order by l_linenumber) ss from lineitem group by 1),
d as (select l_orderkey, ps, case when l_orderkey % 3 = 0 then ss[:len(ss) - 1] else ss end ss from o)
select email, pid, count(*) n from (select unnest(ps) email, unnest(ss) pid from d where len(ps) = len(ss)) where pid % 10 <> 0 group by 1, 2""")
def positional_zip(t):
    """Ids declared place by place beside authors; lists of different length say nothing."""
    rows = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    said = F.array_join(F.transform("x", lambda s: F.when(s["l_suppkey"] % 10 == 0, "-").otherwise(s["l_suppkey"].cast("string"))), ";")
    ids = F.transform(F.split(said, ";"), lambda p: F.when(p == "-", "").otherwise(p))
    cut = F.when(F.col("l_orderkey") % 3 == 0, F.slice(ids, 1, F.size(ids) - 1)).otherwise(ids)
    pairs = identity.positional_pairs(rows.select("l_orderkey", F.transform("x", lambda s: s["l_partkey"]).alias("emails"), cut.alias("ids")), ["l_orderkey"], "emails", "ids")
    return pairs.groupBy(F.col("left").alias("email"), F.col("right").cast("long").alias("pid")).agg(F.count("*").alias("n"))


@query("""
with c as (select l_orderkey, l_partkey claim from lineitem)
select l_orderkey, claim, count(*) over (partition by claim) claimants, count(*) over (partition by claim) > 1 shared from c""")
def shared_claims(t):
    return dedup.shared_claims(t("lineitem").select("l_orderkey", F.col("l_partkey").alias("claim")), "claim")


@query("""
with b as (select distinct p_partkey, p_brand || ':' || p_size || ':' || unnest(string_split(p_name, ' ')) k from part)
select distinct x.p_partkey a, y.p_partkey b from b x join b y using (k) where x.p_partkey < y.p_partkey""")
def blocked_duplicates(t):
    """Names are short, so all their words make blocks; within a brand and size."""
    words = F.split("p_name", " ")
    return identity.duplicate_pairs(t("part"), "p_partkey", F.transform(words, lambda w: F.concat_ws(":", "p_brand", F.col("p_size").cast("string"), w)))


@query(f"""
select doc_id, {FOLD_SQL.format("text")} folded, array_to_string(list_sort(list_distinct(list_filter(string_split({FOLD_SQL.format("regexp_replace(text, '\\s+[0-9]+\\s*$', '')")}, ' '), lambda x: len(x) > 1))), ' ') tokens from documents""")
def fold_text(t):
    """Whole texts of all languages stand for names."""
    name = F.col("text")
    return t("documents").select("doc_id", T.fold(name).alias("folded"), F.array_join(T.token_set(name), " ").alias("tokens"))


@query(r"""
select page_id, regexp_extract(url, '^https?://([^/]+)', 1) host, array_to_string(list_filter(regexp_split_to_array(lower(regexp_extract(url, '^https?://([^/:]+)', 1)), '[^a-z0-9]+'), lambda x: x <> '')[-2:], '.') domain,
  trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) = '' as empty_page from pages""")
def page_domains(t):
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    mail = F.concat(F.lit("x@"), F.regexp_extract("url", r"^https?://([^/:]+)", 1))
    return t("pages").select("page_id", host.alias("host"), T.registrable_domain(mail).alias("domain"), (T.strip_markup(F.col("html")) == "").alias("empty_page"))


@query(r"""
select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) plain from pages""")
def tag_strip(t):
    return t("pages").select("page_id", T.strip_markup(F.col("html")).alias("plain"))


@query("""
with w as (select lang, source, count(*) n from documents group by 1, 2)
select lang, source, n, rank from (select *, row_number() over (partition by lang order by n desc, source) rank from w) where rank <= 3""")
def top_areas(t):
    return dedup.top_counts(t("documents"), ["lang"], "source", 3)


@query("""
with e as (select user_id, event_id, ts, event_type verb from events where event_type in ('signup', 'error')),
l as (select user_id, arg_max(verb, (ts, event_id)) verb, arg_max(event_id, (ts, event_id)) event_id from e group by 1)
select user_id, event_id, verb from l where verb = 'signup'""")
def log_replay(t):
    rows = t("events").where("event_type in ('signup', 'error')").select("user_id", "event_id", F.col("event_type").alias("verb"), F.struct("ts", "event_id").alias("sequence"))
    return eventlog.live(rows, "user_id", "sequence", "verb", "signup").select("user_id", "event_id", "verb")


@query("""
with e as (select user_id, event_id, event_type verb, lag(event_type) over (partition by user_id order by ts, event_id) b from events where event_type in ('signup', 'error'))
select user_id, event_id, case when verb = 'signup' then 'reassigned' else 'not assigned' end anomaly from e
where (verb = 'signup' and b = 'signup') or (verb = 'error' and (b is null or b = 'error'))""")
def replay_anomalies(t):
    rows = t("events").where("event_type in ('signup', 'error')").select("user_id", "event_id", F.col("event_type").alias("verb"), F.struct("ts", "event_id").alias("sequence"))
    return eventlog.anomalies(rows, "user_id", "sequence", "verb", "signup", "error").select("user_id", "event_id", "anomaly")


@query("""
with c as (select user_id, min(ts) cutoff from events where event_type = 'signup' group by 1),
e as (select e.* from events e left join c using (user_id) where (cutoff is null or ts >= cutoff) and event_type <> 'error')
select user_id, max(ts) last_activity, arg_max(event_type, (ts, event_id)) last_action, count(*) n_actions from e group by 1""")
def activity_since_cutoff(t):
    e = t("events")
    cutoffs = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("cutoff"))
    return eventlog.activity_since(e.where("event_type <> 'error'"), "user_id", "ts", "event_id", "event_type", cutoffs)


@query("""
with s as (select user_id, min(ts) first_at from events where event_type = 'signup' group by 1) select user_id, first_at from s""")
def first_assigned(t):
    return t("events").where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("first_at"))


@query("""
with a as (select distinct l_suppkey k from lineitem where l_linenumber = 1), b as (select s_suppkey k from supplier where s_suppkey % 2 = 0)
select coalesce(a.k, b.k) k, case when b.k is null then 'left' else 'right' end only_in from a full join b on a.k = b.k where a.k is null or b.k is null""")
def symmetric_sets(t):
    from weftline.operators.diffs import symmetric_difference

    a = t("lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").alias("k"))
    return symmetric_difference(a.distinct(), t("supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("k")))


@query("""
select s_suppkey, case when s_suppkey % 3 = 0 then null else regexp_replace(replace(initcap_name, ' ', ''), '([a-z])([A-Z])', '\\1 \\2', 'g') end as name, 'https://dblp.org/pid/' || pid || '.html' url
from (select s_suppkey, n initcap_name, case when s_suppkey % 3 = 0 then s_suppkey || '/' || s_suppkey else 'o/' || n || s_suppkey end pid
      from (select s_suppkey, case s_suppkey % 4 when 0 then 'AnnLee' when 1 then 'BoVanDyk' when 2 then 'Kim' else 'JoRay' end n from supplier))""")
def named_ids(t):
    rows = t("supplier").select("s_suppkey", F.expr("case s_suppkey % 4 when 0 then 'AnnLee' when 1 then 'BoVanDyk' when 2 then 'Kim' else 'JoRay' end").alias("n"))
    pid = F.when(F.col("s_suppkey") % 3 == 0, F.concat_ws("/", "s_suppkey", "s_suppkey")).otherwise(F.concat(F.lit("o/"), "n", F.col("s_suppkey").cast("string")))
    return rows.select("s_suppkey", T.pid_name(pid).alias("name"), T.pid_url(pid).alias("url"))


@query("select c_custkey, unnest([c_name, n_name, r_name]) person, unnest([0, 1, 2]) place from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def split_people(t):
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cell = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.col("c_name"), F.lit(" (or "), F.col("n_name"), F.lit(") / "), F.col("r_name"))).otherwise(F.concat_ws(" OR ", "c_name", "n_name", "r_name"))
    return rows.select("c_custkey", F.posexplode(T.split_people(cell)).alias("place", "person"))


@query("""
select p_partkey, concat_ws(', ', nullif(case when p_partkey % 2 = 0 then '' else p_brand end, ''), p_type) || '[SEP]' || coalesce(p_name, '') profile, coalesce(p_name, '') || '[SEP]' title_only from part""")
def area_profiles(t):
    brand = F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.col("p_brand"))
    return t("part").select("p_partkey", T.area_profile([brand, F.col("p_type"), F.lit(None).cast("string")], F.col("p_name")).alias("profile"), T.document(F.col("p_name")).alias("title_only"))


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)")
def coverage_gap(t):
    return conflicts.uncovered(t("customer").select("c_custkey"), "c_custkey", t("orders").select(F.col("o_custkey").alias("c_custkey")))
