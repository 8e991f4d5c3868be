"""Queries that write the driver's tables in the formats of the files, read them back and work on what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import eventlog
from weftline.plans.registry import Registry
from weftline.session import shared_path
from weftline.sources import readers, sinks

_r = Registry()
query, QUERIES, ORACLES = _r.query, _r.queries, _r.oracles

PICKED_SQL = "select l_partkey paper_id, 'P' || l_suppkey || '@x.org' person_id, max(l_quantity) / 50 score from lineitem group by 1, 2"


def _picked(t) -> DataFrame:
    who = F.concat(F.lit("P"), F.col("l_suppkey").cast("string"), F.lit("@x.org"))
    return t("lineitem").groupBy(F.col("l_partkey").alias("paper_id"), who.alias("person_id")).agg((F.max("l_quantity") / 50).alias("score"))


def _new(df: DataFrame, name: str) -> str:
    return f"{shared_path(df.sparkSession, 'files')}/{name}"


def _text(df: DataFrame, name: str) -> str:
    """A folder of text files with the one column's values as lines."""
    path = _new(df, name)
    df.write.text(path)
    return path


def _json_map(df: DataFrame, key: str, value: str, name: str) -> str:
    """A folder of JSON maps key -> value, each a file of some 1,000 keys."""
    parts = df.groupBy(F.pmod(F.xxhash64(key), F.lit(df.count() // 1000 + 1)).alias("_part")).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("m"))
    path = _new(df, name)
    parts.select("_part", F.to_json("m").alias("value")).repartition("_part").write.partitionBy("_part").text(path)
    return path


@query(f"""
with p as ({PICKED_SQL}), a as (select 'P' || s_suppkey || '@x.org' person_id, 'Account ' || s_nationkey || ', "' || s_suppkey || '"@x.org' account_email from supplier where s_suppkey % 3 = 0)
select 'all' paper, 'clearreview' as action, 'all' email, 'R2' round union all
select cast(paper_id as varchar), 'primaryreview', coalesce(account_email, person_id), 'R2' from p left join a using (person_id)""")
def upload_file(t):
    """The upload of all assignments as one file, with commas and quotes in addresses, as the system that takes it reads it."""
    s = t("supplier").where("s_suppkey % 3 = 0")
    k = F.col("s_suppkey").cast("string")
    accounts = s.select(F.concat(F.lit("P"), k, F.lit("@x.org")).alias("person_id"), F.concat(F.lit("Account "), F.col("s_nationkey").cast("string"), F.lit(', "'), k, F.lit('"@x.org')).alias("account_email"))
    path = _new(s, "upload.csv")
    sinks.write_upload(_picked(t), accounts, path, "R2")
    return readers.csv(s.sparkSession, path)


@query(f"with p as ({PICKED_SQL}) select distinct paper_id::int paper_id, lower(person_id) person_id, null::varchar phase, null::double affinity from p")
def assignments_of_upload(t):
    """Assignments out of an upload file: its clearing row is no assignment."""
    p = _picked(t)
    path = _new(p, "upload.csv")
    sinks.write_upload(p, p.select("person_id", F.col("person_id").alias("account_email")).distinct(), path)
    return readers.assignments(p.sparkSession, path)


@query(f"with p as ({PICKED_SQL}) select paper_id::int paper_id, lower(person_id) person_id, case when score > 0.5 then 'anchor' else 'fill' end phase, case when paper_id % 3 > 0 then round(score, 4) end affinity from p")
def assignments_of_pairs(t):
    """Assignments out of a file of pairs; an affinity that is not there stays unknown."""
    p = _picked(t)
    phase = F.when(F.col("score") > 0.5, "anchor").otherwise("fill")
    path = _new(p, "pairs.csv")
    sinks.write_pairs(p.select("paper_id", "person_id", phase.alias("phase"), F.col("score").alias("rank_score"), F.when(F.col("paper_id") % 3 > 0, F.round("score", 4)).alias("affinity")), path)
    return readers.assignments(p.sparkSession, path)


@query("""
select 'c' || c_custkey || '@x.org' email, c_custkey % 3 > 0 disabled, case when c_custkey % 5 = 0 then 'heavy,track_' || c_nationkey else '' end tag_names,
  case when c_custkey % 4 = 1 then 'Systems' end topics from customer""")
def account_export(t):
    """The user export, a column a topic: addresses, flags, tag names and the topics of interest at least 1."""
    c, k = t("customer"), F.col("c_custkey")
    tags = F.when(k % 5 == 0, F.concat(F.lit("Heavy#1 ~~track_"), F.col("c_nationkey").cast("string"))).otherwise("")
    disabled = F.when(k % 3 == 0, F.when(k % 2 == 0, " No ").otherwise("")).otherwise("yes")
    rows = c.select(F.concat(F.lit(" C"), k.cast("string"), F.lit("@x.org ")).alias("email"), F.lit("pc chair").alias("roles"), disabled.alias("disabled"), tags.alias("tags"), F.when(k % 4 > 0, (k % 4 == 1).cast("int") * 2 - 1).alias("topic: Systems"), F.lit("none").alias("Topic: Theory"))
    path = _new(c, "users.csv")
    sinks.write_csv(rows, path)
    got = readers.accounts(c.sparkSession, path)
    top = readers.top_topics(got, "email", 3)
    return got.join(top, "email", "left").select("email", "disabled", F.array_join("tag_names", ",").alias("tag_names"), F.array_join("topics", ",").alias("topics"))


@query("""
with r as (select 'c' || o_custkey || '@x.org' email, o_orderkey, o_orderdate, o_orderpriority, o_orderstatus, o_custkey from orders),
l as (select * from (select *, row_number() over (partition by email order by o_orderdate desc, o_orderkey) n from r) where n = 1 and o_orderstatus <> 'F'),
a as (select 'c' || c_custkey || '@x.org' email, c_custkey from customer)
select l.email, case when o_custkey % 6 = 0 then '9/' || o_custkey when o_custkey % 6 <= 3 then '1/' || o_custkey end pid, o_custkey % 6 = 0 pid_from_override,
  case when o_custkey % 7 = 0 then 'Machines' else o_orderpriority end "primary", case when o_custkey % 7 = 0 then 'Data' else 'second, "quoted"' end secondary, case when o_custkey % 5 = 0 then o_custkey % 9 end override_cap from l""")
def reviewer_form(t):
    """The form's latest row of each person who does not decline, with curated ids, areas and loads over what they wrote."""
    o, c = t("orders"), t("customer")
    who = lambda k: F.concat(F.lit("C"), k.cast("string"), F.lit("@x.org"))
    k = F.col("o_custkey")
    url = F.when(k % 6 <= 3, F.concat(F.lit("https://dblp.org/pid/1/"), k.cast("string"), F.lit(".html"))).otherwise("none")
    heads = {"Timestamp": F.date_format("o_orderdate", "M/d/yyyy H:mm:ss"), "Your email address": who(k), "First Name": F.lit("A"), "Last Name": F.lit("B"), "DBLP page": url, "Your institutional affiliation": F.lit("U"), "Your primary area": F.col("o_orderpriority"), "Your secondary area": F.lit('second, "quoted"'), "A tertiary area": F.lit(None).cast("string"), "Some keywords": F.lit("two\nlines"), "PC membership": F.when(F.col("o_orderstatus") == "F", "I am unable").otherwise("Yes"), "Override paper assignment number": F.lit(None).cast("string")}
    path = _new(o, "form.csv")
    sinks.write_csv(o.select("o_orderkey", *[v.alias(n) for n, v in heads.items()]).orderBy("o_orderkey").drop("o_orderkey"), path)
    people = readers.roster(o.sparkSession, "reviewer", {"form": path})
    people = people.withColumns({"pid": readers.parse_pid(F.col("dblp_url")), "override_cap": F.expr("try_cast(nullif(cap, '') as int)")})
    key = F.col("c_custkey")
    files = {"ids": c.select(who(key).alias("email"), F.when(key % 6 == 0, F.concat(F.lit("9/"), key.cast("string"))).otherwise(" ").alias("dblp")), "areas": c.where(key % 7 == 0).select(who(key).alias("email"), F.lit("Machines").alias("primary"), F.lit(" Data").alias("secondary"), F.lit("").alias("tertiary")), "caps": c.where(key % 5 == 0).select(who(key).alias("email"), (key % 9).cast("string").alias("cap"))}
    kept = {}
    for name, rows in files.items():
        at = _new(c, f"{name}.csv")
        sinks.write_csv(rows, at)
        kept[name] = readers.curated(c.sparkSession, at, tuple(rows.columns), required=True)
    return readers.with_overrides(people, kept["ids"], kept["areas"], kept["caps"]).select("email", "pid", "pid_from_override", "primary", "secondary", "override_cap")


@query("""
with l as (select *, row_number() over (partition by user_id order by event_id desc) n, count(*) over (partition by user_id) actions from events)
select 'u' || user_id || '@x.org' email, user_id paper, event_type || ', "' || event_id || '"' as action, actions from l where n = 1""")
def action_log_file(t):
    """The log, newest first as its system writes it: the last action of each person, by the order of things."""
    e = t("events")
    rows = e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("date"), F.lit("").alias("ipaddr"), F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit("@x.org")).alias("email"), F.lit("pc").alias("roles"), F.lit(None).cast("string").alias("affected_email"), F.lit("web").alias("via"), F.col("user_id").cast("string").alias("paper"), F.concat("event_type", F.lit(', "'), F.col("event_id").cast("string"), F.lit('"')).alias("action"))
    path = _new(e, "log.csv")
    sinks.write_csv(rows.orderBy(F.desc("event_id")).drop("event_id"), path)
    log = readers.action_log(e.sparkSession, path)
    last = log.groupBy("email").agg(F.max_by(F.struct("paper", "action"), "sequence").alias("x"), F.count("*").alias("actions"))
    return last.select("email", F.col("x.paper").cast("long").alias("paper"), "x.action", "actions")


@query("select vec_id::varchar as key, len(embedding) n, round(list_sum(list_transform(embedding, lambda x: x::double)), 4) total, 'f' || label content_key from embeddings")
def vector_cache_file(t):
    """The map of vectors, written without a line break between its entries, read by many tasks."""
    e = t("embeddings")
    entry = F.concat(F.to_json(F.map_from_arrays(F.array(F.col("vec_id").cast("string")), F.array(F.struct(F.col("embedding").alias("vector"), F.concat(F.lit("f"), F.col("label").cast("string")).alias("fingerprint_key"))))))
    path = _new(e, "vectors.json")
    e.select(F.regexp_replace(F.substring(entry, 2, 10_000_000), r"\}$", ",").alias("value")).write.option("lineSep", " ").text(path)
    got = readers.embedding_cache(e.sparkSession, path)
    return got.select("key", F.size("vector").alias("n"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), "content_key")


@query("""
select 'p/' || o_custkey pid, 'On "' || o_orderkey || '"' title, year(o_orderdate) as year, o_orderpriority venue, 'article' as type, case when o_orderkey % 2 = 0 then '10.1000/' || o_orderkey else '' end doi from orders""")
def publication_cache_file(t):
    """The map person -> publications, a map a file, back as rows."""
    o = t("orders")
    record = F.struct(F.concat(F.lit('On "'), F.col("o_orderkey").cast("string"), F.lit('"')).alias("title"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("venue"), F.lit("article").alias("type"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("10.1000/"), F.col("o_orderkey").cast("string"))).otherwise("").alias("doi"))
    rows = o.groupBy(F.concat(F.lit("p/"), F.col("o_custkey").cast("string")).alias("pid")).agg(F.collect_list(record).alias("records"))
    return readers.publication_cache(o.sparkSession, _json_map(rows, "pid", "records", "publications"))


@query("""
with w as (select o_custkey, o_orderkey, year(o_orderdate) y, c_name from orders join customer on c_custkey = o_custkey),
a as (select w.*, replace(replace(p_name, 'a', 'ä'), 'o', 'ø') || ' <' || o_orderkey || '>' title from w join part on p_partkey = o_orderkey % 500)
select 'h/' || a.o_custkey pid, title, y as year, case when a.o_orderkey % 3 = 0 then 'Conf' else 'Jour' end venue, case when a.o_orderkey % 3 = 0 then 'inproceedings' else 'article' end as type, case when a.o_orderkey % 2 = 0 then '10.1000/' || a.o_orderkey else '' end doi from a
union all select 'h/' || c_custkey, title, y, case when a.o_orderkey % 3 = 0 then 'Conf' else 'Jour' end, case when a.o_orderkey % 3 = 0 then 'inproceedings' else 'article' end, case when a.o_orderkey % 2 = 0 then '10.1000/' || a.o_orderkey else '' end
from a join customer on c_custkey = a.o_orderkey % 90 where a.o_custkey <> c_custkey""")
def bibliography_dump(t):
    """Publications of all people out of a dump with entities and markup in titles, read in ranges of 256 KB."""
    path = _dump(t)
    spark = t("orders").sparkSession
    people = readers.bibliography_people(spark, path, range=str(1 << 18))
    works, _ = readers.bibliography_works(spark, path, people, range=str(1 << 18))
    return works


@query("""
with a as (select o_custkey k, o_orderkey % 90 s, year(o_orderdate) y from orders join part on p_partkey = o_orderkey % 500 join customer on c_custkey = o_custkey where year(o_orderdate) >= 1997 and o_custkey <> o_orderkey % 90)
select 'h/' || pid pid, name, count(*) works, min(y) as first from (select k pid, 'Jürgen S' || s as name, y from a union all select s, 'J. S' || k, y from a) where pid in (select c_custkey from customer) group by 1, 2""")
def bibliography_coauthors(t):
    """Works together since 1997 out of the dump, by person and the other's name; a person's own spellings are nobody else."""
    path = _dump(t)
    spark = t("orders").sparkSession
    _, together = readers.bibliography_works(spark, path, readers.bibliography_people(spark, path), since=1997, range=str(1 << 18))
    return together.groupBy("pid", "name").agg(F.count("*").alias("works"), F.min("year").alias("first"))


def _dump(t) -> str:
    """A dump of several files: customers as people with two spellings, orders as articles and conference papers."""
    name = lambda k: F.concat(F.lit("J&uuml;rgen S"), k.cast("string"))
    tag = lambda n, v: F.concat(F.lit(f"<{n}>"), v, F.lit(f"</{n}>"))
    k = F.col("c_custkey").cast("string")
    people = t("customer").select(F.concat(F.lit('<www mdate="2020-01-01" key="homepages/h/'), k, F.lit('">'), tag("author", name(k)), tag("author", F.concat(F.lit("J. S"), k)), F.lit('<note type="affiliation">U</note></www>')).alias("value"))
    works = t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").join(t("part").select((F.col("p_partkey")).alias("_p"), "p_name"), F.col("o_orderkey") % 500 == F.col("_p"))
    o = F.col("o_orderkey").cast("string")
    title = F.concat(F.replace(F.replace("p_name", F.lit("a"), F.lit("&auml;")), F.lit("o"), F.lit("&oslash;")), F.lit(" <i>&lt;"), o, F.lit("&gt;</i>"))
    kind = F.when(F.col("o_orderkey") % 3 == 0, "inproceedings").otherwise("article")
    venue = F.when(F.col("o_orderkey") % 3 == 0, tag("booktitle", F.lit("Conf"))).otherwise(tag("journal", F.lit("Jour")))
    doi = F.when(F.col("o_orderkey") % 2 == 0, tag("ee", F.concat(F.lit("https://doi.org/10.1000/"), o))).otherwise("<ee/>")
    body = F.concat(F.lit("<"), kind, F.lit(' key="k/'), o, F.lit('">'), tag("author", F.concat(F.lit("J. S"), F.col("o_custkey").cast("string"))), tag("author", name(F.col("o_orderkey") % 90)), tag("title", title), tag("year", F.year("o_orderdate").cast("string")), venue, doi, F.lit("</"), kind, F.lit(">"))
    return _text(people.unionByName(works.select(body.alias("value"))), "dump")
