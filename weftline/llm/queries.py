"""The queries of the training-data operators over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bitplanes, bwt, conversations, decontam, hmm, isoforest, packing, pii, resampling, simhash, superkmer, toxicity, wordpiece
from weftline.session import ship

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


@query
def op2_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.round_trip(_table(spark, sf_dir, "documents"))


@query
def op3_isoforest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isoforest.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op6_wordpiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(_table(spark, sf_dir, "documents"))


@query
def op7_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scored(_table(spark, sf_dir, "documents"))


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op9_superkmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer.digests(_table(spark, sf_dir, "documents"))


@query
def op10_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.digests(_table(spark, sf_dir, "documents")).drop("kept")


@query
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(_table(spark, sf_dir, "documents"))


@query
def op13_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digests(_table(spark, sf_dir, "conversations"))


def _seed_sql(table: str, key: str) -> str:
    places = lambda offsets: " || ' ' || ".join(f"w[p + {o}]" for o in offsets)
    return " union all ".join(f"select {key}, w, p, {k} m, {m[-1] + 1} span, {places(m)} seed from {table} where p + {m[-1]} <= len(w)" for k, m in enumerate(decontam.MASKS))


_WORDS_SQL = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
ORACLES["op8_decontamination"] = f"""
with d as (select doc_id, unnest(range(1, len(w) + 1)) p, w from (select distinct doc_id, {_WORDS_SQL} w from documents where doc_id is not null)),
i as (select item_id, unnest(range(1, len(w) + 1)) p, w from (select distinct item_id, {_WORDS_SQL} w from benchmark where item_id is not null)),
ds as ({_seed_sql("d", "doc_id")}), bs as ({_seed_sql(f"(select * from i where len(w) >= {decontam.WINDOW})", "item_id")}),
h as (select distinct doc_id, item_id, ds.w dw, bs.w iw, ds.p - bs.p g, bs.p ip, bs.span, least({decontam.WINDOW}, len(bs.w)) n from ds join bs on ds.m = bs.m and ds.seed = bs.seed),
s as (select *, unnest(range(greatest(1, 1 - g, ip + span - n), least(least(len(iw), len(dw) - g) - n + 1, ip) + 1)) s from h),
f as (select doc_id, item_id, d.w dw, i.w iw, d.p - 1 g, len(i.w) n, 1 s from d join (select item_id, w from i where p = 1 and len(w) < {decontam.WINDOW}) i on d.p + len(i.w) - 1 <= len(d.w)),
a as (select doc_id, item_id, n, s, s + g q, len(list_filter(range(s, s + n), lambda k: iw[k] = dw[k + g])) agree from (select doc_id, item_id, dw, iw, g, n, s from s union all select doc_id, item_id, dw, iw, g, n, s from f))
select doc_id, item_id, agree matched_words, n window_words, q - 1 doc_start, s - 1 item_start from (
  select *, row_number() over (partition by doc_id, item_id order by agree desc, q, s, n desc) rn from a where agree >= ceil({decontam.SIMILARITY} * n - 1e-9)) where rn = 1"""
ORACLES["op9_superkmer"] = rf"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
k as (select doc_id, p, array_to_string(w[p:p + {superkmer.WINDOW - 1}], ' ') s from (select doc_id, w, unnest(range(1, len(w) - {superkmer.WINDOW - 2})) p from d)),
f as (select s, min(doc_id) first from k group by 1),
c as (select distinct doc_id, unnest(range(p, p + {superkmer.WINDOW})) pos from k join f using (s) where first < doc_id),
a as (select doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) pos from d),
r as (select doc_id, count(*) n, string_agg(word, ' ' order by pos) kept from a anti join c using (doc_id, pos) group by 1)
select doc_id, len(w) n_words, len(w) - coalesce(n, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join r using (doc_id)"""

#: The table of CRC-32 (reflected polynomial 0xEDB88320), made by its rule.
_CRC_TABLE_SQL = "list_transform(range(256), lambda k: list_reduce(range(8), lambda c, r: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k))"


def _crc_sql(codes: str, table: str) -> str:
    return f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def _and_sql(cost: str, edit: str, then: str) -> str:
    """An edit before what follows it; both as six digits of cost and the letters, so that the least string wins."""
    return f"case when {then} < '9' then lpad(((substr({then}, 1, 6)::int) + {cost})::varchar, 6, '0') || '{edit}' || substr({then}, 7) else '9' end"


def _edits_sql(state: str, then: str) -> str:
    stays, kept = "case when c in ('S', 'U', 'A', 'O') then 5 else 0 end", {"u": "c in ('u', 'U')", "a": "c in ('a', 'A')"}[then]
    options = [_and_sql("2", "D", f"r{state}"), f"case when c <> 'x' then {_and_sql(f'1 + {stays}', 'R', f'r{then}')} else '9' end", f"case when {kept} then {_and_sql(stays, 'K', f'r{then}')} else '9' end"]
    if state == "0":
        options.append(f"case when c in ('s', 'S') then {_and_sql(stays, 'K', 'rs')} else '9' end")
    return f"least({', '.join(options)}) f{state}"


_INSERTED_SQL = f"least(f0, {_and_sql('5', 'I', 'ru')}) r0, least(fs, {_and_sql('5', 'I', 'ru')}) rs, ru, ra from (select *, least(fu, {_and_sql('5', 'I', 'fa')}) ru, least(fa, {_and_sql('5', 'I', 'fu')}) ra"
ORACLES["op13_signatures"] = rf"""
with recursive t as (select {_CRC_TABLE_SQL} t),
k as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, {_crc_sql("list_transform(range(1, len(s) + 1), lambda i: ascii(s[i])::bigint)", "t")} % 20 k
  from (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') s from conversations), t),
d as (select conv_id, turn, case when k = 4 then 'user' else role end as role, case when k = 1 then '' when k = 2 then translate(text, '.!?', '') else text end as text, unnest(range(case k when 3 then 2 else 1 end)) said from k where k <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) p from d),
f as (select *, case when not regexp_matches(text, '[^ 	-
]') then 'b' when row_number() over (partition by conv_id, role, text order by p) > 1 then 'd' when not regexp_matches(text, '[.!?][ 	-
]*$') then 't' else '' end as fault,
  case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else 'o' end as ini from o),
n as (select *, lag(ini) over (partition by conv_id order by p) || ini pair from f),
g as (select conv_id, string_agg(case fault when 't' then upper(ini) when '' then ini else 'x' end, '' order by p) sig, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (fault = 'b') blank, count(*) filter (fault = 'd') duplicate,
  count(*) filter (fault = 't') truncated, count(*) filter (pair not in ('su', 'ua', 'au')) illegal from n group by 1),
z as (select sig, len(sig)::bigint i, '000000' f0, '9' fs, '9' fu, '000000' fa from (select distinct sig from g)
  union all select sig, i - 1, {_edits_sql("0", "u")}, {_edits_sql("s", "u")}, {_edits_sql("u", "a")}, {_edits_sql("a", "u")} from (select sig, i, sig[i] c, {_INSERTED_SQL} from z where i > 0))),
y as (select sig, substr(r0, 1, 6)::bigint as cost, substr(r0, 7) audit from (select sig, {_INSERTED_SQL} from z where i = 0))),
a as (select conv_id, audit, unnest(range(1, len(audit) + 1)) q from g join y using (sig)),
e as (select conv_id, q, audit[q] edit, count(*) filter (audit[q] <> 'I') over w p, count(*) filter (audit[q] <> 'D') over w place from a window w as (partition by conv_id order by q)),
j as (select e.*, f.role, f.text, max(case when place = 1 and edit = 'K' and f.ini = 's' then 1 else 0 end) over (partition by e.conv_id) system from e left join f on e.conv_id is not distinct from f.conv_id and e.p = f.p and edit <> 'I' where edit <> 'D'),
r as (select conv_id, sha256(string_agg((case when edit = 'K' then role when (place - system) % 2 = 1 then 'user' else 'assistant' end) || ':' || coalesce(text, ''), chr(10) order by place)) h from j group by 1)
select c.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, coalesce(cost, 0) as cost, coalesce(audit, '') audit, coalesce(h, sha256('')) repaired_sha256
from (select distinct conv_id from conversations) c left join g on c.conv_id is not distinct from g.conv_id left join y using (sig) left join r on c.conv_id is not distinct from r.conv_id"""

_GRAMS_SQL = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_BYTES_SQL = "list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1] || h[2 * i + 2])::bigint)"
ORACLES["op11_resampling"] = f"""
with t as materialized (select {_CRC_TABLE_SQL} t),
d as (select row_number() over () r, doc_id, {_GRAMS_SQL} w from documents), b as (select {_GRAMS_SQL} w from benchmark),
df as (select r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) f from d),
bf as (select unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) f from b),
dc as (select r, f, count(*) n from df group by all), bc as (select f, count(*) n from bf group by all),
k as (select f, {_crc_sql(_BYTES_SQL, "t")} % {resampling.BUCKETS} k from (select f, hex(encode(f)) h from (select f from dc union select f from bc)), t),
s as (select k, sum(n) s from dc join k using (f) group by 1), u as (select k, sum(n) t from bc join k using (f) group by 1),
g as (select k.k, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select coalesce(sum(s), 0) from s) + {resampling.BUCKETS})::double / ((coalesce(s, 0) + 1)::double * ((select coalesce(sum(t), 0) from u) + {resampling.BUCKETS})::double)))::bigint gain
  from (select unnest(range({resampling.BUCKETS})) k) k left join s using (k) left join u using (k)),
w as (select r, floor(sum(n * gain) / sum(n))::bigint weight from dc join k using (f) join g using (k) group by 1),
x as (select r, doc_id, len(w)::bigint n_words, (len(w) + greatest(len(w) - 1, 0))::bigint n_features, coalesce(weight, 0) weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('{resampling.SEED}:' || coalesce(doc_id::varchar, '')), 8))::bigint + 0.5::double) / 4294967296)))::bigint score from d left join w using (r)),
y as (select *, row_number() over (partition by n_words >= {resampling.MIN_WORDS} order by score desc, doc_id nulls first) p, count(*) over (partition by n_words >= {resampling.MIN_WORDS}) c from x)
select doc_id, n_features, weight, score, case when n_words >= {resampling.MIN_WORDS} and p <= {resampling.PERCENT} * c // 100 then p end as rank, n_words from y"""
