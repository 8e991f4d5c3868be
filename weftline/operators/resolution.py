"""Whose page is it: names in an index, and the evidence that decides between namesakes.

A name is its set of tokens. Two names are exact if the sets are equal; partial if one holds the other and they share two
tokens, or if one is respelt from the other. No pair of names meets that cannot be one of these: equal sets join on
themselves; a set inside another joins on its two rarest tokens, which the other must hold; a respelling joins on a shared
token and the shape (length and first letter) that all tokens must keep. Common surnames alone never bring names together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import distinctive_tokens, token_pairs, token_set
from weftline.operators.identity import token_relation

#: Words that institutions share.
INSTITUTION_WORDS = tuple(
    """
    university universite universitat universidad univ college institute institut school department dept faculty
    laboratory lab center centre research academy academic technology technological science sciences engineering computer
    computing national state professor prof assistant associate phd student of the and for at in a
    """.split()
)
MAX_PUBS, MAX_NAMES, LEAST_LETTERS, THIN_PUBS = 100, 8, 5, 15


def institution(text: Column) -> Column:
    """What tells an institution from others: its words without those that all share."""
    return distinctive_tokens(text, INSTITUTION_WORDS, 2)


def _joined(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def _shape(tokens: Column) -> Column:
    """Lengths and first letters of a set's tokens in order: a respelling keeps them."""
    return F.array_join(F.array_sort(F.transform(tokens, lambda t: F.concat(F.length(t).cast("string"), F.substring(t, 1, 1)))), ",")


def _rarest_pair(names: DataFrame, frequency: DataFrame) -> DataFrame:
    """names (id, tokens) of two tokens or more with their two rarest tokens as key."""
    each = names.where(F.size("tokens") > 1).select("id", "tokens", F.explode("tokens").alias("token")).join(frequency, "token", "left")
    ranked = each.groupBy("id", "tokens").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))), 1, 2).alias("_two"))
    return ranked.select("id", "tokens", _joined(F.array_sort(F.transform("_two", lambda x: x["token"]))).alias("key"))


def name_pairs(wanted: DataFrame, index: DataFrame, *, least: float = 0.8) -> DataFrame:
    """(id, pid, relation) of names (id, tokens) and spellings (pid, tokens) that are exact or partial; the best relation
    of a pair's spellings. Names without tokens relate to none; repeats count once."""
    w = wanted.select("id", "tokens").where(F.size("tokens") > 0).distinct()
    x = index.select(F.col("pid").alias("id"), "tokens").where(F.size("tokens") > 0).distinct()
    frequency = x.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    keyed = lambda names, key: names.select("id", "tokens", key.alias("key"))
    shape = lambda names: names.select("id", "tokens", F.explode(F.transform("tokens", lambda t: F.concat_ws("|", _shape(F.col("tokens")), t))).alias("key"))
    whole = F.concat(F.lit("="), _joined(F.col("tokens")))
    routes = [
        (keyed(w, whole), keyed(x, whole)),
        (_rarest_pair(w, frequency), keyed(x, F.explode(token_pairs(F.col("tokens"))))),
        (keyed(w, F.explode(token_pairs(F.col("tokens")))), _rarest_pair(x, frequency)),
        (shape(w), shape(x)),
    ]
    met = None
    for left, right in routes:
        rows = left.select(F.col("id"), F.col("tokens").alias("a"), "key").join(right.select(F.col("id").alias("pid"), F.col("tokens").alias("b"), "key"), "key").select("id", "pid", "a", "b")
        met = rows if met is None else met.unionByName(rows)
    judged = met.distinct().withColumn("relation", token_relation(least)("a", "b")).where("relation is not null")
    return judged.groupBy("id", "pid").agg(F.min("relation").alias("relation"))  # exact comes before partial


def search(wanted: DataFrame, index: DataFrame, *, least: float = 0.8) -> DataFrame:
    """(id, pid, relation): the exact pages of each name (id, name), or where there are none the partial ones.

    index: pid, name, a row a spelling. A name that finds nothing is tried again with its camel-cased runs apart.
    """
    pages = index.select("pid", token_set(F.col("name")).alias("tokens"))
    first = name_pairs(wanted.select("id", token_set(F.col("name")).alias("tokens")), pages, least=least)
    split = F.regexp_replace("name", r"(?<=[a-z])(?=[A-Z])", " ")
    again = wanted.where(split != F.col("name")).join(first.select("id").distinct(), "id", "left_anti")
    found = first.unionByName(name_pairs(again.select("id", token_set(split).alias("tokens")), pages, least=least))
    exact = found.where("relation = 'exact'")
    return exact.unionByName(found.join(exact.select("id").distinct(), "id", "left_anti"))


def only_one(candidates: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) where a key has one value and no other."""
    return candidates.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_other")).where(F.col(value) == F.col("_other")).drop("_other")


def pick_by_affiliation(candidates: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, pid): of each person's candidates (id, pid, affiliation) the one at the wanted (id, affiliation), if one is."""
    rows = candidates.withColumn("_a", institution(F.col("affiliation"))).join(wanted.select("id", institution(F.col("affiliation")).alias("_w")), "id")
    return only_one(rows.where(F.arrays_overlap("_a", "_w")).select("id", "pid"), "id", "pid")


def match_by_address(people: DataFrame, addresses: DataFrame, *, least: int = LEAST_LETTERS) -> DataFrame:
    """(id, email): the one address whose local part is part of the person's name and whose domain is of their institution.

    people: id, name, affiliation; addresses: email. The local part has at least so many letters. Joined on its longest
    token, which the name must hold.
    """
    local = token_set(F.substring_index("email", "@", 1))
    site = institution(F.translate(F.substring_index("email", "@", -1), ".", " "))
    a = addresses.where("email like '%@%'").select(F.lower(F.trim("email")).alias("email")).distinct().select("email", local.alias("_l"), site.alias("_s"))
    a = a.where((F.size("_l") > 0) & (F.length(F.array_join("_l", "")) >= least)).withColumn("token", F.array_max(F.transform("_l", lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"])
    p = people.select("id", token_set(F.col("name")).alias("_n"), institution(F.col("affiliation")).alias("_i")).withColumn("token", F.explode("_n"))
    hits = p.join(a, "token").where((F.size(F.array_except("_l", "_n")) == 0) & F.arrays_overlap("_s", "_i"))
    return only_one(hits.select("id", "email"), "id", "email")


def most_declared(declared: DataFrame) -> DataFrame:
    """(email, pid): the page each address declares most often, of equals the least. declared: email, pid, a row each time."""
    counts = declared.groupBy("email", "pid").agg(F.count("*").alias("n"))
    return counts.groupBy("email").agg(F.max_by("pid", F.struct("n", F.negate(F.xxhash64("pid")))).alias("pid"))


def resolve_advisors(advisors: DataFrame, vetted: DataFrame, declared: DataFrame, index: DataFrame, affiliations: DataFrame) -> DataFrame:
    """(id, pid, how): each advisor's page: vetted for the address, else declared by it, else the one page of the name, else
    the one of these at the affiliation. None where nothing decides.

    advisors: id, name, email (may be null), affiliation; vetted: email, pid; declared: email, pid; affiliations: pid, affiliation.
    """
    found = search(advisors.select("id", "name"), index)
    sole = only_one(found, "id", "pid").select("id", F.col("pid").alias("_sole"))
    near = pick_by_affiliation(found.join(affiliations, "pid"), advisors.select("id", "affiliation")).select("id", F.col("pid").alias("_near"))
    known = vetted.groupBy("email").agg(F.min("pid").alias("_vetted"))
    rows = advisors.join(known, "email", "left").join(most_declared(declared).withColumnRenamed("pid", "_said"), "email", "left").join(sole, "id", "left").join(near, "id", "left")
    steps = [("vetted", "_vetted"), ("declared", "_said"), ("only page", "_sole"), ("affiliation", "_near")]
    how = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(n)) for n, c in steps])
    return rows.select("id", F.coalesce(*[F.col(c) for _, c in steps]).alias("pid"), how.alias("how")).where("pid is not null")


def resolve_students(students: DataFrame, declared: DataFrame, advisor_pids: DataFrame, coauthors: DataFrame, index: DataFrame, pages: DataFrame, *, max_pubs: int = MAX_PUBS, max_names: int = MAX_NAMES) -> DataFrame:
    """(id, pid, resolution, n_candidates): each student's page and what stands behind it, or why there is none.

    Pages are proposed by the student's own submissions, as co-authors of an advisor with a like name, and by search.
    Those that an advisor has published with, or that the student declared, contend; else those of the exact name, at
    most max_names. A page of more than max_pubs publications is nobody's. One published with an advisor is confirmed
    (of several the one at the affiliation), then a declared one of the exact name, then the only one of that name.
    students: id, name, email, affiliation; declared: email, pid; advisor_pids: id, pid; coauthors: pid, other, name;
    index: pid, name; pages: pid, pubs, affiliation.
    """
    said = students.join(declared.select("email", "pid").distinct(), "email").select("id", "pid")
    with_advisor = advisor_pids.join(coauthors, "pid").select("id", F.col("other").alias("pid"), "name").distinct()
    like = name_pairs(students.select("id", token_set(F.col("name")).alias("tokens")), with_advisor.select("pid", token_set(F.col("name")).alias("tokens")))
    near = with_advisor.select("id", "pid").distinct().join(like.select("id", "pid"), ["id", "pid"])
    found = search(students.select("id", "name"), index)
    routes = said.withColumn("route", F.lit("self-declared")).unionByName(near.withColumn("route", F.lit("coauthor"))).unionByName(found.select("id", "pid").withColumn("route", F.lit("search")))
    each = routes.groupBy("id", "pid").agg(F.array_join(F.array_sort(F.collect_set("route")), "+").alias("routes"))
    named = name_pairs(students.select("id", token_set(F.col("name")).alias("tokens")), index.select("pid", token_set(F.col("name")).alias("tokens")))
    each = each.join(with_advisor.select("id", "pid").distinct().withColumn("_co", F.lit(True)), ["id", "pid"], "left").join(named, ["id", "pid"], "left").join(pages, "pid", "left")
    each = each.select("id", "pid", "routes", "relation", "pubs", "affiliation", F.coalesce("_co", F.lit(False)).alias("co"), F.contains("routes", F.lit("self-declared")).alias("own"))
    strong = F.max(F.col("co") | F.col("own"))
    n = each.groupBy("id").agg(F.count("*").alias("n_candidates"), strong.alias("_strong"), F.count_if((F.col("relation") == "exact")).alias("_exact"), F.count_if(F.col("co") | F.col("own")).alias("_backed"))
    rows = each.join(n, "id").where(F.when(F.col("_strong"), F.col("co") | F.col("own")).otherwise(F.col("relation") == "exact"))
    rows = rows.where(F.when(F.col("_strong"), F.col("_backed")).otherwise(F.col("_exact")) <= max_names).join(students.select("id", institution(F.col("affiliation")).alias("_w")), "id")
    viable = rows.where((F.col("pubs") <= max_pubs) & (F.col("relation").isNotNull() | (F.col("co") & F.col("own"))))
    viable = viable.withColumn("_here", F.coalesce(F.arrays_overlap(institution(F.col("affiliation")), "_w"), F.lit(False)))
    pick = lambda c: (F.count_if(c), F.min(F.when(c, F.struct("pid", "routes"))))
    exact = F.col("relation") == "exact"
    tests = {"co": F.col("co"), "here": F.col("co") & F.col("_here"), "own": exact & F.col("own"), "exact": exact}
    aggs = [x for k, c in tests.items() for x in (pick(c)[0].alias(f"n_{k}"), pick(c)[1].alias(f"p_{k}"))]
    best = viable.groupBy("id").agg(*aggs)
    out = students.select("id").join(n, "id", "left").join(best, "id", "left")
    one = lambda k: F.coalesce(F.col(f"n_{k}"), F.lit(0)) == 1
    none = lambda k: F.coalesce(F.col(f"n_{k}"), F.lit(0)) == 0
    confirmed = F.when(one("co"), F.col("p_co")).when(one("here"), F.col("p_here"))
    crowded = F.when(F.col("_strong"), F.col("_backed")).otherwise(F.col("_exact")) > max_names
    sure = F.when(F.contains(confirmed["routes"], F.lit("+")), "confirmed").otherwise(F.concat(F.lit("confirmed-"), confirmed["routes"]))
    resolution = (
        F.when(F.col("n_candidates").isNull(), "not-found").when(crowded, "ambiguous").when(confirmed.isNotNull(), sure).when(~none("co"), "ambiguous")
        .when(one("own"), "self-declared").when(one("exact"), "name-only").when(~none("exact"), "ambiguous").otherwise("unverified")
    )
    pid = F.when(confirmed.isNotNull(), confirmed["pid"]).when(none("co") & one("own"), F.col("p_own.pid")).when(none("co") & none("own") & one("exact"), F.col("p_exact.pid"))
    return out.select("id", F.when(~F.coalesce(crowded, F.lit(False)), pid).alias("pid"), resolution.alias("resolution"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def shared_coauthors(one: DataFrame, other: DataFrame) -> DataFrame:
    """(id, n_names, n_shared, shared): how many of a person's co-authors (id, name) the other source (id, name) has too.

    Names are equal as sets of tokens; each of the first source counts once, written as the other source does (of several
    the least), in the order of the first's names. No pair of names is made that does not agree.
    """
    key = _joined(token_set(F.col("name")))
    theirs = other.select("id", key.alias("key"), "name").where("key <> ''").groupBy("id", "key").agg(F.min("name").alias("found"))
    mine = one.select("id", "name").distinct().withColumn("key", key)
    both = mine.join(theirs, ["id", "key"], "left")
    shared = F.transform(F.array_sort(F.collect_list(F.when(F.col("found").isNotNull(), F.struct("name", "found")))), lambda x: x["found"])
    return both.groupBy("id").agg(F.count("*").alias("n_names"), F.count("found").alias("n_shared"), shared.alias("shared"))


def identity_audit(people: DataFrame, shared: DataFrame, *, thin: int = THIN_PUBS) -> DataFrame:
    """people with verdict, concerns and evidence: whether a page is theirs.

    people: id, pid (null: no page), pubs, page_affiliation, affiliation, declared (array of pids, may be null or empty), in_venues
    (false: none of the venues that count has any). Co-authors that both sources name prove an identity; all else can only fail to contradict it.
    """
    rows = people.join(shared.select("id", "n_names", "n_shared", F.array_join(F.slice("shared", 1, 4), ", ").alias("evidence")), "id", "left")
    n, proven = F.coalesce("n_names", F.lit(0)), F.coalesce("n_shared", F.lit(0)) > 0
    here, there = institution(F.col("affiliation")), institution(F.col("page_affiliation"))
    few = F.col("pubs") < thin
    concerns = F.array_compact(F.array(
        F.when(~proven & (n > 0), "no shared co-author"),
        F.when((F.size(here) > 0) & (F.size(there) > 0) & ~F.arrays_overlap(here, there), "another institution"),
        F.when((F.size("declared") > 0) & ~F.array_contains("declared", F.col("pid")), "declares another page"),
        F.when(few, "few publications"),
        F.when(few & ~F.col("in_venues"), "none in the venues"),
    ))
    verdict = (
        F.when(F.col("pid").isNull(), "no-profile").when(proven & (F.size("_c") == 0), "confirmed").when(proven, "confirmed-with-notes")
        .when(F.size("_c") == 0, "unconfirmed").when(F.size("_c") > 1, "doubtful").otherwise("check")
    )
    judged = rows.withColumn("_c", concerns).withColumn("verdict", verdict)
    told = F.when(F.col("pid").isNotNull(), F.array_join("_c", "; ")).otherwise("no page")
    return judged.select(*people.columns, "verdict", told.alias("concerns"), F.when(F.col("pid").isNotNull(), F.coalesce("evidence", F.lit(""))).otherwise("").alias("evidence"))
