"""Reconciling rosters with accounts, students' eligibility, audits of identities, evidence upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prune_problem(account: Column, disabled: Column, member: Column) -> Column:
    """Why a roster row has no live account: no_account, disabled or role_removed; null if it has."""
    return F.when(account.isNull(), "no_account").when(F.coalesce(disabled, F.lit(False)), "disabled").when(~F.coalesce(member, F.lit(False)), "role_removed")


def reconcile(left: DataFrame, right: DataFrame, key: str, pool: DataFrame | None = None) -> DataFrame:
    """Two sets of keys: both, left_only or right_only, and whether the key is in a third set."""
    both = left.select(key).distinct().withColumn("_l", F.lit(1)).join(right.select(key).distinct().withColumn("_r", F.lit(1)), key, "full_outer")
    out = both.withColumn("side", F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")).drop("_l", "_r")
    if pool is None:
        return out
    return out.join(pool.select(key).distinct().withColumn("_in", F.lit(True)), key, "left").withColumn("in_pool", F.coalesce("_in", F.lit(False))).drop("_in")


def split_promoted(reserves: DataFrame, regulars: DataFrame, key: str, tier: str) -> DataFrame:
    """reserves with state: already a regular, promoted by tier, or still a reserve."""
    known = regulars.select(key).distinct().withColumn("_in", F.lit(1))
    state = F.when(F.col("_in").isNotNull(), "regular").when(F.col(tier) != "reserve", "promoted").otherwise("reserve")
    return reserves.join(known, key, "left").withColumn("state", state).drop("_in")


def student_pool(pairs: DataFrame, barred: DataFrame, target: int) -> DataFrame:
    """Per student the gated papers that nothing bars, or all papers where the gate leaves fewer than target.

    pairs: student, paper_id, gated; barred: student, paper_id (own, advisor's and assigned papers together).
    """
    free = pairs.join(barred.select("student", "paper_id").distinct(), ["student", "paper_id"], "left_anti")
    gated = F.count_if("gated").over(Window.partitionBy("student"))
    return free.withColumn("_n", gated).where(F.col("gated") | (F.col("_n") < target)).withColumn("released", F.col("_n") < target).drop("_n")


def identity_verdict(concerns: dict[str, Column]) -> tuple[Column, Column]:
    """(verdict, concerns): ok without any, check with one, suspect with more."""
    names = F.array_compact(F.array(*[F.when(c, n) for n, c in concerns.items()]))
    return F.when(F.size(names) == 0, "ok").when(F.size(names) == 1, "check").otherwise("suspect"), F.array_join(names, "; ")


def names_agree(a: Column, b: Column) -> Column:
    """Two token sets that share as many tokens as the shorter has, two at most."""
    return F.size(F.array_intersect(a, b)) >= F.least(F.lit(2), F.size(a), F.size(b))


def gaps(snapshot: DataFrame, caches: list[DataFrame], key: str) -> DataFrame:
    """Snapshot rows whose key no cache holds, so what is cached stays as it is."""
    for cache in caches:
        snapshot = snapshot.join(cache.select(key).distinct(), key, "left_anti")
    return snapshot


def upsert(table: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """table with fresh's rows in place of those of the same key."""
    return table.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(*table.columns))


def pending(wanted: DataFrame, cache: DataFrame, key: str, status: str, done: tuple[str, ...] = ("found", "not_found")) -> DataFrame:
    """Keys that were never settled: absent, or with another status; never tried ones first."""
    tried = cache.select(key, F.col(status).alias("_status"))
    return wanted.select(key).distinct().join(tried, key, "left").where(F.col("_status").isNull() | ~F.col("_status").isin(*done)).withColumn("tried", F.col("_status").isNotNull()).drop("_status")


def apply_exclusions(publications: DataFrame, exclusions: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(publications without the excluded ones, the exclusions that met one)."""
    return publications.join(exclusions.select(*keys), keys, "left_anti"), exclusions.join(publications.select(*keys).distinct(), keys, "left_semi")


def publisher(doi: Column, prefixes: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(F.startswith(doi, F.lit(p)), name) for p, name in sorted(prefixes.items())])


def wanted_ids(people: DataFrame, pid: str, name: str, position: str) -> DataFrame:
    return people.where(F.col(pid).isNotNull()).groupBy(pid).agg(F.min_by(name, position).alias(name))


def modal(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's most frequent value, of equals the least."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("o"), F.col(value).alias("v"))).alias("b")).select(key, F.col("b.v").alias(value), (-F.col("b.o")).alias("n"))


def agreement(found: DataFrame, labelled: DataFrame, key: str, value: str) -> DataFrame:
    """How many labelled rows agree, disagree or are unresolved."""
    both = labelled.select(key, F.col(value).alias("_want")).join(found.select(key, value), key, "left")
    kind = F.when(F.col(value).isNull(), "unresolved").when(F.col(value) == F.col("_want"), "agree").otherwise("disagree")
    return both.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def canonical_spelling(people: DataFrame, area: str, position: str) -> DataFrame:
    return people.groupBy(F.lower(area).alias("key")).agg(F.min_by(area, position).alias("area"))


def blank_as_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def complete(form: DataFrame, tagged: DataFrame, donors: list[tuple[str, DataFrame]], key: str, fields: list[str]) -> DataFrame:
    """One row for each key of the form or the tagged accounts: origin (both, form, tagged), each field with <field>_from,
    and missing, the fields that nobody has.

    A field comes from the form if it says something there, else from the first donor that has one; of several rows of
    a source the least value. Blank is nothing. donors only lend fields to who is on the roster already; all sources are
    brought to a row a key in one aggregation.
    """
    named = [("form", form), *donors]
    rows = None
    for place, (name, source) in enumerate(named):
        part = source.where(F.col(key).isNotNull()).select(F.col(key), F.lit(place).alias("_place"), F.lit(name).alias("_name"), *[blank_as_null(F.col(f)).cast("string").alias(f) for f in fields])
        rows = part if rows is None else rows.unionByName(part)
    best = lambda f: F.min(F.when(F.col(f).isNotNull(), F.struct("_place", F.col(f), "_name"))).alias(f"_{f}")
    known = rows.groupBy(key).agg(*[best(f) for f in fields])
    on = reconcile(form.where(F.col(key).isNotNull()), tagged.where(F.col(key).isNotNull()), key)
    origin = F.when(F.col("side") == "left_only", "form").when(F.col("side") == "right_only", "tagged").otherwise("both")
    out = on.join(known, key, "left").select(key, origin.alias("origin"), *[c for f in fields for c in (F.col(f"_{f}.{f}").alias(f), F.col(f"_{f}._name").alias(f"{f}_from"))])
    return out.withColumn("missing", F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields])))
