"""Assignments compared, merged and carried over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """(paper_id, person_id, change -1 or 1) of the pairs in only one of the two."""
    a, b = old.select("paper_id", "person_id").distinct(), new.select("paper_id", "person_id").distinct()
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), ["paper_id", "person_id"], "full_outer")
    return both.where("_a is null or _b is null").select("paper_id", "person_id", F.when(F.col("_a").isNull(), 1).otherwise(-1).alias("change"))


def by_paper(changes: DataFrame) -> DataFrame:
    lists = lambda sign: F.array_sort(F.collect_list(F.when(F.col("change") == sign, F.col("person_id"))))
    return changes.groupBy("paper_id").agg(lists(-1).alias("removed"), lists(1).alias("added"))


def by_person(changes: DataFrame) -> DataFrame:
    lists = lambda sign: F.array_sort(F.collect_list(F.when(F.col("change") == sign, F.col("paper_id"))))
    return changes.groupBy("person_id").agg(lists(-1).alias("lost"), lists(1).alias("gained"), F.sum("change").alias("net"))


def goodness_delta(changes: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Mean score after less before of each changed paper; papers without scores on a side are left out."""
    papers = changes.select("paper_id").distinct()
    mean = lambda df, name: df.groupBy("paper_id").agg(F.avg("score").alias(name))
    return papers.join(mean(old, "before"), "paper_id").join(mean(new, "after"), "paper_id").withColumn("delta", F.col("after") - F.col("before")).where("delta is not null")


def merge_curated(existing: DataFrame, fresh: DataFrame, key: str, human: list[str], machine: dict[str, object]) -> DataFrame:
    """Full outer merge: people's columns come from existing, the machine's from fresh; rows that vanished keep a default."""
    left = existing.select(key, *human)
    right = fresh.select(key, *machine)
    return left.join(right, key, "full_outer").select(key, *human, *[F.coalesce(c, F.lit(d)).alias(c) for c, d in machine.items()])


def remap(pairs: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Rewrite a key by mapping(old, new); what it does not hold stays."""
    m = mapping.select(F.col("old").alias(column), F.col("new").alias("_new"))
    return pairs.join(m, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Values in only one of two one-column sets, and in which."""
    name = a.columns[0]
    return a.subtract(b).withColumn("only_in", F.lit("left")).unionByName(b.toDF(name).subtract(a).withColumn("only_in", F.lit("right")))


def merged_upload(baseline: DataFrame, patched: DataFrame) -> DataFrame:
    """Baseline rows of untouched papers and the patched papers' new rows."""
    return baseline.join(patched.select("paper_id").distinct(), "paper_id", "left_anti").unionByName(patched.select(*baseline.columns))


def rerun_pins(silent: DataFrame, manual: DataFrame, named: DataFrame) -> DataFrame:
    """(silent or touched by hand) without (named and not touched by hand)."""
    return silent.union(manual).distinct().subtract(named.subtract(manual))
