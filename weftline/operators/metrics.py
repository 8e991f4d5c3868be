"""Evaluation and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dcg(relevance: Column, rank: Column, k: int = 10) -> Column:
    """An aggregate: gains 2 ** relevance - 1 over log2(rank + 1), ranks 1 to k."""
    return F.sum(F.when(rank <= k, (F.pow(F.lit(2.0), relevance) - 1) / F.log2(rank + 1.0)))


def ndcg(rows: DataFrame, key: str, relevance: str, rank: str, k: int = 10) -> DataFrame:
    ideal = rows.withColumn("_ideal", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(relevance))))
    out = ideal.groupBy(key).agg(dcg(F.col(relevance), F.col(rank), k).alias("dcg"), dcg(F.col(relevance), F.col("_ideal"), k).alias("ideal"))
    return out.withColumn("ndcg", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")))


def nearest_rank(values: Column, q: float) -> Column:
    """The value at place q * (n - 1), rounded half to even, of an ascending array."""
    return F.element_at(values, (F.bround(F.lit(q) * (F.size(values) - 1)) + 1).cast("int"))


def upper_median(values: Column) -> Column:
    return F.element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))


def percentiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles per key, nulls first; a key of any size is spread over tasks.

    Equal values are counted, the counts sorted over ranges of (key, value), and each range's share of a key before it
    added to the running count inside, so that the value at a place is found without a group in one task.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written once: a second run may draw other range bounds.
    placed = counts.repartitionByRange(parts, *keys, value).withColumn("_part", F.spark_partition_id()).checkpoint()
    held = placed.groupBy(*keys, "_part").agg(F.sum("_c").alias("_held"))  # few rows: a key has one in each of its ranges
    upto = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    by = [*keys, "_part"]
    names = {c: f"_of{k}" for k, c in enumerate(by)}
    starts = held.select(*[F.col(c).alias(names[c]) for c in by], F.coalesce(F.sum("_held").over(upto), F.lit(0)).alias("_before"), F.sum("_held").over(Window.partitionBy(*keys)).alias("_n"))
    joined = placed.join(starts, [F.col(c).eqNullSafe(F.col(names[c])) for c in by])
    running = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = joined.withColumn("_k", running)
    first = lambda q: F.min(F.when(F.col("_k") > F.bround(F.lit(q) * (F.col("_n") - 1)), F.struct("_k", value)))[value]
    return ranked.groupBy(*keys).agg(*[first(q).alias(name) for name, q in at.items()])


def goodness(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("paper_id").agg(F.avg("score").alias("goodness"), F.count("*").alias("n"))


def goodness_summary(goodness_: DataFrame, worst: int) -> DataFrame:
    """Mean, population deviation, least, and the mean of the worst so many papers."""
    low = goodness_.where("goodness is not null").orderBy("goodness", "paper_id").limit(worst).agg(F.avg("goodness").alias("worst_mean"))
    return goodness_.agg(F.count("goodness").alias("papers"), F.avg("goodness").alias("mean"), F.stddev_pop("goodness").alias("std"), F.min("goodness").alias("least")).crossJoin(low)


def floor_and_ceiling(pairs: DataFrame, k: int) -> DataFrame:
    """Per paper: the mean of all eligible scores and of its best k."""
    ranked = pairs.withColumn("_rank", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("score"), "person_id")))
    return ranked.groupBy("paper_id").agg(F.avg("score").alias("floor"), F.avg(F.when(F.col("_rank") <= k, F.col("score"))).alias("ceiling"))


def compare_arms(base: DataFrame, other: DataFrame) -> DataFrame:
    """Over the papers in both: how many, mean difference of goodness, and the share where other is better."""
    both = base.select("paper_id", F.col("goodness").alias("a")).join(other.select("paper_id", F.col("goodness").alias("b")), "paper_id")
    return both.agg(F.count("*").alias("papers"), F.avg(F.col("b") - F.col("a")).alias("mean_delta"), F.avg((F.col("b") > F.col("a")).cast("double")).alias("share_better"))


def seniority_report(assigned: DataFrame, people: DataFrame, *, per_paper: int, min_seniors: int, max_juniors: int, max_out_of_area: int) -> DataFrame:
    """ok, degraded or breaking per paper. people: person_id, senior, junior, out_of_area, almost_senior."""
    joined = assigned.join(people, "person_id")
    count = lambda c: F.count_if(F.col(c))
    rows = joined.groupBy("paper_id").agg(F.count("*").alias("n"), count("senior").alias("seniors"), count("almost_senior").alias("almost"), count("junior").alias("juniors"), count("out_of_area").alias("strangers"))
    breaking = (F.col("n") < per_paper) | (F.col("seniors") + F.col("almost") < min_seniors)
    degraded = (F.col("seniors") < min_seniors) | (F.col("juniors") > max_juniors) | (F.col("strangers") > max_out_of_area)
    return rows.withColumn("verdict", F.when(breaking, "breaking").when(degraded, "degraded").otherwise("ok"))


def shortage(targets: DataFrame, assigned: DataFrame, topics: DataFrame) -> DataFrame:
    """Open slots by topic; a paper's count for each of its topics."""
    held = assigned.groupBy("paper_id").agg(F.count("*").alias("held"))
    missing = targets.join(held, "paper_id", "left").select("paper_id", (F.col("target") - F.coalesce("held", F.lit(0))).alias("missing")).where("missing > 0")
    return missing.join(topics.select("paper_id", "topic").distinct(), "paper_id").groupBy("topic").agg(F.sum("missing").alias("missing"), F.count("*").alias("papers"))


def country_report(assigned: DataFrame, people_countries: DataFrame, paper_countries: DataFrame, cap: int) -> DataFrame:
    """Per country: papers at the cap, over it, and papers of that country."""
    same = assigned.join(people_countries.select("person_id", F.col("country").alias("theirs")), "person_id").join(paper_countries.where("country is not null").select("paper_id", "country"), "paper_id")
    per = same.groupBy("country", "paper_id").agg(F.count_if(F.col("theirs") == F.col("country")).alias("n"))
    return per.groupBy("country").agg(F.count("*").alias("papers"), F.count_if(F.col("n") == cap).alias("at_cap"), F.count_if(F.col("n") > cap).alias("over"))


def conflict_coverage(counts: DataFrame, tier: str, n: str) -> DataFrame:
    """Per tier: mean and upper median of conflicts per paper, and papers with none; over counts of each number of conflicts."""
    per = counts.groupBy(tier, n).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(tier).orderBy(n).rowsBetween(Window.unboundedPreceding, 0)
    ranked = per.withColumns({"_k": F.sum("_c").over(upto), "_n": F.sum("_c").over(Window.partitionBy(tier))})
    median = F.min(F.when(F.col("_k") > F.floor(F.col("_n") / 2), F.struct("_k", n)))[n]
    known = F.sum(F.when(F.col(n).isNotNull(), F.col("_c")))
    return ranked.groupBy(tier).agg((F.sum(F.col(n) * F.col("_c")) / known).alias("mean"), median.alias("upper_median"), F.coalesce(F.sum(F.when(F.col(n) == 0, F.col("_c"))), F.lit(0)).alias("with_none"))


def collision_suspects(conflicts: DataFrame, key: str, *, least: int = 20, rate: float = 0.1) -> DataFrame:
    """Names that meet many people and are hardly ever declared: likely several persons."""
    rows = conflicts.groupBy(key).agg(F.countDistinct("person_id").alias("people"), F.avg(F.col("declared").cast("double")).alias("declared_rate"))
    return rows.where((F.col("people") >= least) & (F.col("declared_rate") < rate))


def relaxation_report(assigned: DataFrame, targets: DataFrame, unrelaxed: tuple[str, ...] = ("senior anchor", "fill", "pinned")) -> DataFrame:
    """Papers with picks of a released phase, surplus aside, or with open slots: paper_id, relaxed picks and missing."""
    base = ~F.startswith("phase", F.lit("surplus"))
    held = assigned.where(base).groupBy("paper_id").agg(F.count_if(~F.col("phase").isin(*unrelaxed)).alias("relaxed"), F.count("*").alias("held"))
    rows = targets.join(held, "paper_id", "left").select("paper_id", F.coalesce("relaxed", F.lit(0)).alias("relaxed"), F.greatest(F.col("target") - F.coalesce("held", F.lit(0)), F.lit(0)).alias("missing"))
    return rows.where("relaxed > 0 or missing > 0")


def surplus_report(assigned: DataFrame) -> DataFrame:
    """Papers that got surplus people: paper_id, added, mean score without and with them."""
    extra = F.startswith("phase", F.lit("surplus"))
    return assigned.groupBy("paper_id").agg(F.count_if(extra).alias("added"), F.avg(F.when(~extra, F.col("score"))).alias("base_goodness"), F.avg("score").alias("goodness")).where("added > 0")


def assignments_report(assigned: DataFrame, people: DataFrame) -> DataFrame:
    """Per person, idle ones included: person_id, n_papers, their papers from the best score down, mean score."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "paper_id")))
    per = assigned.groupBy("person_id").agg(F.count("*").alias("n_papers"), F.transform(order, lambda x: x["paper_id"]).alias("papers"), F.avg("score").alias("mean_score"))
    return people.select("person_id").distinct().join(per, "person_id", "left").withColumn("n_papers", F.coalesce("n_papers", F.lit(0)))


def rollups(rows: DataFrame, dims: list[str], grains: list[list[str]], aggs: dict[str, Column]) -> DataFrame:
    """grain (its columns joined by +, all for none), dims (null where rolled up) and aggs, all grains in one pass.

    A null of the data stays apart from a rolled-up one: the grain tells them. Grains are among dims; an empty table has
    no rows, but for the grain of all.
    """
    sets = [[F.col(d) for d in g] for g in grains]
    bits = [F.grouping(d) for d in dims]
    grain = F.concat_ws("+", *[F.when(b == 0, F.lit(d)) for d, b in zip(dims, bits)])
    out = rows.groupingSets(sets, *dims).agg(grain.alias("grain"), *[c.alias(n) for n, c in aggs.items()])
    return out.select(F.coalesce(F.nullif("grain", F.lit("")), F.lit("all")).alias("grain"), *dims, *aggs)
