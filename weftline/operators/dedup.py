"""One row of many: latest, highest rank, same title, recent with a fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that must be total."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def latest_row(df: DataFrame, key: Column, when: str, position: str) -> DataFrame:
    """The newest row of each key; of equal times the one that stands first."""
    return best_row(df.withColumn("_key", key), ["_key"], [F.desc(when), F.asc(position)]).drop("_key")


def collapse(df: DataFrame, key: str, rank: Column, position: str) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped with the kept position): the highest rank of each key, of equal ranks the first."""
    w = Window.partitionBy(key).orderBy(rank.desc(), F.asc(position))
    ranked = df.withColumn("_rank", F.row_number().over(w)).withColumn("kept_position", F.first(position).over(w))
    return ranked.where("_rank = 1").drop("_rank", "kept_position"), ranked.where("_rank > 1").drop("_rank")


def title_key(title: Column) -> Column:
    """Titles compare in lower case without dots and blanks at the end."""
    return F.regexp_replace(F.lower(title), "[. ]+$", "")


def dedup_titles(df: DataFrame, keys: list[str], title: str, year: str, position: str) -> DataFrame:
    """One row per key and title: the spelling that stands first, the latest year."""
    grouped = df.groupBy(*keys, title_key(F.col(title)).alias("title_key")).agg(F.max(year).alias(year), F.min_by(title, position).alias(title), F.min(position).alias(position))
    return grouped.select(*keys, title, year, position)


def recent(df: DataFrame, year: str, years: int, current_year: int) -> DataFrame:
    """Calendar years, the current one included."""
    return df.where(F.col(year) >= current_year - years + 1)


def recent_or_latest(df: DataFrame, keys: list[str], year: str, order: list[Column], *, years: int, current_year: int, least: int, fallback: int) -> DataFrame:
    """Each key's rows of the last years; where fewer than least, its latest fallback rows instead."""
    inside = F.col(year) >= current_year - years + 1
    marked = df.withColumns({"_in": inside, "_n": F.count_if(inside).over(Window.partitionBy(*keys)), "_rank": F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(year), *order))})
    return marked.where((F.col("_n") >= least) & F.col("_in") | (F.col("_n") < least) & (F.col("_rank") <= fallback)).drop("_in", "_n", "_rank")


def top_counts(df: DataFrame, keys: list[str], value: str, most: int) -> DataFrame:
    """Each key's most frequent values, ties in the values' order."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc(value)))).where(F.col("rank") <= most)


def shared_claims(df: DataFrame, claim: str) -> DataFrame:
    """Marks every row whose claim others make too; none of them is believed."""
    return df.withColumn("claimants", F.count(claim).over(Window.partitionBy(claim))).withColumn("shared", F.col("claimants") > 1)
