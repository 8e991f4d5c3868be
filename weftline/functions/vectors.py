"""Vectors as arrays: sums in double, in the order of the places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """v over its length; zero stays zero."""
    n = norm(v)
    return F.transform(as_double(v), lambda x: F.when(n > 0, x / n).otherwise(x))


def pool(df: DataFrame, keys: list[str], vector: str, weight: Column, digits: int | None = None) -> DataFrame:
    """Weighted mean of each key's vectors, scaled to length one: a row per key and place, gathered again."""
    places = df.select(*keys, F.posexplode(as_double(F.col(vector))).alias("place", "x"), weight.alias("w")) if not isinstance(weight, str) else None
    mean = places.groupBy(*keys, "place").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    whole = mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("vector"))
    out = whole.withColumn("vector", unit(F.col("vector")))
    return out if digits is None else out.withColumn("vector", F.transform("vector", lambda x: F.round(x, digits)))
