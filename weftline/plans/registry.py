"""How a plan module names its queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.session import ship


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Register a function of a table reader under its name, with the SQL that gives the same rows."""

        def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship(spark)
                return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

            self.queries[f.__name__] = run
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add
