"""Named queries over the driver tables, each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labelloom.plans.views import Views
from labelloom.session import prepare

Query = Callable[[Views], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.plans: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(plan: Query) -> Query:
            if name in self.plans:
                raise ValueError(f"query {name} is registered twice")
            self.plans[name] = plan
            if sql is not None:
                self.sql[name] = sql
            return plan

        return keep

    def callables(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        def bind(plan: Query) -> Callable[[SparkSession, str], DataFrame]:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                prepare(spark, sf_dir)
                return plan(Views(spark, sf_dir))

            return run

        return {name: bind(plan) for name, plan in self.plans.items()}
