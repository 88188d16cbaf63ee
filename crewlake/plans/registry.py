"""Named queries over the given tables, each with its statement for the other engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from crewlake.plans.stand_in import Tables
from crewlake.plans.twins import sql

Build = Callable[[Tables], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    oracle: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))


QUERIES: dict[str, Query] = {}


def add(name: str, build: Build, oracle: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is already registered")
    QUERIES[name] = Query(name, build, sql(oracle) if oracle else None)


def load_all() -> dict[str, Query]:
    from crewlake.plans import q_controls, q_gold, q_index, q_logs, q_more, q_serving, q_silver  # noqa: F401
    return QUERIES
