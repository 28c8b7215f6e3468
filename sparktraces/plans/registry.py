"""The list of registered queries and the helpers their definitions share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None
    covers: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query under ``name`` with the inventory ids it exercises and its SQL twin."""

    def add(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, run, sql, tuple(covers.split()))
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(value: Column | str, digits: int = 6) -> Column:
    """Double rounded half up in binary arithmetic, so every engine gives the same digits."""
    column = F.col(value) if isinstance(value, str) else value
    scale = F.lit(float(10**digits))
    return F.floor(column * scale + F.lit(0.5)) / scale


def sql_round(expression: str, digits: int = 6) -> str:
    """SQL twin of `rounded`."""
    return f"(floor(({expression})::DOUBLE * 1e{digits} + 0.5::DOUBLE) / 1e{digits})"
