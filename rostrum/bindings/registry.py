"""Name to query and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its SQL if there is one."""
    def keep(function: Query) -> Query:
        _queries[function.__name__] = function
        if sql is not None:
            _sql[function.__name__] = sql
        return function
    return keep


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(c: Column | str, digits: int = 6) -> Column:
    """For the comparison with SQL: the engines add in different orders."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def sql_level(z: str) -> str:
    """SQL for the level of a z-score."""
    return (
        f"case when {z} is null or isnan({z}) then null when {z} <= -1 then 'low' "
        f"when {z} <= 1 then 'medium' else 'high' end"
    )


def sql_z(c: str, std: str = "stddev_samp", over: str = "over ()") -> str:
    """SQL for a z-score over the whole input."""
    return f"(({c}) - avg({c}) {over}) / nullif({std}({c}) {over}, 0)"
