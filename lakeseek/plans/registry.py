"""Every operator's query over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeseek.plans.bindings import Lake, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, others as double."""
    kinds = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}
    cast = {c: F.col(f"`{c}`").cast(kinds[k] if k in kinds else "double") for c, k in df.dtypes if k in kinds or k.startswith("decimal")}
    return df.withColumns(cast) if cast else df


def op(name: str, needs: str = "", oracle: str | None = None, extra: dict | None = None):
    """Registers f(lake) under a name, with its oracle: SQL over the named CTEs."""

    def add(f: Callable[[Lake], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: _tidy(f(Lake(spark, sf_dir)))
        if oracle is not None:
            ORACLE_SQL[name] = sql(needs, oracle, extra)
        return f

    return add


from lakeseek.plans import q_aggregates, q_basic, q_evaluate, q_functions, q_joins, q_search, q_sources  # noqa: E402, F401
