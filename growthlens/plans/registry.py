"""Registered queries: one per operator, each with its DuckDB oracle SQL.

Every query reads the shared test tables through ``bindings`` and runs the
operator over the whole tables.  ``portable`` gives the result a layout both
engines print alike: dates as ISO text, decimals as doubles, string arrays
joined with ``|``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None):
    def deco(fn):
        REGISTRY[name] = Query(name, lambda spark, sf_dir: portable(fn(spark, sf_dir)), oracle)
        return fn
    return deco


def portable(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        dt = f.dataType
        if isinstance(dt, T.DateType):
            c = c.cast("string")
        elif isinstance(dt, T.DecimalType):
            c = c.cast("double")
        elif isinstance(dt, T.ArrayType) and isinstance(dt.elementType, T.StringType):
            c = F.array_join(c, "|")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def ints_as_double(df: DataFrame, *cols: str) -> DataFrame:
    """Exchange integer columns that hold NULLs as doubles.

    Spark and DuckDB convert a nullable integer column to different pandas
    types (float with NaN vs a nullable integer type), so such columns are
    compared as doubles on both sides; the values are unchanged (< 2**53).
    """
    return df.select(*[F.col(f"`{c}`").cast("double").alias(c) if c in cols else F.col(f"`{c}`")
                       for c in df.columns])


def _load_all() -> None:
    # importing the query modules fills REGISTRY
    from growthlens.plans import (  # noqa: F401
        queries_affiliate,
        queries_behavior,
        queries_catalog,
        queries_flow,
        queries_ingest,
        queries_more,
    )


def all_queries() -> dict[str, Query]:
    _load_all()
    return dict(REGISTRY)
