"""Registration of queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.functions.values import Table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``covers`` lists the inventory ids it shows."""

    def keep(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice.")
        QUERIES[name] = function
        COVERS[name] = covers
        if sql is not None:
            ORACLE[name] = sql
        return function

    return keep


def load(spark: SparkSession, folder: str, name: str, row_key: str | None = None) -> Table:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return Table(spark.read.parquet(f"{folder}/{name}.parquet"), row_key)


def shown(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    """Round doubles for comparison and widen integers."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, special.get(f.name, digits)) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)
