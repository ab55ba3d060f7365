"""The named queries, each with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwave import session
from spanwave.functions import times

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with its SQL counterpart."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(session.prepare(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def tidy(df: DataFrame, digits: dict[str, int] | None = None) -> DataFrame:
    """Plain output columns: whole numbers as bigint, times as ISO text, lists as joined text and
    fractions rounded (6 digits unless ``digits`` says otherwise).
    """
    digits = digits or {}
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits.get(field.name, 6)) + F.lit(0.0)
        elif isinstance(kind, T.TimestampType):
            c = times.iso_millis(c)
        elif isinstance(kind, T.ArrayType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
        columns.append(c.alias(field.name))
    return df.select(*columns)
