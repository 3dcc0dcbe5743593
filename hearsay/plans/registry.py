"""The list of registered queries.

A query is a function of a session and a data folder. Its SQL twin, where there is one,
gives the same columns and rows. Results are flattened the same way on both sides: doubles
to six decimals, dates and times to text, whole numbers to BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Run = Callable[[SparkSession, str], DataFrame]
DIGITS = 6


@dataclass(frozen=True)
class Query:
    name: str
    items: str
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def flat(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """The result in types that every client compares alike."""
    columns = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            column = F.round(column.cast("double"), digits)
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(
    name: str, items: str, sql: str | None = None, digits: int = DIGITS
) -> Callable[[Run], Run]:
    """Register a query; ``items`` names the operators of the survey it covers."""

    def add(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")

        def flattened(spark: SparkSession, folder: str) -> DataFrame:
            return flat(run(spark, folder), digits)

        REGISTRY[name] = Query(name, items, flattened, sql.strip() if sql else None)
        return run

    return add


def add(
    name: str, items: str, run: Run, sql: str | None = None, digits: int = DIGITS
) -> None:
    query(name, items, sql, digits)(run)
