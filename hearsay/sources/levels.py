"""A series table with sums per day and per month beside it.

Three folders below one path: ``fine`` holds the rows of the series in a partition per day, ``days``
sums of them per key and day, ``months`` sums of those per key and month. Sums merge, so the
sums of any range are those of the whole months in it, of the whole days before and after these, and
of the rows of the two days that the range cuts. Only the partitions of these pieces are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StructType

from hearsay.sources.counted import counted, observed

DAY, MONTH = "level_day", "level_month"
#: From a time, included, to a time, not included; ``None`` leaves a side open.
Piece = tuple[datetime | None, datetime | None]


def _day_start(at: datetime) -> datetime:
    return at.replace(hour=0, minute=0, second=0, microsecond=0)


def _month_start(at: datetime) -> datetime:
    return _day_start(at).replace(day=1)


def _next(at: datetime, start: Callable[[datetime], datetime], days: int) -> datetime:
    """The first start at or after a time; starts are at most ``days`` apart."""
    own = start(at)
    return own if own == at else start(own + timedelta(days=days))


def _moment(value: str | datetime) -> datetime:
    at = value if isinstance(value, datetime) else datetime.fromisoformat(str(value))
    return at.replace(tzinfo=None)


def cover(low=None, high=None) -> dict[str, list[Piece]]:
    """The coarsest pieces that make up the times from ``low`` to ``high``, both included."""
    start = None if low is None else _moment(low)
    end = None if high is None else _moment(high) + timedelta(microseconds=1)

    def inner(floor, days: int) -> tuple[Piece, bool]:
        first = None if start is None else _next(start, floor, days)
        last = None if end is None else floor(end)
        return (first, last), first is None or last is None or first < last

    def around(whole: Piece, part: Piece) -> list[Piece]:
        before = [(whole[0], part[0])] if part[0] is not None and whole[0] != part[0] else []
        after = [(part[1], whole[1])] if part[1] is not None and whole[1] != part[1] else []
        return before + after

    asked = (start, end)
    days, any_day = inner(_day_start, 1)
    months, any_month = inner(_month_start, 31)
    if not any_day:
        none = start is not None and end is not None and start >= end
        return {"fine": [] if none else [asked], "days": [], "months": []}
    if not any_month:
        return {"fine": around(asked, days), "days": [days], "months": []}
    return {"fine": around(asked, days), "days": around(days, months), "months": [months]}


def _within(column: Column, pieces: list[Piece], kind: str) -> Column:
    found = F.lit(False)
    for first, last in pieces:
        here = F.lit(True)
        if first is not None:
            here &= column >= F.lit(first.isoformat(" ")).cast(kind)
        if last is not None:
            here &= column < F.lit(last.isoformat(" ")).cast(kind)
        found |= here
    return found


@dataclass(frozen=True)
class Levels:
    """A series of ``schema`` with a key and a time; ``sums`` gives, by name, what is summed of a row.

    Rows without a time are in no range and are not kept. Rows without a key are summed as one key.
    """

    spark: SparkSession
    path: str
    schema: StructType
    key: str
    ts: str
    sums: Callable[[], dict[str, Column]]

    def _summed(self, rows: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
        types = rows.select(*[column.alias(name) for name, column in sums.items()]).schema
        totals = [
            F.sum(column).cast("decimal(38,0)" if isinstance(types[name].dataType, DecimalType)
                               else types[name].dataType).alias(name)
            for name, column in sums.items()
        ]
        return rows.groupBy(*by).agg(*totals)

    def _own(self) -> dict[str, Column]:
        return {name: F.col(name) for name in self.sums()}

    def _put(self, rows: DataFrame, level: str, column: str) -> None:
        dealt = rows.hint("rebalance", F.col(column))
        writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(column).parquet(f"{self.path}/{level}")

    def level(self, name: str) -> DataFrame:
        """The rows of ``fine``, ``days`` or ``months`` with the start of their partition."""
        schema = StructType(list(self.schema)).add(DAY, "date")
        if name != "fine":
            none = self.spark.createDataFrame([], schema)
            summed = self._summed(none, [self.key], self.sums()).schema
            schema = StructType(list(summed)).add(DAY if name == "days" else MONTH, "date")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def write(self, series: DataFrame) -> None:
        """Put in the days that ``series`` holds, in place of what they held, and renew the sums of the
        days and months from its first to its last day. A write that failed midway is made good
        by writing the same days again. ``series`` must not read this table."""
        timed = series.select(*self.schema.names).where(F.col(self.ts).isNotNull())
        dated, seen = counted(
            timed.withColumn(DAY, F.to_date(self.ts)), first=F.min(DAY), last=F.max(DAY))
        self._put(dated, "fine", DAY)
        found = observed(dated, seen)
        span = [F.lit(found.get(end)).cast("date") for end in ("first", "last")]
        fine = self.level("fine").where(F.col(DAY).between(*span))
        self._put(self._summed(fine, [self.key, DAY], self.sums()), "days", DAY)
        month = F.trunc(DAY, "month")
        days = self.level("days").where(
            F.col(DAY).between(F.trunc(span[0], "month"), F.last_day(span[1]))
        ).withColumn(MONTH, month)
        self._put(self._summed(days, [self.key, MONTH], self._own()), "months", MONTH)

    def rows(self, low=None, high=None) -> DataFrame:
        """The rows of the series in a range."""
        end = None if high is None else _moment(high) + timedelta(microseconds=1)
        return self._rows([(None if low is None else _moment(low), end)])

    def _rows(self, pieces: list[Piece]) -> DataFrame:
        """Days are bounded as well as times, so that partitions are pruned."""
        days = [
            (None if first is None else _day_start(first),
             None if last is None else _next(last, _day_start, 1))
            for first, last in pieces
        ]
        kept = self.level("fine").where(_within(F.col(DAY), days, "date"))
        return kept.where(_within(F.col(self.ts), pieces, "timestamp_ntz")).drop(DAY)

    def parts(self, low=None, high=None) -> DataFrame:
        """The key and the sums of every piece of a range, not merged yet."""
        pieces = cover(low, high)
        found = self._rows(pieces["fine"]).select(
            self.key, *[column.alias(name) for name, column in self.sums().items()])
        for level, column in (("days", DAY), ("months", MONTH)):
            if pieces[level]:
                kept = self.level(level).where(_within(F.col(column), pieces[level], "date"))
                found = found.unionByName(kept.drop(column))
        return found

    def totals(self, low=None, high=None) -> DataFrame:
        """The sums of every key in a range, in one aggregate over its pieces."""
        return self._summed(self.parts(low, high), [self.key], self._own())
