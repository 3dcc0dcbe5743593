"""Dense series: every key in every bucket, absent points filled with zero.

No cross join is made. What is exploded is the array of a calendar's buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.operators.ranks import top_k


def zero_fill(
    points: DataFrame,
    keys: DataFrame,
    buckets: DataFrame,
    key: str,
    bucket: str,
    values: list[str],
) -> DataFrame:
    """``points`` on the full grid of ``keys`` and ``buckets``.

    Any number of keys will do: each explodes the distinct buckets, which are the time steps
    of one calendar.
    """
    calendar = buckets.select(bucket).distinct().agg(F.collect_list(bucket)).scalar()
    wanted = keys.select(key).distinct()
    grid = wanted.withColumn(bucket, F.explode(calendar))
    kept = points.join(wanted, key, "left_semi")
    filled = grid.join(kept, [key, bucket], "left")
    return filled.select(
        key, bucket, *[F.coalesce(F.col(value), F.lit(0)).alias(value) for value in values]
    )


def top_series(
    points: DataFrame, key: str, bucket: str, values: list[str], k: int, weight: str
) -> DataFrame:
    """The k keys of largest total weight, each with its points as a list ``series``.

    Keys are ranked by sums alone, and lists are made for the k keys only. Both sides share
    the exchange of ``points``, which has one row per key and bucket: a list is as long as
    the calendar, however often a key is used.
    """
    # The join filters null keys; doing it here lets both sides share one exchange.
    known = points.filter(F.col(key).isNotNull())
    sums = {value: f"__{value}" for value in values if value != weight}
    totals = known.groupBy(key).agg(
        F.sum(weight).alias("total"), *[F.sum(value).alias(name) for value, name in sums.items()]
    )
    # Ranking asks for the other values too: with fewer columns it would have another exchange.
    present = F.col("total").isNotNull()
    for name in sums.values():
        present = present | F.col(name).isNotNull()
    top = top_k(totals.filter(present).drop(*sums.values()), "total", k, key)
    return known.join(top, key).groupBy(key, "total").agg(
        F.collect_list(F.struct(bucket, *values)).alias("series")
    )


def dense_series(
    listed: DataFrame, buckets: DataFrame, key: str, bucket: str, values: list[str]
) -> DataFrame:
    """The lists of ``top_series`` as rows, with zeros in the buckets they lack."""
    kinds = {field.name: field.dataType for field in listed.schema["series"].dataType.elementType}
    empty = F.struct(bucket, *[F.lit(0).cast(kinds[value]).alias(value) for value in values])
    zeros = buckets.select(bucket).distinct().agg(F.collect_list(empty)).scalar()
    rows = listed.select(key, F.inline(F.concat("series", zeros)))
    return rows.groupBy(key, bucket).agg(*[F.sum(value).alias(value) for value in values])
