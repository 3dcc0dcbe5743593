"""Top-k, ranks over a whole table, running totals, shares and scaling.

An unpartitioned window sorts the whole table in one task. Nothing here uses one on rows:
``global_order`` and ``global_ranks`` sort by range partitions and add the totals of the
partitions before, and shares take their total from a scalar subquery.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearsay.session import ensure_checkpoint_dir

# Averages are ranked on nine decimals: the order in which partial sums meet changes the
# last bits of a double, and must not decide between equal scores.
RANK_DIGITS = 9


def rank_key(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, RANK_DIGITS)


def _sort_column(name: str, descending: bool) -> Column:
    return F.col(name).desc() if descending else F.col(name).asc()


def top_k(
    df: DataFrame, by: Column | str, k: int, tie: str | list[str], descending: bool = True
) -> DataFrame:
    """The k best rows in a total order (ties by ``tie`` ascending); nulls come last.

    Spark plans this as TakeOrderedAndProject: k rows per task, then a merge of those.
    """
    column = F.col(by) if isinstance(by, str) else by
    first = column.desc_nulls_last() if descending else column.asc_nulls_last()
    ties = [tie] if isinstance(tie, str) else tie
    return df.orderBy(first, *[F.asc(name) for name in ties]).limit(k)


def pool_top_k(
    df: DataFrame, pool_by: str, pool: int, score: Column | str, k: int, tie: str
) -> DataFrame:
    """The ``pool`` most frequent rows, then the k best of those by ``score``."""
    return top_k(top_k(df, pool_by, pool, tie), score, k, tie)


def top_per_group(
    df: DataFrame,
    group: str | list[str],
    by: Column | str,
    k: int,
    tie: str,
    descending: bool = True,
    out: str = "rn",
) -> DataFrame:
    """The k best rows of each group with their rank.

    Spark plans ``row_number() <= k`` with WindowGroupLimit, which keeps k rows per group
    and task before the shuffle; a hot group is cut down where it is read.
    """
    groups = [group] if isinstance(group, str) else list(group)
    column = F.col(by) if isinstance(by, str) else by
    first = column.desc_nulls_last() if descending else column.asc_nulls_last()
    window = Window.partitionBy(*groups).orderBy(first, F.asc(tie))
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= k)


def head_tail(df: DataFrame, by: str, n: int = 10) -> DataFrame:
    """The first n and the last n rows of an order, marked ``first`` and ``last``."""
    head = df.orderBy(F.asc(by)).limit(n).withColumn("part", F.lit("first"))
    tail = df.orderBy(F.desc(by)).limit(n).withColumn("part", F.lit("last"))
    return head.unionByName(tail)


# Bits of monotonically_increasing_id that count within a partition.
PLACE_BITS = 33


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in sorted range partitions, each with its partition's number and its place there (from
    0), written to the checkpoint.

    The bounds of a range partitioning are sampled, so two runs of it may differ. The
    checkpoint pins one: totals and rows then speak of the same partitions, also after an
    executor is lost. Sessions of ``build_session`` remove it once nothing refers to it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__id", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__id", PLACE_BITS).cast("int"))
        .withColumn("__place", F.col("__id").bitwiseAND((1 << PLACE_BITS) - 1))
        .drop("__id")
        .checkpoint()
    )


def _before(ranged: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Per range partition, the totals of all partitions before it.

    One row per partition, so the window below and the broadcast of its result are
    bounded by the number of shuffle partitions.
    """
    window = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = ranged.groupBy("__part").agg(
        *[total.alias(name) for name, total in totals.items()]
    )
    return per_part.select(
        "__part", *[F.coalesce(F.sum(name).over(window), F.lit(0)).alias(name) for name in totals]
    )


def _key_starts():
    """A function that gives the places of a batch where another key begins, 0 among them."""

    def starts(batch, keys: list[str]):
        import numpy
        import pyarrow.compute as compute

        change = numpy.zeros(batch.num_rows, bool)
        change[:1] = True
        for key in keys:
            one, two = batch.column(key).slice(1), batch.column(key).slice(0, batch.num_rows - 1)
            differ = compute.fill_null(compute.not_equal(one, two), False)
            hollow = compute.not_equal(compute.is_null(one), compute.is_null(two))
            change[1:] |= compute.or_(differ, hollow).to_numpy(zero_copy_only=False)
        return numpy.flatnonzero(change)

    return starts


def _carried(rows: DataFrame, value: str, keys: list[str], earlier: str, out: str) -> DataFrame:
    """Add the running sum of ``value`` in each sorted partition, beginning from ``earlier`` with each
    of ``keys`` (whose rows follow each other). Missing values add nothing; before the first value
    the sum is missing.

    The sum is carried from batch to batch while a partition streams through, so rows are not
    dealt and sorted a second time for a window.
    """
    kind = rows.agg(F.sum(value).alias(out)).schema[out].dataType
    typed = rows.withColumn("__x", F.col(value).cast(kind)).withColumn(
        earlier, F.col(earlier).cast(kind))
    schema = rows.drop(earlier).withColumn(out, F.lit(None).cast(kind)).schema

    starts_of = _key_starts()

    def batches(stream: Iterator) -> Iterator:
        from itertools import accumulate

        import numpy
        import pyarrow

        def add(total, x):
            return total if x is None else x if total is None else total + x

        last, carry = None, None
        for batch in stream:
            if not batch.num_rows:
                continue
            starts = starts_of(batch, keys)
            begins = batch.column(earlier).take(pyarrow.array(starts)).to_pylist()
            first = tuple(batch.column(key)[0].as_py() for key in keys)
            if first == last:
                begins[0] = carry
            column = batch.column("__x")
            if pyarrow.types.is_integer(column.type) or pyarrow.types.is_floating(column.type):
                import pandas

                own = numpy.repeat(numpy.arange(len(starts)), numpy.diff([*starts, batch.num_rows]))
                valid = column.is_valid().to_numpy(zero_copy_only=False)
                plain = column.fill_null(0).to_numpy(zero_copy_only=False)
                sums = pandas.Series(plain).groupby(own).cumsum().to_numpy()
                base = numpy.array([b or 0 for b in begins], sums.dtype)
                none = numpy.array([b is None for b in begins])[own]
                none &= pandas.Series(valid.astype(int)).groupby(own).cumsum().to_numpy() == 0
                sums = pyarrow.array(sums + base[own], column.type, mask=none)
            else:
                values, found = column.to_pylist(), []
                for begin, start, stop in zip(begins, starts, [*starts[1:], batch.num_rows]):
                    found += list(accumulate([begin, *values[start:stop]], add))[1:]
                sums = pyarrow.array(found, column.type)
            last = tuple(batch.column(key)[batch.num_rows - 1].as_py() for key in keys)
            carry = sums[len(sums) - 1].as_py()
            kept = [name for name in batch.schema.names if name not in ("__x", earlier)]
            yield pyarrow.RecordBatch.from_arrays(
                [*[batch.column(name) for name in kept], sums], [*kept, out])

    return typed.mapInArrow(batches, schema)


def global_order(
    df: DataFrame, order: str, tie: str, value: str | None = None, descending: bool = False
) -> DataFrame:
    """``row_number`` over the whole table, and with ``value`` the running sum up to each row.

    The tie column makes the order total; it also lets a value shared by many rows be
    split over several range partitions.
    """
    keys = [_sort_column(order, descending), F.col(tie).asc()]
    ranged = _ranged(df, keys)
    totals = {"__rows": F.count(F.lit(1))}
    if value:
        totals["__sum"] = F.sum(value)
        totals["__values"] = F.count(value)
    joined = ranged.join(F.broadcast(_before(ranged, totals)), "__part")
    out = joined.withColumn("row_number", F.col("__place") + 1 + F.col("__rows"))
    if value:
        known = out.withColumn("__sum", F.when(F.col("__values") > 0, F.col("__sum")))
        out = _carried(known, value, [], "__sum", "running_sum")
    return out.drop("__part", "__place", "__rows", "__sum", "__values")


def global_places(df: DataFrame, order: str) -> DataFrame:
    """Add ``__i``, a row's place in the order of the whole table from 0, and ``__last``, the
    place of the last one."""
    ranged = _ranged(df, [F.col(order).asc()])
    per_part = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("__part").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    # One row for each partition.
    counts = per_part.select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__rows"),
        (F.sum("__n").over(every) - 1).alias("__last"))
    return (
        ranged.join(F.broadcast(counts), "__part")
        .withColumn("__i", F.col("__rows") + F.col("__place"))
        .drop("__part", "__place", "__rows")
    )


def global_ranks(
    df: DataFrame, order: str, value: str | None = None, descending: bool = False
) -> DataFrame:
    """``rank`` and ``dense_rank`` over the whole table, and with ``value`` the sum over all
    rows up to and including the ties of each row (the default range frame).

    All three depend on the sort value alone, so they are worked out on one row per
    distinct value and joined back.
    """
    per_value = df.groupBy(order).agg(
        F.count(F.lit(1)).alias("__n"),
        *([F.sum(value).alias("__v")] if value else []),
    )
    keys = [_sort_column(order, descending)]
    ranged = _ranged(per_value, keys)
    totals = {"__rows": F.sum("__n"), "__values": F.count(F.lit(1))}
    if value:
        totals["__sum"] = F.sum("__v")
    joined = ranged.join(F.broadcast(_before(ranged, totals)), "__part")
    window = Window.partitionBy("__part").orderBy("__place")
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    ranks = [
        (F.sum("__n").over(upto) - F.col("__n") + F.col("__rows") + 1).alias("rank"),
        (F.col("__place") + 1 + F.col("__values")).alias("dense_rank"),
    ]
    if value:
        ranks.append((F.sum("__v").over(upto) + F.col("__sum")).alias("range_sum"))
    # Null-safe, since rows without a sort value have a rank too.
    ranked = joined.select(F.col(order).alias("__value"), *ranks)
    return df.join(ranked, F.col(order).eqNullSafe(F.col("__value"))).drop("__value")


def running_total(
    df: DataFrame, partition: str | list[str], order: list[str], value: str,
    out: str = "running_sum",
) -> DataFrame:
    """Running sum within each partition key; ``order`` names columns that make the order
    total.

    Rows are range-partitioned by key and order, so a key that holds a large share of them
    lies in several tasks. Keys cut by a border get the sum of their earlier parts: that is
    less than one row per range partition, hence the broadcast.
    """
    keys = [partition] if isinstance(partition, str) else list(partition)
    ranged = _ranged(df, [F.col(name).asc() for name in (*keys, *order)])
    parts = ranged.groupBy("__part", *keys).agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    first = Window.partitionBy(*keys).orderBy("__part")
    cut = (
        parts.withColumn("__before", F.sum("__sum").over(earlier))
        .withColumn("__nth", F.row_number().over(first))
        .filter(F.col("__nth") > 1)
        .select(F.col("__part").alias("__at"), "__before",
                *[F.col(key).alias(f"__key_{key}") for key in keys])
    )
    same = F.col("__part") == F.col("__at")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"__key_{key}"))
    joined = ranged.join(F.broadcast(cut), same, "left")
    rows = joined.select(*df.columns, "__before")
    return _carried(rows, value, keys, "__before", out)


def share(df: DataFrame, value: str, out: str = "percent", scale: float = 100.0) -> DataFrame:
    """Each row's share of the column total (0 where the total is 0)."""
    total = df.agg(F.sum(value).cast("double")).scalar()
    part = F.when(total != 0, F.col(value) * F.lit(scale) / total).otherwise(0.0)
    return df.withColumn(out, part)


def share_of_max(df: DataFrame, value: str, out: str) -> DataFrame:
    """Each row relative to the column maximum (a maximum of 0 or none counts as 1)."""
    top = df.agg(F.max(value).cast("double")).scalar()
    return df.withColumn(out, F.col(value) / F.coalesce(F.nullif(top, F.lit(0.0)), F.lit(1.0)))


def scale_minmax(
    df: DataFrame, value: str, present: Column | None = None, out: str = "scaled"
) -> DataFrame:
    """Each row's place between the column minimum and maximum, cut to [0, 1].

    Only rows where ``present`` holds set the range; without any it is -1 to 1. On a flat
    column every row is in the middle.
    """
    counted = df if present is None else df.filter(present)
    low = F.coalesce(counted.agg(F.min(value).cast("double")).scalar(), F.lit(-1.0))
    high = F.coalesce(counted.agg(F.max(value).cast("double")).scalar(), F.lit(1.0))
    place = (F.col(value) - low) / F.nullif(high - low, F.lit(0.0))
    cut = F.greatest(F.lit(0.0), F.least(F.lit(1.0), place))
    return df.withColumn(out, F.when(high == low, F.lit(0.5)).otherwise(cut))
