"""Key handling: pending work, last version per key, patches and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.operators.ranks import global_order


def pending_keys(keys: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Distinct keys not yet processed.

    ``distinct`` runs first: its map-side half removes repeats of a hot key before
    anything is shuffled, and the anti join then reuses its partitioning.
    """
    wanted = keys.select(key).dropna().distinct()
    return wanted.join(processed.select(key).dropna(), key, "left_anti")


def mark_processed(
    processed: DataFrame,
    results: DataFrame,
    key: str,
    status: str = "status",
    done: tuple[int, ...] = (200, 400, 404),
) -> DataFrame:
    """Processed keys after a fetch: fetched or permanently missing ones are added, keys of
    failed batches stay pending."""
    finished = results.filter(F.col(status).isin(list(done))).select(key)
    return processed.select(key).unionByName(finished).dropna().distinct()


def latest_per_key(
    df: DataFrame, key: str | list[str], ts: str, tie: list[str] | None = None
) -> DataFrame:
    """The latest row per key.

    An aggregate rather than a window: it combines map-side, so a key holding a large
    share of the rows never meets in one task. Ties in time go to the larger ``tie``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [column for column in df.columns if column not in keys]
    order = F.struct(ts, *(tie or []))
    last = F.max_by(F.struct(*rest), order).alias("last")
    return df.groupBy(*keys).agg(last).select(*keys, "last.*").select(*df.columns)


def upsert(
    base: DataFrame, new: DataFrame, key: str | list[str], order: str, tie: list[str] | None = None
) -> DataFrame:
    """Base and new rows merged, the last write per key winning. Running it twice with the
    same rows changes nothing."""
    return latest_per_key(base.unionByName(new), key, order, tie)


def patch(base: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Overwrite ``columns`` of matching rows by the update's non-null values.

    Updates must hold one row per key (see ``latest_per_key``); rows without an update
    stay as they are.
    """
    renamed = updates.select(
        *keys, *[F.col(column).alias(f"__new_{column}") for column in columns]
    )
    joined = base.join(renamed, keys, "left")
    return joined.select(
        *[
            F.coalesce(f"__new_{column}", column).alias(column)
            if column in columns
            else F.col(column)
            for column in base.columns
        ]
    )


def chunk(df: DataFrame, key: str, size: int = 25) -> DataFrame:
    """Number distinct keys in batches of ``size`` by their order: adds ``batch``. Every batch is
    full but the last. Positions come from ``global_order``, so no task sorts all keys."""
    return (
        global_order(df, key, key)
        .withColumn("batch", F.floor((F.col("row_number") - 1) / size).cast("bigint"))
        .drop("row_number")
    )
