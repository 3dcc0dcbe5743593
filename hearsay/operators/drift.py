"""Schema drift between two feeds of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_keys(lines: DataFrame, raw: str) -> DataFrame:
    """Distinct top-level keys; lines that do not parse have none."""
    return lines.select(F.explode(F.json_object_keys(raw)).alias("key")).distinct()


def schema_drift(old: DataFrame, new: DataFrame, raw: str = "value") -> DataFrame:
    """Keys that only one side has: ``missing`` in the new feed or ``added`` by it.

    All lines are read, not the first hundred, so rare keys show too.
    """
    before, after = json_keys(old, raw), json_keys(new, raw)
    missing = before.subtract(after).withColumn("change", F.lit("missing"))
    added = after.subtract(before).withColumn("change", F.lit("added"))
    return missing.unionByName(added)
