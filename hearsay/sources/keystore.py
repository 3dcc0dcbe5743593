"""Tables that are found by key: processed keys, and rows that are upserted and patched.

Neither is shuffled or rewritten as a whole when a little comes in: processed keys lie in hash
buckets, so that only new keys move to them; keyed rows lie in partitions by a hash of the key, and
a change reads and overwrites the partitions it touches.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.operators.keys import latest_per_key, patch
from hearsay.session import shared_path

PART = "key_part"


@dataclass(frozen=True)
class ProcessedKeys:
    """Distinct keys in ``buckets`` hash buckets below ``path``.

    A bucket should fit an executor's sort buffer: a billion eight-byte keys take about 500 buckets.
    The number of buckets belongs to the table and must be the same for all that open it.
    """

    spark: SparkSession
    path: str
    key: str
    kind: str
    buckets: int = 200

    @property
    def name(self) -> str:
        return f"processed_{hashlib.md5(self.path.encode()).hexdigest()}"

    def table(self) -> DataFrame:
        """The keys as a bucketed table; it is made, or found at its path, when first asked for."""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (`{self.key}` {self.kind}) USING parquet "
            f"CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS "
            f"LOCATION '{self.path}'"
        )
        return self.spark.table(self.name)

    def pending(self, keys: DataFrame) -> DataFrame:
        """Distinct keys that are not in the table. Only the wanted ones are shuffled, to its
        buckets; repeats of a hot key are removed before.

        An outer join, since the planner would move an anti join below the dealing, and then deal
        the table too.
        """
        wanted = keys.select(F.col(self.key).cast(self.kind).alias(self.key)).dropna()
        dealt = wanted.distinct().repartition(self.buckets, self.key)
        there = self.table().withColumn("there", F.lit(True))
        return dealt.join(there, self.key, "left").where("there IS NULL").select(self.key)

    def add(self, keys: DataFrame) -> None:
        """Add keys; those that are there already are not written again. Adding twice changes
        nothing, so a failed job may be run again."""
        path = shared_path(self.spark, "new-keys")
        self.pending(keys).write.parquet(path)
        fresh = self.spark.read.parquet(path).repartition(self.buckets, self.key)
        self.table()
        fresh.write.mode("append").insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def mark(
        self, results: DataFrame, status: str = "status", done: tuple[int, ...] = (200, 400, 404)
    ) -> None:
        """Add the keys that were fetched or are permanently missing; others stay pending."""
        self.add(results.filter(F.col(status).isin(list(done))))


@dataclass(frozen=True)
class KeyedTable:
    """One row per key, in ``parts`` partitions by a hash of ``keys``.

    A change stages its partitions beside the table and then overwrites just these (dynamic
    partition overwrite); files of other partitions stay as they are. Both changes give the
    same rows when run again, which is what to do after one that failed half way. One writer at
    a time.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    parts: int = 200

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def _write(self, rows: DataFrame, path: str) -> None:
        dealt = rows.withColumn(PART, self._part()).hint("rebalance", F.col(PART))
        writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(PART).parquet(path)

    def create(self, rows: DataFrame) -> None:
        """Write the first rows; they must hold a key once (see ``latest_per_key``)."""
        self._write(rows, self.path)

    def read(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(self.path).drop(PART)

    def touched(self, changes: DataFrame) -> list[int]:
        """The partitions that the keys of some rows are in."""
        return sorted(row[0] for row in changes.select(self._part()).distinct().collect())

    def _of(self, parts: list[int]) -> DataFrame:
        rows = self.spark.read.option("basePath", self.path).parquet(self.path)
        return rows.where(F.col(PART).isin(parts)).drop(PART)

    def _replace(self, rows: DataFrame) -> None:
        staged = shared_path(self.spark, "staged")
        self._write(rows, staged)
        self._write(self.spark.read.parquet(staged).drop(PART), self.path)

    def upsert(self, new: DataFrame, order: str, tie: list[str] | None = None) -> list[int]:
        """Merge rows, the last write per key by ``order`` winning. Returns the partitions touched."""
        parts = self.touched(new)
        if parts:
            base = self._of(parts)
            rows = base.unionByName(new.select(*base.columns))
            self._replace(latest_per_key(rows, list(self.keys), order, tie))
        return parts

    def patch(self, updates: DataFrame, columns: list[str]) -> list[int]:
        """Overwrite ``columns`` by the non-null values of updates, one for each key at most; keys
        that are not in the table are not added. Returns the partitions touched."""
        parts = self.touched(updates)
        if parts:
            self._replace(patch(self._of(parts), updates, list(self.keys), columns))
        return parts
