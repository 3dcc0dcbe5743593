"""Sinks: tables, exports, SQL stores, and in-place rewrites."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from hearsay.functions.text import scrub_nul
from hearsay.operators.filters import created_posts


def write_table(
    df: DataFrame, path: str, mode: str = "append", partition_by: list[str] | None = None
) -> None:
    """Parquet sink; mode is append, overwrite, error or ignore."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def convert_format(
    spark: SparkSession, source: str, target: str, schema=None, mode: str = "overwrite"
) -> DataFrame:
    """JSON lines rewritten as a Parquet table."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    reader.json(source).write.mode(mode).parquet(target)
    return spark.read.parquet(target)


def compact_posts(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Created posts only, in files of bounded size, for a job that reads them often.

    Rows are dealt anew in portions of the advisory size: many small inputs become few files.
    """
    created_posts(df).hint("rebalance").write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(
        path
    )


def to_topic_value(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows as the JSON ``value`` of topic messages; ``key`` keeps one key's order."""
    value = F.to_json(F.struct(*df.columns)).alias("value")
    return df.select(F.col(key).cast("string").alias("key"), value) if key else df.select(value)


def write_topic(df: DataFrame, servers: str, topic: str, checkpoint: str):
    """Publish a stream to Kafka (the Kafka connector must be on the class path)."""
    return (
        to_topic_value(df)
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .start()
    )


def clean_text_columns(df: DataFrame) -> DataFrame:
    """All text columns without NUL characters."""
    return df.select(
        *[
            scrub_nul(field.name).alias(field.name)
            if isinstance(field.dataType, StringType)
            else F.col(field.name)
            for field in df.schema
        ]
    )


def publish_table(
    df: DataFrame, url: str, table: str, truncate: bool = True, batch: int = 5000, **properties: str
) -> None:
    """Full refresh of a SQL table; ``truncate`` keeps its definition and grants."""
    (
        clean_text_columns(df)
        .write.mode("overwrite")
        .option("truncate", truncate)
        .option("batchsize", batch)
        .jdbc(url, table, properties=properties)
    )


def refresh_table(df: DataFrame, path: str) -> None:
    """Full refresh of a Parquet table, cleaned as for a SQL store."""
    write_table(clean_text_columns(df), path, "overwrite")


def append_to_sql(df: DataFrame, url: str, table: str, **properties: str) -> None:
    clean_text_columns(df).write.mode("append").jdbc(url, table, properties=properties)


def export_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a header and a fixed column order."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_parted(
    df: DataFrame,
    columns: list[str],
    path: str,
    fmt: str = "json",
    mode: str = "append",
    rows_per_file: int = 1_000_000,
    dealt: bool = False,
    **options: str,
) -> None:
    """Write a folder per value of ``columns``, in as many files as its rows ask for.

    The input is worked out once. Rows are dealt by folder and adaptive execution splits
    folders with many rows over many tasks and puts small ones together. ``dealt`` says that each
    task has the rows of few folders already: they are written as they come. ``options`` are the
    writer's.
    """
    rows = df if dealt else df.hint("rebalance", *[F.col(name) for name in columns])
    writer = rows.write.mode(mode).partitionBy(*columns).options(**options)
    writer.option("maxRecordsPerFile", rows_per_file).format(fmt).save(path)


def write_hourly(
    df: DataFrame, ts: Column | str, path: str, fmt: str = "json", rows_per_file: int = 1_000_000
) -> None:
    """Raw capture by date and hour."""
    at = F.col(ts) if isinstance(ts, str) else ts
    dated = df.withColumn("date", F.to_date(at)).withColumn("hour", F.hour(at))
    write_parted(dated, ["date", "hour"], path, fmt, rows_per_file=rows_per_file)


def rewrite_table(
    spark: SparkSession,
    path: str,
    change: Callable[[DataFrame], DataFrame],
    partition_by: list[str] | None = None,
) -> DataFrame:
    """Replace a table by a changed copy: written beside it, then swapped by rename.

    The old files go only after the new ones are in place. Renames are atomic on HDFS but
    not on object stores, where a table format should be used instead.
    """
    tag = uuid.uuid4().hex
    beside, before = f"{path}__new_{tag}", f"{path}__old_{tag}"
    write_table(change(spark.read.parquet(path)), beside, "error", partition_by)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    here = hadoop(path)
    files = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.rename(here, hadoop(before)):
        raise OSError(f"cannot move {path} aside")
    if not files.rename(hadoop(beside), here):
        files.rename(hadoop(before), here)
        raise OSError(f"cannot put the new version of {path} in place")
    files.delete(hadoop(before), True)
    return spark.read.parquet(path)
