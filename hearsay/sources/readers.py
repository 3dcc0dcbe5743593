"""Sources, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.functions.values import json_field

CORRUPT = "_corrupt_record"


def read_events(
    spark: SparkSession, path: str, schema: str | None = None, keep_corrupt: bool = False
) -> DataFrame:
    """JSON lines. Give a schema where it is known: inference reads all input once more.

    ``keep_corrupt`` adds lines that do not parse as ``_corrupt_record``.
    """
    reader = spark.read
    if schema is not None:
        if keep_corrupt:
            schema = f"{schema}, {CORRUPT} STRING"
        reader = reader.schema(schema)
    return reader.option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed rows and the lines that failed."""
    if CORRUPT not in df.columns:
        return df, df.limit(0)
    good = df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = df.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)
    return good, bad


def parse_lines(lines: DataFrame, schema: str, raw: str = "value") -> DataFrame:
    """JSON text already in a column, parsed; bad lines keep their text as
    ``_corrupt_record``."""
    wide = f"{schema}, {CORRUPT} STRING"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return lines.select(F.from_json(raw, wide, options).alias("row")).select("row.*")


def stream_events(
    spark: SparkSession,
    path: str,
    schema: str | None = None,
    max_files: int | None = None,
    fmt: str = "json",
) -> DataFrame:
    """A folder of files as a stream; without a schema it is inferred once at the start.

    ``max_files`` bounds each micro-batch; source files are left in place.
    """
    reader = spark.readStream.format(fmt).option("cleanSource", "off")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if schema is None:
        spark.conf.set("spark.sql.streaming.schemaInference", "true")
    else:
        reader = reader.schema(schema)
    return reader.load(path)


def stream_topic(
    spark: SparkSession, servers: str, topic: str, starting: str = "latest", **options: str
) -> DataFrame:
    """A Kafka topic as a stream (the Kafka connector must be on the class path)."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
    )
    return reader.options(**options).load()


def decode_topic_json(df: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Columns from the JSON text of a topic's ``value``: name -> (path, type)."""
    raw = F.col("value").cast("string")
    return df.select(
        *[json_field(raw, path, kind).alias(name) for name, (path, kind) in fields.items()]
    )


def read_query(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """The result of a query run by a SQL store; filters belong into the query."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def query_view(df: DataFrame, view: str, query: str) -> DataFrame:
    """SQL over a frame, nested columns included."""
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(query)
