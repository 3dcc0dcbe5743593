"""Run ledger: an append-only table of runs and of the records they scanned."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.schemas import RUN_LEDGER

# Folder of the claimed numbers; readers of the ledger skip names that begin so.
CLAIMS = "_claims"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(RUN_LEDGER).option("recursiveFileLookup", True).parquet(path)
    except Exception as problem:  # no ledger yet
        if "PATH_NOT_FOUND" in str(problem):
            return spark.createDataFrame([], RUN_LEDGER)
        raise


def _append(spark: SparkSession, path: str, run_id: int, source: str, scanned: int) -> None:
    row = spark.range(1).select(
        F.lit(run_id).cast("bigint").alias("run_id"),
        F.current_timestamp().alias("run_ts"),
        F.lit(source).alias("source_path"),
        F.lit(scanned).cast("bigint").alias("records_scanned"),
    )
    # A folder for each entry: jobs that append to one folder remove each other's temporary files.
    row.coalesce(1).write.parquet(f"{path}/run-{run_id}/{uuid.uuid4().hex}")


def _claimed(spark: SparkSession, folder: str) -> int:
    """The highest number claimed so far, 0 if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)
    names = [status.getPath().getName() for status in files.listStatus(place)]
    return max((int(name) for name in names if name.isdigit()), default=0)


def _claim(spark: SparkSession, folder: str, number: int) -> bool:
    """Make the file of a number, unless it is there: of several jobs one succeeds. HDFS makes files
    so; for a local folder Hadoop does not, so Java's own call is used."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{folder}/{number}")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        if files.getScheme() == "file":
            none = spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0)
            path = jvm.java.nio.file.Path.of(files.makeQualified(place).toUri())
            jvm.java.nio.file.Files.createFile(path, none)
        else:
            files.create(place, False).close()
    except Py4JJavaError as problem:
        if "AlreadyExists" in problem.java_exception.getClass().getName():
            return False
        raise
    return True


def start_run(spark: SparkSession, path: str, source: str) -> int:
    """Open the next run and return its number.

    A number is claimed by a file of its own in the ledger's folder, so that jobs that start
    together get different ones.
    """
    folder = f"{path}/{CLAIMS}"
    last = _claimed(spark, folder)
    if not last:  # a ledger without claims, or none yet
        last = read_ledger(spark, path).agg(F.max("run_id")).first()[0] or 0
    run_id = last + 1
    while not _claim(spark, folder, run_id):
        run_id += 1
    _append(spark, path, run_id, source, 0)
    return run_id


def add_scanned(spark: SparkSession, path: str, run_id: int, source: str, scanned: int) -> None:
    """Add to a run's record count."""
    _append(spark, path, run_id, source, scanned)


def run_totals(ledger: DataFrame) -> DataFrame:
    """One row per run: when it started, its source and all records scanned."""
    return ledger.groupBy("run_id").agg(
        F.min("run_ts").alias("run_ts"),
        F.min_by("source_path", "run_ts").alias("source_path"),
        F.sum("records_scanned").alias("records_scanned"),
    )


def latest_run(ledger: DataFrame) -> DataFrame:
    return run_totals(ledger).orderBy(F.desc("run_id")).limit(1)
