"""Key stores, run numbers and counts taken while writing."""

import os
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from hearsay.operators.keys import latest_per_key
from hearsay.sources import ledger
from hearsay.sources.counted import counted, write_counted, write_parsed
from hearsay.sources.keystore import PART, KeyedTable, ProcessedKeys
from hearsay.sources.readers import stream_events
from hearsay.streaming import jobs
from hearsay.streaming.progress import LedgerListener, observed


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id STRING")


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("width", ["2", "4", "50"])
def test_processed_keys_are_not_shuffled(spark, tmp_path, no_broadcast, width):
    """Whatever the shuffle width, only the wanted keys move: to the buckets of the table."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        store = ProcessedKeys(spark, str(tmp_path / "done"), "id", "string", 8)
        store.add(ids(spark, ["a", "b", "b", None, "c"]))
        wanted = store.pending(ids(spark, ["a", "d", "d", None, "e"] * 50))
        assert sorted(r["id"] for r in wanted.collect()) == ["d", "e"]
        plan = wanted._jdf.queryExecution().executedPlan().toString()
        right = plan[plan.index("processed_"):]
        assert "Bucketed: true" in right and "SelectedBucketsCount: 8 out of 8" in right
        side = plan[plan.index("LeftOuter"):].split("FileScan parquet")[0].rsplit("Sort [id", 1)[1]
        assert "Exchange" not in side
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_keys_are_added_once(spark, tmp_path):
    path = str(tmp_path / "done")
    store = ProcessedKeys(spark, path, "id", "string", 4)
    results = spark.createDataFrame(
        [("a", 200), ("b", 400), ("c", 404), ("d", 503), ("a", 200), (None, 200)], "id STRING, status INT")
    for _ in range(3):
        store.mark(results)
    assert sorted(r["id"] for r in store.table().collect()) == ["a", "b", "c"]
    files = {f for f in os.listdir(path) if f.endswith(".parquet")}
    store.mark(results)
    assert {f for f in os.listdir(path) if f.endswith(".parquet")} == files
    # Another session finds the keys at the path.
    spark.sql(f"DROP TABLE {store.name}")
    assert store.table().count() == 3
    assert [r["id"] for r in store.pending(results).collect()] == ["d"]


def files_of(path):
    return {f"{folder}/{f}": os.stat(f"{folder}/{f}").st_mtime_ns
            for folder, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_only_touched_partitions_are_written(spark, tmp_path):
    path = str(tmp_path / "table")
    kept = KeyedTable(spark, path, ("k",), 16)
    base = spark.range(400).select(F.col("id").alias("k"), F.lit(1).alias("at"), F.lit("old").alias("v"))
    kept.create(base)
    assert rows(kept.read()) == rows(base) and kept.read().columns == ["k", "at", "v"]
    before = files_of(path)
    new = spark.createDataFrame([(3, 2, "new"), (3, 5, "newer"), (7, 0, "late"), (1000, 1, "more")],
                                "k BIGINT, at INT, v STRING")
    want = latest_per_key(base.unionByName(new), "k", "at", ["v"])
    for _ in range(2):
        parts = kept.upsert(new, "at", ["v"])
        assert 1 <= len(parts) <= 3
        after = files_of(path)
        untouched = {f: t for f, t in before.items()
                     if int(f.split(f"{PART}=")[1].split("/")[0]) not in parts}
        assert len(untouched) >= 13 and untouched.items() <= after.items()
        assert not (before.keys() - untouched.keys()) & after.keys()
        assert rows(kept.read()) == rows(want)
    assert kept.upsert(new.limit(0), "at") == [] and rows(kept.read()) == rows(want)


def test_patches_touch_their_partitions(spark, tmp_path):
    path = str(tmp_path / "table")
    kept = KeyedTable(spark, path, ("k", "j"), 8)
    kept.create(spark.createDataFrame([(i, "x", i, "a") for i in range(50)], "k INT, j STRING, n INT, v STRING"))
    before = files_of(path)
    updates = spark.createDataFrame([(3, "x", None, "b"), (99, "x", 1, "c")], "k INT, j STRING, n INT, v STRING")
    parts = kept.patch(updates, ["n", "v"])
    assert len(parts) <= 2
    assert rows(kept.read()) == sorted((i, "x", i, "b" if i == 3 else "a") for i in range(50))
    after = files_of(path)
    same = [f for f in before if int(f.split(f"{PART}=")[1].split("/")[0]) not in parts]
    assert len(same) >= 6 and all(after[f] == before[f] for f in same)


def test_runs_started_together_get_their_own_numbers(spark, tmp_path):
    path = str(tmp_path / "ledger")
    with ThreadPoolExecutor(6) as pool:
        numbers = list(pool.map(lambda i: ledger.start_run(spark, path, f"job {i}"), range(6)))
    assert sorted(numbers) == [1, 2, 3, 4, 5, 6]
    assert ledger.start_run(spark, path, "later") == 7
    totals = ledger.run_totals(ledger.read_ledger(spark, path)).collect()
    assert len(totals) == 7 and {r["records_scanned"] for r in totals} == {0}


def test_a_number_that_is_taken_is_not_claimed(spark, tmp_path, monkeypatch):
    """Two jobs that saw the same last number: the second one takes the next."""
    path = str(tmp_path / "ledger")
    assert ledger.start_run(spark, path, "a") == 1
    monkeypatch.setattr(ledger, "_claimed", lambda *_: 0)
    assert ledger.start_run(spark, path, "b") == 2


def test_ledgers_without_claims_go_on(spark, tmp_path):
    path = str(tmp_path / "ledger")
    ledger._append(spark, path, 4, "old", 10)
    assert [ledger.start_run(spark, path, "new") for _ in range(2)] == [5, 6]


def test_counts_come_with_the_write(spark, tmp_path):
    jobs_before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    path = str(tmp_path / "t")
    assert write_counted(spark.range(1000), path) == {"scanned": 1000}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == jobs_before + 1
    odd = F.count_if(F.col("id") % 2 == 1)
    assert write_counted(spark.range(5), path, "overwrite", odd=odd, most=F.max("id")) == {"odd": 2, "most": 4}
    assert write_counted(spark.range(0), path, "overwrite") == {"scanned": 0}
    frame, seen = counted(spark.range(7).repartition(3))
    assert frame.count() == 7 and seen.get == {"scanned": 7}


def test_nothing_is_counted_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "value string")
    assert write_counted(none, str(tmp_path / "a")) == {"scanned": 0}
    assert write_parsed(none, "id bigint", str(tmp_path / "b")) == {"good": 0, "bad": 0, "scanned": 0}


def test_lines_that_do_not_parse_are_counted(spark, tmp_path):
    lines = spark.createDataFrame([('{"a": 1}',), ('{"a": ',), ("",), (None,), ('{"a": "x"}',)], "value STRING")
    path = str(tmp_path / "t")
    counts = write_parsed(lines, "a INT", path)
    assert counts["scanned"] == 5 and counts["good"] + counts["bad"] == 5
    assert spark.read.parquet(path).count() == counts["good"]
    assert write_parsed(lines.limit(0), "a INT", path) == {"good": 0, "bad": 0, "scanned": 0}


def test_a_stream_enters_its_counts(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "ledger")
    for start in (0, 10):
        spark.range(start, start + 10).coalesce(1).write.mode("append").json(folder)
    run = ledger.start_run(spark, path, folder)
    listener = LedgerListener(spark, path, run, folder)
    spark.streams.addListener(listener)
    try:
        stream = observed(stream_events(spark, folder, "id BIGINT", 1)).where("id % 5 = 0")
        query = jobs.keep_facts(stream, str(tmp_path / "out"), str(tmp_path / "check"))
        query.awaitTermination()
        for _ in range(100):
            if len(listener.entered) == 2:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    time.sleep(1)
    entries = ledger.read_ledger(spark, path).where("records_scanned > 0").collect()
    assert [r["records_scanned"] for r in entries] == [10, 10]
    assert ledger.latest_run(ledger.read_ledger(spark, path)).first()["records_scanned"] == 20
