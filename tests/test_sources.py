"""Readers, sinks and the ledger."""

import pytest
from pyspark.sql import functions as F

from hearsay import schemas
from hearsay.functions.vocab import POST_COLLECTION
from hearsay.operators.filters import conform
from hearsay.session import checkpoint_root, shared_path
from hearsay.sources import ledger, readers, sinks


def write_lines(tmp_path, *lines):
    path = tmp_path / "lines.jsonl"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_corrupt_lines_are_kept_apart(spark, tmp_path):
    path = write_lines(tmp_path, '{"id": "a", "score": 1}', '{"id": "b", "sco', "", '{"id": "c", "score": "x"}')
    events = readers.read_events(spark, path, "id STRING, score BIGINT", keep_corrupt=True).cache()
    good, bad = readers.split_corrupt(events)
    assert [r["id"] for r in good.collect()] == ["a"]
    assert sorted(r[0] for r in bad.collect()) == ['{"id": "b", "sco', '{"id": "c", "score": "x"}']
    parsed = readers.parse_lines(spark.read.text(path), "id STRING, score BIGINT").cache()
    assert readers.split_corrupt(parsed)[0].filter("id IS NOT NULL").count() == 1


def test_keys_that_differ_by_case(spark, tmp_path):
    path = write_lines(tmp_path, '{"did": "x", "commit": {"collection": "c", "record": {"langs": ["en"], "embed": {"$type": "t"}}}, "DID": "y"}')
    row = readers.read_events(spark, path, schemas.FEED_EVENT).first()
    assert row["did"] == "x" and row["commit"]["record"]["embed"]["$type"] == "t"
    assert set(readers.read_events(spark, path).columns) >= {"did", "DID"}


def test_all_schemas_parse(spark, tmp_path):
    path = write_lines(tmp_path, "{}")
    for name in ("FEED_EVENT", "HYDRATED_POST", "POST_THREAD", "FORUM_POST", "FORUM_COMMENT", "WORD_SERIES",
                 "INGESTION_METRICS", "CONTROVERSY_SERIES", "CROSSLINK_SERIES", "RUN_LEDGER"):
        assert readers.read_events(spark, path, getattr(schemas, name)).count() == 1


def test_topic_values_round_trip(spark):
    frame = spark.createDataFrame([(1, "a\"b", ["en"]), (2, None, [])], "id BIGINT, text STRING, langs ARRAY<STRING>")
    sent = sinks.to_topic_value(frame, key="id")
    assert sent.columns == ["key", "value"]
    got = readers.decode_topic_json(sent, {"id": ("$.id", "bigint"), "text": ("$.text", "string"), "langs": ("$.langs", "string")})
    assert sorted(map(tuple, got.collect())) == [(1, 'a"b', '["en"]'), (2, None, "[]")]


def test_compacted_posts(spark, tmp_path):
    frame = spark.range(30).select("id", F.struct(
        F.when(F.col("id") < 20, POST_COLLECTION).otherwise("x").alias("collection"),
        F.when(F.col("id") < 15, "create").otherwise("delete").alias("operation")).alias("commit"))
    path = str(tmp_path / "compact")
    sinks.compact_posts(frame.coalesce(1), path, rows_per_file=5)
    out = spark.read.parquet(path)
    assert out.count() == 15 and len(out.inputFiles()) == 3


def test_rewrite_keeps_the_table_when_the_change_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_table(spark.range(10), path, "overwrite")
    with pytest.raises(Exception):
        sinks.rewrite_table(spark, path, lambda df: df.select(F.raise_error(F.lit("no")).alias("id")))
    assert spark.read.parquet(path).count() == 10
    assert sinks.rewrite_table(spark, path, lambda df: df.filter("id > 3")).count() == 6


def test_write_modes(spark, tmp_path):
    path = str(tmp_path / "m")
    sinks.write_table(spark.range(2), path, "error")
    with pytest.raises(Exception):
        sinks.write_table(spark.range(2), path, "error")
    sinks.write_table(spark.range(2), path, "ignore")
    sinks.write_table(spark.range(2), path, "append")
    assert spark.read.parquet(path).count() == 4


def test_csv_has_a_header_and_the_asked_order(spark, tmp_path):
    path = tmp_path / "csv"
    frame = spark.createDataFrame([(1, "a")], "n INT, w STRING").coalesce(1)
    sinks.export_csv(frame, str(path), ["w", "n"])
    (part,) = path.glob("part-*.csv")
    assert part.read_text() == "w,n\na,1\n"


def test_hourly_files(spark, tmp_path):
    """A hot hour of copies is cut into several files, quiet hours have one."""
    quiet = spark.range(30).select(F.timestamp_seconds(F.lit(1_735_689_600) + F.col("id") * 360).alias("at"))
    hot = spark.range(500).select(F.timestamp_seconds(F.lit(1_735_689_600)).alias("at"))
    path = str(tmp_path / "hourly")
    undated = spark.range(2).select(F.lit(None).cast("timestamp").alias("at"))
    sinks.write_hourly(quiet.union(hot).union(undated).repartition(24), "at", path, rows_per_file=100)
    out = spark.read.json(path)
    assert out.filter("hour IS NULL").count() == 2
    out = out.filter("hour IS NOT NULL")
    assert out.count() == 530 and out.select("date", "hour").distinct().count() == 3
    files = out.groupBy("hour", F.input_file_name().alias("file")).count().collect()
    per_hour = {hour: [f["count"] for f in files if f["hour"] == hour] for hour in (0, 1, 2)}
    assert len(per_hour[0]) >= 5 and max(per_hour[0]) <= 100
    assert len(per_hour[1]) == len(per_hour[2]) == 1


def test_nul_characters_leave_text_columns_only(spark):
    frame = spark.createDataFrame([("a\u0000b", 1)], "t STRING, n INT")
    assert sinks.clean_text_columns(frame).first() == ("ab", 1)


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert ledger.start_run(spark, path, "one") == 1
    ledger.add_scanned(spark, path, 1, "one", 40)
    ledger.add_scanned(spark, path, 1, "one", 2)
    assert ledger.start_run(spark, path, "two") == 2
    totals = {r["run_id"]: r["records_scanned"] for r in ledger.run_totals(ledger.read_ledger(spark, path)).collect()}
    assert totals == {1: 42, 2: 0}
    assert ledger.latest_run(ledger.read_ledger(spark, path)).first()["source_path"] == "two"


def test_conform_orders_and_casts(spark):
    frame = spark.createDataFrame([("1", 2.5, "x")], "b STRING, a DOUBLE, c STRING")
    assert conform(frame, "a INT, b BIGINT").dtypes == [("a", "int"), ("b", "bigint")]


def test_views_and_sql(spark):
    frame = spark.range(5).select(F.struct("id").alias("r"))
    assert readers.query_view(frame, "nested_rows", "SELECT r.id FROM nested_rows WHERE r.id > 2").count() == 2


def test_shared_paths_lie_in_the_checkpoint_folder(spark):
    assert checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert shared_path(spark, "x").startswith(checkpoint_root(spark))
    assert shared_path(spark, "x") != shared_path(spark, "x")


def test_series_jobs_push_their_filters(spark, tmp_path):
    from hearsay import jobs

    feed = write_lines(tmp_path, *[
        f'{{"did": "d{i}", "time_us": {1_735_689_600_000_000 + i}, "commit": {{"collection": "{POST_COLLECTION if i % 2 else "x"}", '
        f'"operation": "create", "rkey": "{i}", "record": {{"text": "sky is {word}", "langs": {langs}}}}}}}'
        for i, (word, langs) in enumerate([("good", '["en"]'), ("bad", '["en"]'), ("rot", '["de"]'), ("wide", '["en","de"]'), ("x", "null")])
    ])
    flat = str(tmp_path / "flat")
    jobs.flat_feed(readers.read_events(spark, feed, schemas.FEED_EVENT)).write.parquet(flat)
    fetched = spark.createDataFrame([], schemas.HYDRATED_POST)
    tables = jobs.series_tables(spark.read.parquet(flat), jobs.flat_fetched(fetched), "example.com")
    words = tables["word_time_series"]
    assert sorted(map(tuple, words.select("word", "avg_vader_sentiment_score").collect())) == [("bad", -0.5), ("sky", -0.5)]
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(sole_lang,en)" in plan and f"EqualTo(collection,{POST_COLLECTION})" in plan
    assert "root_id" not in plan
    assert tables["ingestion_metrics_timeline"].first()["record_count"] == 5


def test_feeds_by_day_are_not_dealt_again(spark, tmp_path):
    """A feed in day folders is written as it is read, one file for each of its files; any other is dealt."""
    from hearsay import jobs

    lines = [
        f'{{"did": "d{i}", "time_us": {1_735_689_600_000_000 + i}, "commit": {{"collection": "{POST_COLLECTION}", '
        f'"operation": "create", "rkey": "{i}", "record": {{"text": "sky is good", "langs": ["en"]}}}}}}' for i in range(4)]
    for i, line in enumerate(lines):
        for folder in (tmp_path / "loose", tmp_path / "dated" / "day=2025-01-01"):
            folder.mkdir(parents=True, exist_ok=True)
            (folder / f"{i}.json").write_text(line + "\n")
    fetched = write_lines(tmp_path, (
        '{"uri": "u", "record": {"text": "x", "langs": ["en"], "createdAt": "2025-01-01T00:00:00Z"}, "likeCount": 1, '
        '"replyCount": 1, "indexedAt": "2025-01-01T00:00:00Z"}'))
    files, found = {}, {}
    for name in ("loose", "dated"):
        out = tmp_path / f"out-{name}"
        paths = jobs.build_series_tables(spark, str(tmp_path / name), fetched, str(out), "example.com")
        files[name] = [f.name for f in out.glob("flat/feed/day=2025-01-01/*.parquet")]
        found[name] = sorted(map(tuple, spark.read.parquet(paths[0]).select("word", "word_count").collect()))
    assert found["loose"] == found["dated"] == [("good", 4), ("sky", 4)]
    assert len(files["dated"]) > len(files["loose"]) == 1
    assert all(f.endswith(".zstd.parquet") for names in files.values() for f in names)
