"""Sums of long ranges from months, days and rows."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hearsay.operators import ranges, series, trends
from hearsay.sources.levels import cover

SCHEMA = "word string, time_range timestamp_ntz, avg_vader_sentiment_score double, word_count bigint"
RANGES = [
    (None, None),
    (None, "2024-03-05 12:00:00"),
    ("2024-02-10 07:25:00", None),
    ("2024-01-31 23:50:00", "2024-04-01 00:00:00"),
    ("2024-02-01", "2024-03-31 23:59:59.999999"),
    ("2024-02-10 07:25:00", "2024-02-10 18:00:00"),
    ("2024-02-10 07:25:00", "2024-02-12 18:00:00"),
    ("2024-02-12", "2024-02-11"),
    ("2030-01-01", None),
]


def made(spark, first, days, seed=0):
    dice = random.Random(seed)
    start = datetime.fromisoformat(first)
    found = [
        (word, start + timedelta(days=day, minutes=10 * dice.randrange(144)),
         dice.choice([-0.5, 0.0, 0.25]), dice.randrange(1, 9))
        for day in range(days) for word in ("a", "b", "c", "d", None) if dice.random() < 0.7
    ]
    return spark.createDataFrame(found, SCHEMA)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    table = made(spark, "2024-01-20", 100)
    levels = ranges.word_levels(spark, str(tmp_path_factory.mktemp("levels")), table.schema)
    levels.write(table)
    return levels, table.cache()


@pytest.mark.parametrize("low, high", RANGES)
def test_pieces_make_up_the_range_once(low, high):
    """Every 10 minutes are in one piece if they are in the range, and in none if not."""
    pieces = [piece for level in cover(low, high).values() for piece in level]
    at = datetime(2024, 1, 25)
    ends = [None if x is None else datetime.fromisoformat(x) for x in (low, high)]
    while at < datetime(2024, 4, 5):
        held = sum((a is None or a <= at) and (b is None or at < b) for a, b in pieces)
        wanted = (ends[0] is None or ends[0] <= at) and (ends[1] is None or at <= ends[1])
        assert held == wanted, at
        at += timedelta(minutes=10)


def test_pieces_are_the_coarsest():
    found = cover("2024-02-10 07:25:00", "2024-05-02 10:00:00")
    assert found["months"] == [(datetime(2024, 3, 1), datetime(2024, 5, 1))]
    assert found["days"] == [
        (datetime(2024, 2, 11), datetime(2024, 3, 1)), (datetime(2024, 5, 1), datetime(2024, 5, 2))
    ]
    assert [a.date().isoformat() for a, _ in found["fine"]] == ["2024-02-10", "2024-05-02"]


@pytest.mark.parametrize("low, high", RANGES)
def test_equal_to_the_whole_table(filled, low, high):
    levels, table = filled
    assert rows(ranges.popular_words(levels, 2, low, high)) == rows(
        series.popular_words(table, 2, low, high))
    assert rows(ranges.declining_words(levels, 2, low, high)) == rows(
        trends.declining_words(table, 2, low, high))


def test_moods_weigh_by_uses(filled):
    levels, table = filled
    low, high = "2024-02-10 07:25:00", "2024-04-01 10:00:00"
    kept = table.where(f"word is not null and time_range between '{low}' and '{high}'")
    wanted = kept.groupBy("word").agg(
        F.sum("word_count").alias("n"),
        (F.sum(F.expr("avg_vader_sentiment_score * word_count")) / F.sum("word_count")).alias("m"))
    found = {r["word"]: (r["word_count"], r["sentiment_score"])
             for r in ranges.moods(levels, 9, 1, low, high).collect()}
    assert found == {r["word"]: (r["n"], pytest.approx(r["m"])) for r in wanted.collect()}
    assert ranges.moods(levels, 9, 10**6, low, high).count() == 0


def test_fewer_rows_are_read(filled):
    levels, table = filled
    low, high = "2024-01-25 07:20:00", "2024-04-20 10:00:00"
    parts = levels.parts(low, high)
    assert parts.count() < levels.rows(low, high).count() / 2
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [") == 3 and "PartitionFilters: []" not in plan
    assert table.where("word is null").count() > 0  # summed as a key of their own
    assert levels.totals().where("word is null").count() == 1


def files_of(path):
    return {f"{root}/{name}" for root, _, names in os.walk(path) for name in names
            if name.endswith(".parquet")}


def test_only_the_days_and_months_of_new_rows_are_written(spark, tmp_path):
    old = made(spark, "2024-01-20", 60)
    levels = ranges.word_levels(spark, str(tmp_path), old.schema)
    levels.write(old)
    before = files_of(tmp_path)
    new = made(spark, "2024-03-15", 10, seed=1)
    levels.write(new)
    gone = before - files_of(tmp_path)
    assert gone and not any("=2024-01" in path or "=2024-02" in path for path in gone)
    days = [r[0] for r in new.select(F.to_date("time_range")).distinct().collect()]
    whole = old.where(~F.to_date("time_range").isin(days)).unionByName(new)
    assert rows(ranges.popular_words(levels, 3)) == rows(series.popular_words(whole, 3))
    assert rows(ranges.declining_words(levels, 3)) == rows(trends.declining_words(whole, 3))
    levels.write(new)  # the same days again change nothing
    assert rows(ranges.popular_words(levels, 3)) == rows(series.popular_words(whole, 3))


def test_empty_tables_and_rows_without_a_time(spark, tmp_path):
    none = spark.createDataFrame([("a", None, 0.5, 3)], SCHEMA)
    levels = ranges.word_levels(spark, str(tmp_path), none.schema)
    levels.write(none)
    assert ranges.popular_words(levels, 3).count() == 0
    assert ranges.declining_words(levels, 3, "2024-01-01", "2025-01-01").count() == 0
    assert levels.totals().count() == 0


def test_links(spark, tmp_path):
    links = spark.createDataFrame(
        [("x", datetime(2024, 1, 31, 23, 50), 2), ("y", datetime(2024, 2, 1), 2),
         ("z", datetime(2024, 2, 29, 23, 50), 1), ("y", datetime(2024, 3, 1), 7)],
        "topic_name string, time_bucket timestamp_ntz, link_count bigint")
    levels = ranges.link_levels(spark, str(tmp_path), links.schema)
    levels.write(links)
    found = ranges.cross_topics(levels, 2, "2024-01-31", "2024-02-29 23:59:59")
    assert [tuple(r) for r in found.collect()] == [("x", 2), ("y", 2)]
    assert rows(ranges.cross_topics(levels, 9)) == rows(series.cross_topics(links, 9))
