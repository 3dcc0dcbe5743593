"""Batch jobs from raw feeds to the four series tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.functions.times import iso_utc, micros_ts
from hearsay.functions.values import post_uri, root_author
from hearsay.operators.filters import created_posts
from hearsay.operators.series import (
    controversy_series, crosslink_series, ingestion_metrics, labelled, word_series,
)
from hearsay.operators.words import with_wordlist_score
from hearsay.schemas import FEED_EVENT, HYDRATED_POST
from hearsay.sources.readers import read_events, read_table
from hearsay.sources.sinks import write_parted, write_table

Scorer = Callable[[DataFrame], DataFrame]


def flat_feed(events: DataFrame) -> DataFrame:
    """Feed events as flat rows.

    ``sole_lang`` is the language of single-language records: unlike a test on the list
    it is a plain column, so a Parquet scan can skip row groups by it.
    """
    record = F.col("commit.record")
    return events.select(
        post_uri("did", "commit.collection", "commit.rkey").alias("uri"),
        "did",
        micros_ts("time_us").alias("ts"),
        F.col("commit.collection").alias("collection"),
        F.col("commit.operation").alias("operation"),
        record["text"].alias("text"),
        record["langs"].alias("langs"),
        _sole(record["langs"]).alias("sole_lang"),
        root_author("commit.record.reply.root.uri").alias("root_id"),
    )


def flat_fetched(posts: DataFrame) -> DataFrame:
    """Fetched posts as flat rows; ``created`` and ``indexed`` are null when unreadable."""
    record = F.col("record")
    return posts.select(
        "uri",
        record["text"].alias("text"),
        record["langs"].alias("langs"),
        _sole(record["langs"]).alias("sole_lang"),
        F.col("likeCount").alias("like_count"),
        F.col("replyCount").alias("reply_count"),
        iso_utc(record["createdAt"]).alias("created"),
        iso_utc("indexedAt").alias("indexed"),
    )


def _sole(langs: Column) -> Column:
    return F.when(F.size(langs) == 1, F.get(langs, 0))


def series_tables(
    feed: DataFrame,
    fetched: DataFrame,
    needle: str,
    score: Scorer = partial(with_wordlist_score, text="text"),
    lang: str = "en",
    width: str = "10 minutes",
) -> dict[str, DataFrame]:
    """The four tables from ``flat_feed`` and ``flat_fetched`` rows.

    ``score`` adds a column ``score`` to posts: word lists, a valence lexicon or a model.
    """
    posts = created_posts(feed, "collection", "operation")
    return {
        "word_time_series": word_series(
            score(posts.filter(F.col("sole_lang") == lang)), width=width
        ),
        "ingestion_metrics_timeline": ingestion_metrics(
            labelled(feed, "ts", "firehose"),
            labelled(fetched, "created", "getPosts_endpoint"),
            width=width,
        ),
        "controversial_topics_timeline": controversy_series(
            fetched.filter(F.col("sole_lang") == lang), ts="indexed", width=width
        ),
        "crosslink_stats": crosslink_series(fetched, needle, ts="created", width=width),
    }


def build_series_tables(
    spark: SparkSession, feed_path: str, fetched_path: str, out: str, needle: str, **options
) -> list[str]:
    """Read the JSON feeds, write the tables as Parquet below ``out`` and return their paths.

    The feeds are parsed once, into flat Parquet tables by day below ``out/flat``; the series
    read from those the columns and row groups they need. A feed that lies in folders by day is
    written as it is read; the rows of any other are dealt by day first.
    """
    feed = read_events(spark, feed_path, FEED_EVENT)
    fetched = read_events(spark, fetched_path, HYDRATED_POST)
    raw = {
        "feed": (flat_feed(feed), "ts", "day" in feed.columns),
        "fetched": (flat_fetched(fetched), "indexed", "day" in fetched.columns),
    }
    flat = {}
    for name, (rows, ts, by_day) in raw.items():
        path = f"{out}/flat/{name}"
        write_parted(rows.withColumn("day", F.to_date(ts)), ["day"], path, "parquet", "overwrite",
                     dealt=by_day, compression="zstd")
        flat[name] = read_table(spark, path)
    tables = series_tables(flat["feed"], flat["fetched"], needle, **options)
    for name, table in tables.items():
        write_table(table, f"{out}/{name}", "overwrite")
    return [f"{out}/{name}" for name in tables]
