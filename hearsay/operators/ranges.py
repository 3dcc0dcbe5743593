"""Queries over long ranges of a series table, from its sums per month and day.

They give what the operators of the same names in ``series`` and ``trends`` give over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hearsay.functions.times import epoch_seconds
from hearsay.operators.ranks import rank_key, top_k
from hearsay.operators.trends import slope_of_sums
from hearsay.sources.levels import Levels


def _word_sums() -> dict[str, Column]:
    x = epoch_seconds("time_range").cast("decimal(10,0)")
    y = F.col("word_count").cast("decimal(14,0)")
    return {
        "points": F.lit(1).cast("bigint"), "uses": F.col("word_count"),
        "score": F.col("avg_vader_sentiment_score") * F.col("word_count"),
        "x": x, "y": y, "xy": x * y, "xx": x * x,
    }


def _link_sums() -> dict[str, Column]:
    return {"links": F.col("link_count")}


def word_levels(spark: SparkSession, path: str, schema: StructType) -> Levels:
    """Levels of a table of ``series.word_series``."""
    return Levels(spark, path, schema, "word", "time_range", _word_sums)


def link_levels(spark: SparkSession, path: str, schema: StructType) -> Levels:
    """Levels of a table of ``series.crosslink_series``."""
    return Levels(spark, path, schema, "topic_name", "time_bucket", _link_sums)


def popular_words(words: Levels, n: int, low=None, high=None) -> DataFrame:
    """The n most used words in a range with their series. Words are ranked by sums; of the
    rows of the series only those of the n words are dealt."""
    totals = words.totals(low, high).where("word is not null")
    top = top_k(totals.select("word", F.col("uses").alias("total_count")), "total_count", n, "word")
    points = words.rows(low, high).join(top, "word")
    return points.groupBy("word", "total_count", "time_range").agg(
        F.sum("word_count").alias("popularity")
    )


def declining_words(words: Levels, n: int, low=None, high=None) -> DataFrame:
    """The n words whose counts fall fastest over a range, with their series. The slope
    comes from merged sums and is exact."""
    slope = slope_of_sums(*[F.col(name) for name in ("points", "x", "y", "xy", "xx")])
    slopes = words.totals(low, high).where("word is not null").select("word", slope.alias("slope"))
    steepest = top_k(slopes, "slope", n, "word", descending=False)
    points = words.rows(low, high).join(steepest, "word")
    return points.groupBy("word", "slope", "time_range").agg(
        F.sum("word_count").alias("word_count")
    )


def moods(words: Levels, n: int, least: int = 1, low=None, high=None) -> DataFrame:
    """The n words of the best average score over their uses in a range, of those used ``least``
    times or more."""
    used = words.totals(low, high).where(F.col("word").isNotNull() & (F.col("uses") >= least))
    means = used.select(
        "word", F.col("uses").alias("word_count"), (F.col("score") / F.col("uses")).alias("sentiment_score")
    )
    return top_k(means, rank_key("sentiment_score"), n, "word")


def cross_topics(links: Levels, n: int, low=None, high=None) -> DataFrame:
    """The n topics with most links in a range."""
    return top_k(links.totals(low, high), "links", n, "topic_name")
