"""Trends of words over time: daily popularity, declining words, dying trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearsay.functions.times import epoch_seconds
from hearsay.operators.filters import between_ts
from hearsay.operators.grids import dense_series, top_series
from hearsay.operators.ranks import top_k
from hearsay.operators.words import word_counts, word_day_counts


def exact_slope(x: Column, y: Column) -> Column:
    """Least-squares slope of whole numbers, null for fewer than two distinct x.

    Sums are kept as decimals: the result does not depend on the order in which partial
    sums meet, so words with equal series get equal slopes and rank by name.
    """
    x, y = x.cast("decimal(10,0)"), y.cast("decimal(14,0)")
    return slope_of_sums(F.count(F.lit(1)), F.sum(x), F.sum(y), F.sum(x * y), F.sum(x * x))


def slope_of_sums(n: Column, sum_x: Column, sum_y: Column, sum_xy: Column, sum_xx: Column) -> Column:
    """The slope of ``exact_slope`` from the number of points and their sums."""
    n = n.cast("decimal(10,0)")
    above = n * sum_xy - sum_x * sum_y
    below = n * sum_xx - sum_x * sum_x
    return F.when(below != 0, above.cast("double") / below.cast("double"))


def frequent_words(scored: DataFrame, k: int) -> DataFrame:
    """The k words that stand in most posts."""
    return top_k(word_counts(scored, F.array_distinct("tokens"), "mentions"), "mentions", k, "word")


def daily_grid(scored: DataFrame, k: int, day: str) -> DataFrame:
    """Daily counts of the k most frequent words, dense over the days that have a post."""
    return dense_top(word_day_counts(scored, day), scored.select(F.col(day).alias("bucket")), k)


def dense_top(points: DataFrame, days: DataFrame, k: int) -> DataFrame:
    top = top_series(points, "word", "bucket", ["count"], k, "count")
    return dense_series(top, days, "word", "bucket", ["count"])


def word_timeline(
    scored: DataFrame, word: str | None = None, k: int = 5, day: str = "created_date"
) -> DataFrame:
    """Posts per day for the k most frequent words, or for one word, with the day's total."""
    if word:
        day_counts = scored.groupBy(F.col(day).alias("bucket")).agg(
            F.count_if(F.array_contains("tokens", word.strip().lower())).alias("count")
        )
        series = day_counts.select(F.lit(word.strip().lower()).alias("word"), "bucket", "count")
    else:
        series = daily_grid(scored, k, day)
    return with_total(series)


def with_total(series: DataFrame) -> DataFrame:
    """Adds the sum over the few words of each day."""
    total = F.sum("count").over(Window.partitionBy("bucket"))
    return series.withColumn("total", total)


def trend_figures(scored: DataFrame, pool: int = 25, day: str = "created_date") -> DataFrame:
    """Shape of the daily series of the most frequent words, and the series itself.

    A series has one point per day that has any post, numbered from 0. Windows are per
    word and there are at most ``pool`` of those.
    """
    return figures(daily_grid(scored, pool, day))


def figures(grid: DataFrame) -> DataFrame:
    """The shape of each word's series in a dense grid."""
    by_word = Window.partitionBy("word")
    placed = (
        grid.withColumn("i", F.row_number().over(by_word.orderBy("bucket")) - 1)
        .withColumn("n", F.count(F.lit(1)).over(by_word))
        .withColumn("half", F.greatest(F.lit(1), F.floor(F.col("n") / 2)))
    )
    value, place = F.col("count"), F.col("i")
    first_half = place < F.col("half")
    return placed.groupBy(F.col("word").alias("topic"), "n", "half").agg(
        F.coalesce(exact_slope(place, value), F.lit(0.0)).alias("slope"),
        F.max("count").alias("peak"),
        F.max_by("count", "i").alias("latest"),
        F.min_by("i", F.struct(-value, place)).alias("peak_at"),
        (F.sum(F.when(place >= F.col("n") - 2, value)) / 2.0).alias("recent"),
        (F.sum(F.when(first_half, value)) / F.first("half")).alias("early"),
        (
            F.sum(F.when(~first_half, value))
            / F.greatest(F.first("n") - F.first("half"), F.lit(1))
        ).alias("late"),
        F.collect_list(F.struct("bucket", "count")).alias("series"),
    )


def dying(found: DataFrame, k: int) -> DataFrame:
    """Of the ``figures``, the k steepest that are past their peak."""
    past = (
        (F.col("n") >= 3)
        & (F.col("peak") >= 3)
        & (F.col("peak_at") <= F.col("n") - 3)
        & (F.col("recent") <= F.col("peak") * 0.55)
        & (F.col("slope") < -0.02)
        & (F.col("late") < F.col("early") * 0.85)
    )
    ratio = F.when(F.col("peak") > 0, F.col("latest") / F.col("peak")).otherwise(0.0)
    return (
        found.filter(past)
        .withColumn("saturation_ratio", ratio)
        .orderBy("slope", "saturation_ratio", "topic")
        .limit(k)
    )


def summary(trends: DataFrame) -> DataFrame:
    return trends.select(
        "topic", "slope", "latest", "peak", "saturation_ratio", F.lit("dying").alias("status")
    )


def timeline(trends: DataFrame) -> DataFrame:
    """The series that the figures carry, with the day's total."""
    return with_total(trends.select(F.col("topic").alias("word"), F.inline("series")))


def dying_trends(
    scored: DataFrame, pool: int = 25, k: int = 8, day: str = "created_date"
) -> DataFrame:
    """Frequent words past their peak, steepest decline first."""
    return summary(dying(trend_figures(scored, pool, day), k))


def saturation_timeline(
    scored: DataFrame, words: int = 3, pool: int = 25, day: str = "created_date"
) -> DataFrame:
    """Daily series of the first few dying trends with the day's total."""
    return timeline(dying(trend_figures(scored, pool, day), words))


def declining_words(series: DataFrame, n: int, low=None, high=None) -> DataFrame:
    """The n words whose counts fall fastest over time, with their series.

    Words with one point have no slope and come last.
    """
    in_range = between_ts(series.filter(F.col("word").isNotNull()), "time_range", low, high)
    slopes = in_range.groupBy("word").agg(
        exact_slope(epoch_seconds("time_range"), F.col("word_count")).alias("slope")
    )
    steepest = top_k(slopes, "slope", n, "word", descending=False)
    points = in_range.join(steepest, "word")
    return points.groupBy("word", "slope", "time_range").agg(
        F.sum("word_count").alias("word_count")
    )
