"""Key figures, daily series and splits over fact rows and feed events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearsay.functions.scores import sign_label
from hearsay.functions.vocab import (
    FOLLOW_COLLECTION, LIKE_COLLECTION, MEDIA_LABELS, POST_COLLECTION,
)
from hearsay.operators.ranks import running_total

IS_COMMENT = "post_type = 'comment'"
IS_POST = "post_type != 'comment'"


def _count_if(condition: str | Column) -> Column:
    return F.count_if(F.expr(condition) if isinstance(condition, str) else condition)


def _or_zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0.0))


def _per_day(total: Column, days: Column) -> Column:
    return F.when(days > 0, total / days).otherwise(F.lit(0.0))


def post_kpis(facts: DataFrame) -> DataFrame:
    """One row: posts, comments, averages, engagement and active days; zeros on no rows."""
    sums = facts.agg(
        _count_if(IS_POST).alias("total_posts"),
        _count_if(IS_COMMENT).alias("total_comments"),
        _or_zero(F.avg("score")).alias("avg_score"),
        _or_zero(F.avg("num_comments")).alias("avg_comments"),
        _or_zero(F.sum("engagement")).alias("total_engagement"),
        F.countDistinct("created_date").alias("active_days"),
    )
    return sums.withColumn(
        "avg_engagement_per_day", _per_day(F.col("total_engagement"), F.col("active_days"))
    )


def daily_posts(facts: DataFrame) -> DataFrame:
    return (
        facts.filter(IS_POST)
        .groupBy(F.col("created_date").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def daily_series(facts: DataFrame) -> DataFrame:
    return facts.groupBy(F.col("created_date").alias("bucket")).agg(
        _count_if(IS_POST).alias("posts"),
        _or_zero(F.sum("ups")).alias("upvotes"),
        _count_if(IS_COMMENT).alias("comments"),
        _or_zero(F.sum("engagement")).alias("total"),
    )


def _split(df: DataFrame, label: Column) -> DataFrame:
    """Rows and percentage per label. The total is taken over the counts (a handful of
    labels, so the window has a handful of rows) and the data is read once."""
    counts = df.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("value"))
    total = F.sum("value").over(Window.partitionBy())
    return counts.withColumn("percent", F.col("value") * 100.0 / total)


def type_split(facts: DataFrame) -> DataFrame:
    return _split(facts, F.lower(F.coalesce("post_type", F.lit("other"))))


def content_split(facts: DataFrame) -> DataFrame:
    """Posts, comments and the percentage of posts."""
    counts = facts.agg(
        _count_if(IS_POST).alias("posts"), _count_if(IS_COMMENT).alias("comments")
    )
    both = F.col("posts") + F.col("comments")
    return counts.withColumn(
        "post_percent", F.when(both > 0, F.col("posts") * 100.0 / both).otherwise(0.0)
    )


def available_years(df: DataFrame, year: Column | str = "year") -> DataFrame:
    column = F.col(year) if isinstance(year, str) else year
    return df.select(column.alias("year")).distinct().orderBy("year")


def comment_kpis(facts: DataFrame) -> DataFrame:
    sums = facts.agg(
        F.count(F.lit(1)).alias("total_comments"),
        _count_if("controversiality > 0").alias("total_controversial_comments"),
        _or_zero(F.avg("ups")).alias("avg_comment_upvotes"),
        _or_zero(F.avg("downs")).alias("avg_comment_downvotes"),
        _or_zero(F.avg("score")).alias("avg_comment_score"),
    )
    return sums.withColumn(
        "controversial_percent",
        _per_day(F.col("total_controversial_comments") * 100.0, F.col("total_comments")),
    )


def daily_comments(facts: DataFrame) -> DataFrame:
    hot = _count_if("controversiality > 0")
    total = F.count(F.lit(1))
    return facts.groupBy(F.col("created_date").alias("bucket")).agg(
        total.alias("total_comments"),
        hot.alias("controversial_comments"),
        (total - hot).alias("normal_comments"),
    )


def score_split(facts: DataFrame) -> DataFrame:
    return _split(facts, sign_label("score"))


def _fixed_labels(df: DataFrame, label: str, labels: list[str]) -> DataFrame:
    """One row per label of a fixed list, in its order, with the count and percentage of
    matching rows; absent labels count 0.

    The counts are columns of one aggregate row that is then turned into rows, so no
    label frame has to be joined.
    """
    counts = df.agg(
        F.count(F.lit(1)).alias("__all"),
        *[
            F.count_if(F.col(label) == name).alias(f"__{place}")
            for place, name in enumerate(labels)
        ],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(place).alias("position"),
                F.lit(name).alias("label"),
                F.col(f"__{place}").alias("value"),
            )
            for place, name in enumerate(labels)
        ]
    )
    percent = F.when(F.col("__all") > 0, F.col("value") * 100.0 / F.col("__all")).otherwise(0.0)
    return counts.select("__all", F.inline(rows)).select(
        "position", "label", "value", percent.alias("percent")
    )


def controversial_split(facts: DataFrame) -> DataFrame:
    label = F.when(F.col("controversiality") > 0, "controversial").otherwise("non_controversial")
    return _fixed_labels(
        facts.select(label.alias("label")), "label", ["controversial", "non_controversial"]
    )


def media_split(posts: DataFrame, media: str = "post_type") -> DataFrame:
    """Posts per medium in the fixed order video, photo, text, other."""
    return _fixed_labels(
        posts.select(F.coalesce(media, F.lit("other")).alias("label")), "label", MEDIA_LABELS
    )


def sentiment_kpis(scored: DataFrame, score: str = "sentiment") -> DataFrame:
    return scored.agg(
        _or_zero(F.avg(score)).alias("avg_sentiment"),
        F.count_if(F.col(score) > 0).alias("positive_posts"),
        F.count_if(F.col(score) < 0).alias("negative_posts"),
        F.count_if(F.col(score) == 0).alias("neutral_posts"),
    )


def sentiment_timeline(
    scored: DataFrame, day: str = "created_date", score: str = "sentiment"
) -> DataFrame:
    return scored.groupBy(F.col(day).alias("bucket")).agg(
        F.count_if(F.col(score) > 0).alias("positive_posts"),
        F.count_if(F.col(score) < 0).alias("negative_posts"),
        F.count_if(F.col(score) == 0).alias("neutral_posts"),
        F.avg(score).alias("avg_sentiment"),
        F.count(F.lit(1)).alias("total"),
    )


def _kinds(collection: str) -> dict[str, Column]:
    return {
        "posts": F.count_if(F.col(collection) == POST_COLLECTION),
        "likes": F.count_if(F.col(collection) == LIKE_COLLECTION),
        "follows": F.count_if(F.col(collection) == FOLLOW_COLLECTION),
    }


def event_overview(events: DataFrame, ts: str, collection: str = "collection") -> DataFrame:
    """One row over posts, likes and follows; filter with ``known_collections`` first."""
    sums = events.agg(
        *[count.alias(f"total_{name}") for name, count in _kinds(collection).items()],
        F.count(F.lit(1)).alias("total_engagement"),
        F.countDistinct(F.to_date(ts)).alias("active_days"),
    )
    return sums.withColumn(
        "avg_engagement_per_day", _per_day(F.col("total_engagement"), F.col("active_days"))
    )


def event_daily(events: DataFrame, ts: str, collection: str = "collection") -> DataFrame:
    return events.groupBy(F.to_date(ts).alias("bucket")).agg(
        *[count.alias(name) for name, count in _kinds(collection).items()],
        F.count(F.lit(1)).alias("total"),
    )


def count_by(df: DataFrame, column: Column | str, out: str = "value") -> DataFrame:
    """Rows per value; arrays and structs may be values too."""
    key = F.col(column) if isinstance(column, str) else column
    return df.groupBy(key.alias(out)).agg(F.count(F.lit(1)).alias("count"))


def mention_split(df: DataFrame, text: str, word: str) -> DataFrame:
    """Posts with and without ``word`` among their blank-separated tokens."""
    has = F.array_contains(F.split(F.col(text), " "), word)
    return (
        df.dropna(subset=[text])
        .groupBy(has.alias("has_word"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def texts_by_author(
    df: DataFrame, author: str, text: str, order: str, per_part: int = 10_000
) -> DataFrame:
    """Texts of each author as lists, in ``order`` (a unique column).

    A list holds ``per_part`` texts that follow each other: ``part`` 0 the first, ``part`` 1 the
    next, and so on for every author alike. Positions are running counts over range partitions,
    so an author with a large share of the texts is sorted and listed by several tasks.
    """
    posts = df.select(author, text, order).dropna(subset=[text]).withColumn("__one", F.lit(1))
    placed = running_total(posts, author, [order], "__one", "__at")
    part = F.floor((F.col("__at") - 1) / per_part).cast("bigint")
    texts = F.array_sort(F.collect_list(F.struct(order, text)))
    return placed.groupBy(author, part.alias("part")).agg(
        F.transform(texts, lambda row: row[text]).alias("texts")
    )
