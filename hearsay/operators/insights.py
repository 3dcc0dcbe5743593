"""Reports made of several operators.

``feature_insights`` needs word statistics in many shapes. They are all sums over (word, day),
so the texts are read once, into a table of those sums in the shared folder, and every part
of the report is worked out from that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.functions.scores import controversy_score, interest_value
from hearsay.functions.times import month_key
from hearsay.functions.vocab import NEGATIVE_WORDS, POSITIVE_WORDS, POST_COLLECTION
from hearsay.operators import kpis, trends, words
from hearsay.operators.filters import calendar_filter, known_collections, posts_only
from hearsay.session import ensure_checkpoint_dir

# Stands for all posts of a day. No tokenizer yields it.
EVERY_POST = ""


def word_days(scored: DataFrame, day: str = "created_date") -> DataFrame:
    """Sums per word and day over the posts a word stands in, and over all posts of the day.

    Sums add up to months, to words or to days; averages would not.
    """
    posts = scored.select(
        F.col(day).alias("bucket"),
        "sentiment",
        interest_value("ups", "num_comments", "score").alias("interest"),
        controversy_score("num_comments", "score").alias("controversy"),
        # A post without a title has no words and still counts for its day. The expression itself
        # is exploded: of a column Spark would filter the size first and tokenize again for it.
        F.explode(
            F.array_append(
                F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>"))),
                F.lit(EVERY_POST),
            )
        ).alias("word"),
    )
    rows = posts
    return rows.groupBy("word", "bucket").agg(
        F.count(F.lit(1)).alias("count"),
        F.sum("sentiment").alias("sentiment"),
        F.sum("interest").alias("interest"),
        F.sum("controversy").alias("controversy"),
        F.count_if(F.col("sentiment") > 0).alias("positive"),
        F.count_if(F.col("sentiment") < 0).alias("negative"),
    )


def word_totals(points: DataFrame) -> DataFrame:
    """The columns of ``word_stats`` from the daily sums."""
    sums = points.groupBy(F.col("word").alias("topic")).agg(
        *[F.sum(name).alias(f"__{name}") for name in points.columns if name not in ("word", "bucket")]
    )

    def mean(name: str, out: str):
        return (F.col(f"__{name}") / F.col("__count")).alias(out)

    return sums.select(
        "topic",
        F.col("__count").alias("mentions"),
        mean("sentiment", "avg_sentiment"),
        mean("interest", "avg_engagement"),
        mean("controversy", "avg_controversy"),
        mean("positive", "positive_rate"),
        mean("negative", "negative_rate"),
    )


def feature_insights(
    facts: DataFrame,
    year: str | int = "overall",
    months: str | list[int] | None = None,
    word: str | None = None,
    positive: list[str] = POSITIVE_WORDS,
    negative: list[str] = NEGATIVE_WORDS,
    trend_pool: int = 25,
) -> dict[str, DataFrame]:
    """Sentiment, popularity, controversy, topics to post about or avoid, and dying trends."""
    ensure_checkpoint_dir(facts.sparkSession)
    scored = words.scored_titles(calendar_filter(facts, year, months), "title", positive, negative)
    table = word_days(scored).checkpoint()
    daily = table.filter(F.col("word") == EVERY_POST).drop("word")
    points = table.filter(F.col("word") != EVERY_POST)
    days = daily.select("bucket")

    neutral = F.col("count") - F.col("positive") - F.col("negative")
    timeline = daily.select(
        "bucket",
        F.col("positive").alias("positive_posts"),
        F.col("negative").alias("negative_posts"),
        neutral.alias("neutral_posts"),
        (F.col("sentiment") / F.col("count")).alias("avg_sentiment"),
        F.col("count").alias("total"),
    )
    figures = daily.agg(
        F.coalesce(F.sum("sentiment") / F.sum("count"), F.lit(0.0)).alias("avg_sentiment"),
        *[
            F.coalesce(F.sum(column), F.lit(0)).alias(name)
            for name, column in (
                ("positive_posts", F.col("positive")),
                ("negative_posts", F.col("negative")),
                ("neutral_posts", neutral),
            )
        ],
    )
    monthly = points.groupBy("word", month_key("bucket").alias("bucket")).agg(
        F.sum("count").alias("count"), (F.sum("sentiment") / F.sum("count")).alias("avg_sentiment")
    )
    if word:
        one = word.strip().lower()
        own = points.filter(F.col("word") == one).select("bucket", "count")
        popular = days.join(own, "bucket", "left").select(
            F.lit(one).alias("word"), "bucket", F.coalesce("count", F.lit(0)).alias("count")
        )
    else:
        popular = trends.dense_top(points, days, 5)
    totals = word_totals(points)
    dying = trends.dying(trends.figures(trends.dense_top(points, days, trend_pool)), 8)
    return {
        "sentiment_kpis": figures,
        "sentiment_timeline": timeline,
        "word_popularity": trends.with_total(popular),
        "topic_sentiment_heatmap": words.heatmap(
            monthly, days.select(month_key("bucket").alias("bucket"))
        ),
        "controversial_topics": words.rank_controversial(totals),
        "best_topics_to_post": words.rank_best(totals),
        "topics_to_avoid": words.rank_avoid(totals),
        "trend_summary": trends.summary(dying),
        "trend_series": trends.timeline(dying).drop("total"),
        "trend_saturation": trends.timeline(
            dying.orderBy("slope", "saturation_ratio", "topic").limit(3)
        ),
    }


def forum_overview(
    facts: DataFrame, year: str | int = "overall", months: str | list[int] | None = None
) -> dict[str, DataFrame]:
    chosen = calendar_filter(facts, year, months)
    return {
        "available_years": kpis.available_years(facts),
        "kpis": kpis.post_kpis(chosen),
        "content_split": kpis.content_split(chosen),
        "post_type_split": kpis.type_split(chosen),
        "top_keywords": words.top_keywords(posts_only(chosen), "title"),
        "timeline": kpis.daily_posts(chosen),
        "timeline_series": kpis.daily_series(chosen),
    }


def comments_overview(
    facts: DataFrame, year: str | int = "overall", months: str | list[int] | None = None
) -> dict[str, DataFrame]:
    chosen = calendar_filter(facts, year, months)
    return {
        "available_years": kpis.available_years(facts),
        "kpis": kpis.comment_kpis(chosen),
        "timeline_series": kpis.daily_comments(chosen),
        "controversial_split": kpis.controversial_split(chosen),
        "score_split": kpis.score_split(chosen),
    }


def feed_overview(
    events: DataFrame,
    ts: str,
    collection: str,
    text: str,
    media: str,
    year: str | int = "overall",
    months: str | list[int] | None = None,
) -> dict[str, DataFrame]:
    """Overview of the post/like/follow feed; ``media`` is the medium of a post."""
    known = known_collections(events, collection).withColumns(
        {"year": F.year(ts), "month": F.month(ts)}
    )
    chosen = calendar_filter(known, year, months)
    posts = chosen.filter(F.col(collection) == POST_COLLECTION)
    return {
        "available_years": kpis.available_years(known),
        "kpis": kpis.event_overview(chosen, ts, collection),
        "post_type_split": kpis.media_split(posts, media),
        "top_keywords": words.top_keywords(posts, text),
        "timeline_series": kpis.event_daily(chosen, ts, collection),
    }
