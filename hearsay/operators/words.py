"""Words and topics: counts, sentiment, controversy, topics to post about or to avoid.

Posts are scored before they are exploded into words, and word statistics are plain sums,
so a word that stands in every post is combined map-side and never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearsay.functions.scores import (
    controversy_score, interest_value, like_reply_ratio, wordlist_sentiment,
)
from hearsay.functions.text import tokens_alpha, tokens_ws
from hearsay.functions.times import month_key
from hearsay.functions.vocab import NEGATIVE_WORDS, POSITIVE_WORDS
from hearsay.operators.filters import posts_only
from hearsay.operators.ranks import pool_top_k, rank_key, top_k
from hearsay.operators.grids import dense_series, top_series


def word_rows(df: DataFrame, tokens: Column, out: str = "word") -> DataFrame:
    """One row per token of each row."""
    return df.withColumn(out, F.explode(tokens))


def word_counts(df: DataFrame, tokens: Column, count: str = "count") -> DataFrame:
    words = df.select(F.explode(tokens).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias(count))


def top_keywords(df: DataFrame, text: str, k: int = 6, **options) -> DataFrame:
    """The k most frequent words, every occurrence counted."""
    return top_k(word_counts(df, tokens_alpha(text, **options)), "count", k, "word")


def posts_per_word(df: DataFrame, text: str) -> DataFrame:
    """In how many posts each word stands, most frequent first."""
    counts = word_counts(df, tokens_ws(text), "posts")
    return counts.orderBy(F.desc("posts"), F.asc("word"))


def word_controversy(df: DataFrame, text: str, likes: str, replies: str) -> DataFrame:
    """Average like/reply ratio of the posts a word stands in."""
    scored = df.select(like_reply_ratio(likes, replies).alias("__ratio"), F.col(text))
    words = word_rows(scored, tokens_ws(text))
    return words.groupBy("word").agg(F.avg("__ratio").alias("avg_like_to_comment_ratio"))


def word_sentiment_avg(df: DataFrame, tokens: Column, score: str) -> DataFrame:
    """Average score of the posts a word stands in, each post counted once."""
    words = word_rows(df.select(score, tokens.alias("__tokens")), F.array_distinct("__tokens"))
    return words.groupBy("word").agg(F.avg(score).alias("avg_sentiment"))


def with_wordlist_score(
    df: DataFrame,
    text: str,
    positive: list[str] = POSITIVE_WORDS,
    negative: list[str] = NEGATIVE_WORDS,
    out: str = "score",
) -> DataFrame:
    """Add the word-list sentiment of a text. The tokens are a column of their own first:
    the score mentions them four times, and nested they would be made four times."""
    tokenized = df.withColumn("__tokens", tokens_alpha(text))
    return tokenized.withColumn(
        out, wordlist_sentiment("__tokens", positive, negative)
    ).drop("__tokens")


def scored_titles(
    facts: DataFrame,
    text: str = "title",
    positive: list[str] = POSITIVE_WORDS,
    negative: list[str] = NEGATIVE_WORDS,
) -> DataFrame:
    """Posts (no comments) with their ``tokens`` and word-list ``sentiment``."""
    tokenized = posts_only(facts).withColumn("tokens", tokens_alpha(text))
    return tokenized.withColumn("sentiment", wordlist_sentiment("tokens", positive, negative))


def _post_words(scored: DataFrame, *columns: Column | str) -> DataFrame:
    """One row per distinct word of each post."""
    return word_rows(scored.select("tokens", *columns), F.array_distinct("tokens")).drop("tokens")


def word_day_counts(scored: DataFrame, day: str = "created_date") -> DataFrame:
    """Posts per word and day."""
    words = _post_words(scored, F.col(day).alias("bucket"))
    return words.groupBy("word", "bucket").agg(F.count(F.lit(1)).alias("count"))


def word_stats(scored: DataFrame) -> DataFrame:
    """Per word: mentions and means over the posts it stands in."""
    words = _post_words(
        scored,
        "sentiment",
        interest_value("ups", "num_comments", "score").alias("__interest"),
        controversy_score("num_comments", "score").alias("__controversy"),
    )
    return words.groupBy(F.col("word").alias("topic")).agg(
        F.count(F.lit(1)).alias("mentions"),
        F.avg("sentiment").alias("avg_sentiment"),
        F.avg("__interest").alias("avg_engagement"),
        F.avg("__controversy").alias("avg_controversy"),
        F.avg((F.col("sentiment") > 0).cast("double")).alias("positive_rate"),
        F.avg((F.col("sentiment") < 0).cast("double")).alias("negative_rate"),
    )


def sentiment_heatmap(scored: DataFrame, k: int = 8, day: str = "created_date") -> DataFrame:
    """Average sentiment of the k most frequent words in every month that has a post."""
    words = _post_words(scored, "sentiment", month_key(day).alias("bucket"))
    cells = words.groupBy("word", "bucket").agg(
        F.count(F.lit(1)).alias("count"), F.avg("sentiment").alias("avg_sentiment")
    )
    return heatmap(cells, scored.select(month_key(day).alias("bucket")), k)


def heatmap(cells: DataFrame, months: DataFrame, k: int = 8) -> DataFrame:
    values = ["count", "avg_sentiment"]
    topics = top_series(cells, "word", "bucket", values, k, "count")
    return dense_series(topics, months, "word", "bucket", values).withColumnRenamed("word", "topic")


def controversial_words(scored: DataFrame, pool: int = 12, k: int = 8) -> DataFrame:
    """Of the most frequent words, those whose posts draw most comments per point."""
    return rank_controversial(word_stats(scored), pool, k)


def rank_controversial(stats: DataFrame, pool: int = 12, k: int = 8) -> DataFrame:
    named = stats.select(
        "topic", "mentions", F.col("avg_controversy").alias("controversy_score")
    )
    return pool_top_k(named, "mentions", pool, rank_key("controversy_score"), k, "topic")


def _relative(column: str) -> Column:
    """A column relative to its maximum over a pool; the pool is cut to at most 80 rows
    before, so this window is over those only."""
    top = F.max(column).over(Window.partitionBy())
    return F.col(column) / F.coalesce(F.nullif(top, F.lit(0.0)), F.lit(1.0))


def best_topics(
    scored: DataFrame, pool: int = 60, min_mentions: int = 5, k: int = 8
) -> DataFrame:
    """Frequent words in a positive setting that draw interest."""
    return rank_best(word_stats(scored), pool, min_mentions, k)


def rank_best(
    stats: DataFrame, pool: int = 60, min_mentions: int = 5, k: int = 8
) -> DataFrame:
    candidates = top_k(stats, "mentions", pool, "topic").filter(
        (F.col("mentions") >= min_mentions) & (F.col("avg_sentiment") > 0)
    )
    score = (
        F.col("avg_sentiment") * 0.55
        + _relative("avg_engagement") * 0.30
        + F.col("positive_rate") * 0.15
    )
    ranked = candidates.withColumn("opportunity_score", score).select(
        "topic", "mentions", "avg_sentiment", "avg_engagement", "positive_rate",
        "opportunity_score",
    )
    return top_k(ranked, rank_key("opportunity_score"), k, "topic")


def avoid_topics(
    scored: DataFrame, pool: int = 80, min_mentions: int = 5, k: int = 8
) -> DataFrame:
    """Frequent words in a negative or disputed setting."""
    return rank_avoid(word_stats(scored), pool, min_mentions, k)


def rank_avoid(
    stats: DataFrame, pool: int = 80, min_mentions: int = 5, k: int = 8
) -> DataFrame:
    harmless = (
        (F.col("avg_sentiment") >= 0)
        & (F.col("negative_rate") < 0.03)
        & (F.col("avg_controversy") < 0.5)
    )
    candidates = top_k(stats, "mentions", pool, "topic").filter(
        (F.col("mentions") >= min_mentions) & ~harmless
    )
    score = (
        F.greatest(-F.col("avg_sentiment"), F.lit(0.0)) * 0.45
        + F.col("negative_rate") * 0.30
        + _relative("avg_controversy") * 0.25
    )
    ranked = candidates.withColumn("avoid_score", score).select(
        "topic", "mentions", "avg_sentiment", "negative_rate", "avg_controversy", "avoid_score"
    )
    return top_k(ranked, rank_key("avoid_score"), k, "topic")
