"""Time series tables and the queries on them.

The series builders take batch and streaming frames alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearsay.functions.text import as_col, mentions, tokenize, word_eq
from hearsay.operators.filters import between_ts, controversial
from hearsay.operators.ranks import global_places, rank_key, top_k, top_per_group


def _windowed(df: DataFrame, ts: str, width: str, key: str, out: str, **aggregates) -> DataFrame:
    """Tumbling windows per key. Rows without a time fall in no window.

    A stream's groups are windows, which carry its watermark. A batch's are their starts alone:
    nearly every word of a post opens a group, and a window has its end in each of them too.
    """
    window = F.window(ts, width)
    columns = [column.alias(name) for name, column in aggregates.items()]
    if df.isStreaming:
        counted = df.groupBy(window.alias("__window"), key).agg(*columns)
        return counted.select(F.col("__window.start").alias(out), key, *aggregates)
    starts = df.withColumn("__window", window).withColumn("__start", F.col("__window.start"))
    counted = starts.groupBy("__start", key).agg(*columns)
    return counted.select(F.col("__start").alias(out), key, *aggregates)


def word_series(
    df: DataFrame,
    text: str = "text",
    ts: str = "ts",
    score: str = "score",
    width: str = "10 minutes",
    tokenizer: str = "clean",
    count: str = "posts",
    **options,
) -> DataFrame:
    """Average post score and number of uses per word and window.

    ``count="posts"`` counts a word once per post, ``"occurrences"`` every time.
    """
    tokens = tokenize(text, tokenizer, unique=count == "posts", **options)
    words = df.select(ts, score, F.explode(tokens).alias("word"))
    return _windowed(
        words, ts, width, "word", "time_range",
        avg_vader_sentiment_score=F.avg(score), word_count=F.count(F.lit(1)),
    )


def controversy_series(
    df: DataFrame,
    text: str = "text",
    ts: str = "ts",
    likes: str = "like_count",
    replies: str = "reply_count",
    min_replies: int = 50,
    width: str = "10 minutes",
    tokenizer: str = "clean",
    **options,
) -> DataFrame:
    """Average like/reply ratio per topic and window over much-replied posts."""
    posts = controversial(df, likes, replies, min_replies, "__ratio")
    topics = posts.select(
        ts, "__ratio", F.explode(tokenize(text, tokenizer, **options)).alias("topic_name")
    )
    return _windowed(
        topics, ts, width, "topic_name", "time_bucket",
        average_like_to_comment_ratio=F.avg("__ratio"),
    )


def crosslink_series(
    df: DataFrame,
    needle: str,
    text: str = "text",
    ts: str = "ts",
    width: str = "10 minutes",
    tokenizer: str = "clean",
    **options,
) -> DataFrame:
    """Posts per topic and window among the posts that mention a site."""
    linking = df.filter(mentions(text, needle))
    topics = linking.select(
        ts, F.explode(tokenize(text, tokenizer, **options)).alias("topic_name")
    ).filter(~mentions("topic_name", needle))
    return _windowed(
        topics, ts, width, "topic_name", "time_bucket", link_count=F.count(F.lit(1))
    )


def labelled(df: DataFrame, ts: Column | str, source: str) -> DataFrame:
    """Time and source label of each record: what an ingestion count needs."""
    return df.select(as_col(ts).alias("event_time"), F.lit(source).alias("source_type")).filter(
        F.col("event_time").isNotNull()
    )


def union_sources(*sources: DataFrame) -> DataFrame:
    """Sources below each other by column name; columns missing on one side are null."""
    whole = sources[0]
    for source in sources[1:]:
        whole = whole.unionByName(source, allowMissingColumns=True)
    return whole


def ingestion_metrics(*sources: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Records per window and source of ``labelled`` frames, in one aggregate."""
    return _windowed(
        union_sources(*sources), "event_time", width, "source_type", "time_bucket",
        record_count=F.count(F.lit(1)),
    )


def ingestion_stats(metrics: DataFrame, low=None, high=None) -> DataFrame:
    kept = between_ts(metrics, "time_bucket", low, high)
    return kept.groupBy("time_bucket", "source_type").agg(
        F.sum("record_count").alias("record_count")
    )


def align_sources(metrics: DataFrame, sources: list[str]) -> DataFrame:
    """One row per bucket with one count column per source, 0 where a source is silent."""
    wide = metrics.groupBy("time_bucket").pivot("source_type", sources).agg(F.sum("record_count"))
    return wide.fillna(0, subset=sources)


def word_sentiment(
    series: DataFrame, word: str, low=None, high=None, weighted: bool = False
) -> DataFrame:
    """Sentiment series of one word, any case. ``weighted`` weighs rows of the same time by
    their counts."""
    kept = between_ts(series.filter(word_eq("word", word)), "time_range", low, high)
    score, count = F.col("avg_vader_sentiment_score"), F.col("word_count")
    mean = F.sum(score * count) / F.sum(count) if weighted else F.avg(score)
    return kept.groupBy("time_range").agg(mean.alias("sentiment_score"))


def series_for_top(series: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """The rows of a series whose key is in ``top``, of any size."""
    return series.join(top.select(key), key, "left_semi")


def popular_words(series: DataFrame, n: int, low=None, high=None) -> DataFrame:
    """The n most used words in a range with their series."""
    # The join below filters null words; doing it here lets both sides share one scan.
    in_range = between_ts(series.filter(F.col("word").isNotNull()), "time_range", low, high)
    totals = in_range.groupBy("word").agg(F.sum("word_count").alias("total_count"))
    top = top_k(totals, "total_count", n, "word")
    points = in_range.join(top, "word")
    return points.groupBy("word", "total_count", "time_range").agg(
        F.sum("word_count").alias("popularity")
    )


def word_popularity(series: DataFrame, word: str, low=None, high=None) -> DataFrame:
    kept = between_ts(series.filter(word_eq("word", word)), "time_range", low, high)
    return kept.groupBy("time_range").agg(F.sum("word_count").alias("word_count"))


def cross_topics(links: DataFrame, n: int) -> DataFrame:
    """The n topics with most links over all time."""
    totals = links.groupBy("topic_name").agg(F.sum("link_count").alias("links"))
    return top_k(totals, "links", n, "topic_name")


def word_controversy_series(topics: DataFrame, word: str, low=None, high=None) -> DataFrame:
    kept = between_ts(topics.filter(word_eq("topic_name", word)), "time_bucket", low, high)
    return kept.select("time_bucket", "average_like_to_comment_ratio").orderBy("time_bucket")


def top_per_bucket(
    topics: DataFrame, n: int, low=None, high=None, descending: bool = True
) -> DataFrame:
    """The n topics with the highest ratio in each window."""
    in_range = between_ts(topics, "time_bucket", low, high)
    return top_per_group(
        in_range, "time_bucket", rank_key("average_like_to_comment_ratio"), n, "topic_name",
        descending,
    )


def range_controversy(topics: DataFrame, n: int, low=None, high=None) -> DataFrame:
    """Topics by the mean of their ratios in those windows where they were among the top n."""
    ranked = top_per_bucket(topics, n, low, high)
    means = ranked.groupBy("topic_name").agg(
        F.avg("average_like_to_comment_ratio").alias("value")
    )
    return top_k(means, rank_key("value"), n, "topic_name")


def rollup_series(df: DataFrame, day: str, values: list[str], grain: str = "month") -> DataFrame:
    """A daily series summed to months or to weeks starting on Monday."""
    start = F.to_date(F.date_trunc(grain, F.col(day)))
    return df.groupBy(start.alias(grain)).agg(*[F.sum(value).alias(value) for value in values])


def merge_timelines(
    left: DataFrame, right: DataFrame, bucket: str, value: str, names: tuple[str, str]
) -> DataFrame:
    """Two series side by side; where one has no point it is 0."""
    a = left.select(bucket, F.col(value).alias(names[0]))
    b = right.select(bucket, F.col(value).alias(names[1]))
    return a.join(b, bucket, "full_outer").fillna(0, subset=list(names))


def peak_smooth(
    series: DataFrame, key: str, bucket: str, value: str, out: str = "smoothed"
) -> DataFrame:
    """Largest of the previous, the current and the next point of each key."""
    window = Window.partitionBy(key).orderBy(bucket).rowsBetween(-1, 1)
    return series.withColumn(out, F.max(value).over(window))


def sample_series(series: DataFrame, order: str, n: int, key: str | None = None) -> DataFrame:
    """At most n evenly spread points per key, the first and the last among them.

    Point i of n is at place ``round(i * (length - 1) / (n - 1))``, halves to even. With
    more points than n those places lie over one apart, so each row can tell from its own
    place whether it is one. Without ``key`` the frame must hold a single series, of any length:
    its rows get their places from range partitions and the numbers of rows before them.
    """
    if n <= 0:
        return series.limit(0)
    if key:
        window = Window.partitionBy(key)
        placed = series.withColumn(
            "__i", F.row_number().over(window.orderBy(order)) - 1
        ).withColumn("__last", F.count(F.lit(1)).over(window) - 1)
    else:
        placed = global_places(series, order)
    place, last = F.col("__i"), F.col("__last")
    if n == 1:
        chosen = place == last
    else:
        step = F.round(place * (n - 1) / F.nullif(last, F.lit(0)))
        chosen = (last < n) | (F.bround(step * last / (n - 1)) == place)
    return placed.filter(chosen).drop("__i", "__last")
