"""Feeds built from the test tables, in Spark and as SQL common table expressions.

The tables hold no social posts, so each document becomes a post that takes its author,
time and counters from an event. Events are matched at a stride, so posts span all days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.functions.times import epoch_micros
from hearsay.functions.vocab import (
    FOLLOW_COLLECTION, IMAGE_DOMAIN, IMAGE_EXTENSION, LIKE_COLLECTION, POST_COLLECTION,
    SHORT_STOPWORDS, VIDEO_DOMAIN, VIDEO_EXTENSION, default_stopwords,
)
from hearsay.operators.facts import comment_facts, post_facts
from hearsay.operators.series import controversy_series, crosslink_series, word_series
from hearsay.operators.words import scored_titles, with_wordlist_score

# Word lists that occur in the generated texts (the built-in ones hardly do).
GOOD = ["tion", "ment", "ble", "thing", "thon", "thin"]
POOR = ["rewh", "hehely", "ther", "than", "ing"]
OTHER_COLLECTION = "app.other.record"
NEEDLE = "example."
WORD = "thing"
LOW, HIGH = "2024-01-01 00:00:00", "2024-12-31 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rows_of(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def posts(spark: SparkSession, folder: str) -> DataFrame:
    documents, events = table(spark, folder, "documents"), table(spark, folder, "events")
    stride = F.floor(rows_of(events) / rows_of(documents))
    keyed = documents.withColumn("event_id", F.col("doc_id") * stride)
    # Both tables grow alike; a merge join also deals the texts of a single small file to all tasks.
    return keyed.join(events.hint("merge"), "event_id").select(
        F.col("doc_id").alias("post_id"),
        F.col("user_id").alias("did"),
        "ts",
        "text",
        F.array("lang").alias("langs"),
        "lang",
        "source",
        "event_type",
        F.floor("value").alias("like_count"),
        F.get_json_object("props", "$.k").cast("bigint").alias("reply_count"),
    )


POSTS = """posts AS (
  SELECT d.doc_id AS post_id, e.user_id AS did, e.ts, d.text, [d.lang] AS langs, d.lang,
         d.source, e.event_type, CAST(floor(e.value) AS BIGINT) AS like_count,
         CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS reply_count
  FROM documents d JOIN events e ON e.event_id = d.doc_id *
       ((SELECT count(*) FROM events) // (SELECT count(*) FROM documents)))"""


def feed(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a post/like/follow feed with nested records."""
    kind = F.col("event_type")
    collection = (
        F.when(kind == "view", POST_COLLECTION)
        .when(kind == "click", LIKE_COLLECTION)
        .when(kind == "purchase", FOLLOW_COLLECTION)
        .otherwise(OTHER_COLLECTION)
    )
    operation = F.when(F.col("value") < 250, "create").otherwise("delete")
    return table(spark, folder, "events").select(
        "event_id",
        F.col("user_id").alias("did"),
        "ts",
        epoch_micros("ts").alias("time_us"),
        "value",
        F.struct(
            collection.alias("collection"),
            operation.alias("operation"),
            F.col("event_id").cast("string").alias("rkey"),
            F.struct(F.col("props").alias("text"), kind.alias("kind")).alias("record"),
        ).alias("commit"),
        collection.alias("collection"),
    )


FEED = f"""feed AS (
  SELECT event_id, user_id AS did, ts, value, event_type, props,
         CASE event_type WHEN 'view' THEN '{POST_COLLECTION}'
              WHEN 'click' THEN '{LIKE_COLLECTION}'
              WHEN 'purchase' THEN '{FOLLOW_COLLECTION}'
              ELSE '{OTHER_COLLECTION}' END AS collection,
         CASE WHEN value < 250 THEN 'create' ELSE 'delete' END AS operation
  FROM events)"""


def forum_posts(spark: SparkSession, folder: str) -> DataFrame:
    """Posts as raw forum records; links come from the pages."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    kind, replies = F.col("event_type"), F.col("reply_count")
    hint = (
        F.when(kind == "error", "rich:video").when(kind == "click", "image")
        .when(kind == "signup", "poll")
    )
    linked = posts(spark, folder).withColumn("page_id", F.col("post_id") % rows_of(pages))
    return linked.join(pages, "page_id").select(
        F.col("post_id").cast("string").alias("id"),
        F.col("source").alias("subreddit"),
        F.col("text").alias("title"),
        (F.col("like_count") - replies).alias("score"),
        F.col("like_count").alias("ups"),
        F.lit(0).cast("bigint").alias("downs"),
        replies.alias("num_comments"),
        hint.alias("post_hint"),
        F.lit(False).alias("is_video"),
        "url",
        F.regexp_extract("url", "https?://([^/?#]+)", 1).alias("domain"),
        F.lit(None).cast("string").alias("url_overridden_by_dest"),
        F.when(kind == "purchase", F.col("text")).alias("selftext"),
        ((kind == "view") & (replies < 30)).alias("is_gallery"),
        F.when((kind == "view") & (replies >= 80), F.concat(F.lit("t3_"), "post_id")).alias(
            "crosspost_parent"
        ),
        (epoch_micros("ts") / 1_000_000).alias("created_utc"),
    )


def forum_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as raw forum comments."""
    turns, events = table(spark, folder, "conversations"), table(spark, folder, "events")
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("conv_id"), "toxic")
    threads = turns.agg(F.max("conv_id") + 1).scalar()
    stride = F.floor(rows_of(events) / (threads * 8))
    place = F.col("conv_id") * 8 + F.col("turn")
    keyed = turns.withColumn("event_id", place * stride)
    score = F.get_json_object("props", "$.k").cast("bigint") - 50
    return (
        keyed.join(events, "event_id")
        .join(labels, "conv_id", "left")
        .select(
            place.cast("string").alias("id"),
            F.lit(None).cast("string").alias("subreddit"),
            F.col("text").alias("body"),
            score.alias("score"),
            F.floor("value").alias("ups"),
            F.lit(0).cast("bigint").alias("downs"),
            F.coalesce("toxic", F.lit(0)).cast("bigint").alias("controversiality"),
            (epoch_micros("ts") / 1_000_000).alias("created_utc"),
        )
    )


def facts(spark: SparkSession, folder: str) -> DataFrame:
    return post_facts(forum_posts(spark, folder), 1)


def facts_with_comments(spark: SparkSession, folder: str) -> DataFrame:
    return post_facts(forum_posts(spark, folder), 1, forum_comments(spark, folder))


def remarks(spark: SparkSession, folder: str) -> DataFrame:
    return comment_facts(forum_comments(spark, folder), 1)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return scored_titles(facts(spark, folder), "title", GOOD, POOR)


def sql_list(words: list[str]) -> str:
    return "(" + ", ".join("'" + word.replace("'", "''") + "'" for word in words) + ")"


LINKS = """links AS (
  SELECT p.*, g.url, regexp_extract(g.url, 'https?://([^/?#]+)', 1) AS domain
  FROM posts p JOIN pages g ON g.page_id = p.post_id % (SELECT count(*) FROM pages))"""

FACTS = f"""{POSTS}, {LINKS}, facts AS (
  SELECT CAST(post_id AS VARCHAR) AS post_id, CAST(ts AS DATE) AS created_date,
         year(ts) AS year, month(ts) AS month, text AS title, source AS community,
         CAST(like_count - reply_count AS DOUBLE) AS score, CAST(like_count AS DOUBLE) AS ups,
         0.0::DOUBLE AS downs, CAST(reply_count AS DOUBLE) AS num_comments,
         1.0::DOUBLE + like_count + reply_count AS engagement,
         CASE WHEN event_type = 'view' AND reply_count < 30 THEN 'gallery'
              WHEN event_type = 'error' OR regexp_matches(lower(url), '{VIDEO_EXTENSION}')
                   OR regexp_matches(lower(url), '{VIDEO_DOMAIN}') THEN 'video'
              WHEN event_type = 'click' OR regexp_matches(lower(url), '{IMAGE_EXTENSION}')
                   OR regexp_matches(lower(domain), '{IMAGE_DOMAIN}') THEN 'image'
              WHEN event_type = 'signup' THEN 'poll'
              WHEN event_type = 'view' AND reply_count >= 80 THEN 'crosspost'
              WHEN event_type = 'purchase' THEN 'text'
              ELSE 'link' END AS post_type
  FROM links)"""

REMARKS = """remarks AS (
  SELECT CAST(c.conv_id * 8 + c.turn AS VARCHAR) AS comment_id,
         CAST(e.ts AS DATE) AS created_date, year(e.ts) AS year, month(e.ts) AS month,
         c.text AS body, CAST(json_extract_string(e.props, '$.k') AS DOUBLE) - 50 AS score,
         floor(e.value) AS ups, 0.0::DOUBLE AS downs,
         CAST(coalesce(l.toxic, 0) AS BIGINT) AS controversiality
  FROM conversations c
  JOIN events e ON e.event_id = (c.conv_id * 8 + c.turn) *
       ((SELECT count(*) FROM events) // (8 * (SELECT max(conv_id) + 1 FROM conversations)))
  LEFT JOIN labels l ON l.doc_id = c.conv_id)"""

ALL_FACTS = f"""{FACTS}, {REMARKS}, all_facts AS (
  SELECT post_id, created_date, year, month, title, score, ups, downs, num_comments,
         engagement, post_type FROM facts
  UNION ALL
  SELECT comment_id, created_date, year, month, body, score, ups, downs, 0.0,
         1.0 + ups + downs, 'comment' FROM remarks)"""


def alpha_sql(text: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({text}), '[a-z]{{3,}}'), "
        f"lambda t: t NOT IN {sql_list(SHORT_STOPWORDS)})"
    )


def clean_sql(text: str, unique: bool = True) -> str:
    kept = (
        f"list_filter(regexp_extract_all(lower(regexp_replace({text}, '[^a-zA-Z0-9]+', ' ', "
        f"'g')), '\\b[a-z][a-z0-9]+\\b'), lambda t: t NOT IN {sql_list(default_stopwords())})"
    )
    return f"list_distinct({kept})" if unique else kept


def sentiment_sql(
    tokens: str, positive: list[str] | None = None, negative: list[str] | None = None
) -> str:
    return (
        f"CASE WHEN len({tokens}) > 0 THEN CAST("
        f"len(list_filter({tokens}, lambda t: t IN {sql_list(positive or GOOD)})) - "
        f"len(list_filter({tokens}, lambda t: t IN {sql_list(negative or POOR)})) AS DOUBLE) / "
        f"len({tokens}) ELSE 0.0 END"
    )


SCORED = f"""{FACTS}, tokenized AS (
  SELECT *, {alpha_sql('title')} AS tokens FROM facts), scored AS (
  SELECT *, {sentiment_sql('tokens')} AS sentiment FROM tokenized), post_words AS (
  SELECT post_id, created_date, score, ups, num_comments, sentiment,
         unnest(list_distinct(tokens)) AS word FROM scored)"""

STATS = f"""{SCORED}, stats AS (
  SELECT word AS topic, count(*) AS mentions, avg(sentiment) AS avg_sentiment,
         avg(ups + num_comments + greatest(score, 0)) AS avg_engagement,
         avg(num_comments / (abs(score) + 1)) AS avg_controversy,
         avg(CASE WHEN sentiment > 0 THEN 1.0 ELSE 0.0 END) AS positive_rate,
         avg(CASE WHEN sentiment < 0 THEN 1.0 ELSE 0.0 END) AS negative_rate
  FROM post_words GROUP BY word)"""


def english_scored(spark: SparkSession, folder: str) -> DataFrame:
    """English posts with a word-list score."""
    english = posts(spark, folder).filter(F.col("langs") == F.array(F.lit("en")))
    return with_wordlist_score(english, "text", GOOD, POOR)


def gold_series(spark: SparkSession, folder: str, width: str = "10 minutes") -> DataFrame:
    return word_series(english_scored(spark, folder), width=width)


ENGLISH = f"""{POSTS}, english_tokens AS (
  SELECT *, {alpha_sql('text')} AS tokens FROM posts WHERE langs = ['en']), english AS (
  SELECT *, {sentiment_sql('tokens')} AS score FROM english_tokens)"""


def series_sql(width: str = "10 minutes") -> str:
    return f"""{ENGLISH}, used AS (
  SELECT ts, score, unnest({clean_sql('text')}) AS word FROM english), series AS (
  SELECT word, time_bucket(INTERVAL '{width}', ts) AS time_range,
         avg(score) AS avg_vader_sentiment_score, count(*) AS word_count
  FROM used GROUP BY 1, 2)"""


SERIES = series_sql()


def gold_controversy(spark: SparkSession, folder: str, width: str = "10 minutes") -> DataFrame:
    english = posts(spark, folder).filter(F.col("langs") == F.array(F.lit("en")))
    return controversy_series(english, width=width)


def controversy_sql(width: str = "10 minutes") -> str:
    return f"""{POSTS}, disputed AS (
  SELECT ts, like_count::DOUBLE / reply_count AS ratio, unnest({clean_sql('text')}) AS topic_name
  FROM posts WHERE langs = ['en'] AND reply_count >= 50 AND like_count <> 0), topics AS (
  SELECT topic_name, time_bucket(INTERVAL '{width}', ts) AS time_bucket,
         avg(ratio) AS average_like_to_comment_ratio
  FROM disputed GROUP BY 1, 2)"""


def gold_links(spark: SparkSession, folder: str, width: str = "10 minutes") -> DataFrame:
    return crosslink_series(posts(spark, folder), NEEDLE, width=width)


def links_sql(width: str = "10 minutes") -> str:
    return f"""{POSTS}, linking AS (
  SELECT ts, unnest({clean_sql('text')}) AS topic_name
  FROM posts WHERE contains(lower(text), '{NEEDLE}')), crosslinks AS (
  SELECT topic_name, time_bucket(INTERVAL '{width}', ts) AS time_bucket, count(*) AS link_count
  FROM linking WHERE NOT contains(topic_name, '{NEEDLE}') GROUP BY 1, 2)"""


INGESTION = f"""{POSTS}, ingestion AS (
  SELECT time_bucket(INTERVAL '10 minutes', event_time) AS time_bucket, source_type,
         count(*) AS record_count
  FROM (SELECT ts AS event_time, 'firehose' AS source_type FROM events
        UNION ALL SELECT ts, 'getPosts' FROM posts) GROUP BY 1, 2)"""


def day_text(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d')"


def time_text(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def tall(bundle: dict, part: str, label, value):
    """A table of a bundle as rows of part, label and value."""
    return bundle[part].select(
        F.lit(part).alias("part"), label.cast("string").alias("label"),
        value.cast("double").alias("value"))


def stacked(frames):
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole
