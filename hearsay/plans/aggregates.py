"""Registered queries: key figures, words and topics, trends, series."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay.functions.text import tokens_clean
from hearsay.functions.vocab import NEGATIVE_WORDS, POSITIVE_WORDS
from hearsay.operators import insights, kpis, series, trends, words
from hearsay.operators.filters import known_collections, posts_only
from hearsay.operators.snapshots import snapshot_tables
from hearsay.plans.inputs import (
    ALL_FACTS, FACTS, FEED, GOOD, HIGH, INGESTION, LOW, POOR, POSTS, REMARKS, SCORED,
    SERIES, STATS, WORD, alpha_sql, controversy_sql, day_text, english_scored, facts,
    facts_with_comments, feed, forum_posts, gold_controversy, gold_links, gold_series,
    links_sql, posts, remarks, scored, sentiment_sql, series_sql, stacked, table, tall, time_text,
)
from hearsay.plans.registry import add, query


add("post_kpis", "A1", lambda s, d: kpis.post_kpis(facts_with_comments(s, d)), f"""
WITH {ALL_FACTS}
SELECT count(*) FILTER (post_type <> 'comment') AS total_posts,
       count(*) FILTER (post_type = 'comment') AS total_comments,
       round(avg(score), 6) AS avg_score, round(avg(num_comments), 6) AS avg_comments,
       round(sum(engagement), 6) AS total_engagement,
       count(DISTINCT created_date) AS active_days,
       round(sum(engagement) / count(DISTINCT created_date), 6) AS avg_engagement_per_day
FROM all_facts""")

add("daily_posts", "A2", lambda s, d: kpis.daily_posts(facts_with_comments(s, d)), f"""
WITH {ALL_FACTS}
SELECT {day_text('created_date')} AS bucket, count(*) AS count FROM all_facts
WHERE post_type <> 'comment' GROUP BY 1""")

add("daily_series", "A3", lambda s, d: kpis.daily_series(facts_with_comments(s, d)), f"""
WITH {ALL_FACTS}
SELECT {day_text('created_date')} AS bucket, count(*) FILTER (post_type <> 'comment') AS posts,
       round(sum(ups), 6) AS upvotes, count(*) FILTER (post_type = 'comment') AS comments,
       round(sum(engagement), 6) AS total
FROM all_facts GROUP BY 1""")

add("type_split", "A4 F22", lambda s, d: kpis.type_split(facts_with_comments(s, d)), f"""
WITH {ALL_FACTS}
SELECT post_type AS label, count(*) AS value,
       round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM all_facts), 6) AS percent
FROM all_facts GROUP BY 1""")

add("top_keywords", "A5", lambda s, d: words.top_keywords(posts_only(facts(s, d)), "title"), f"""
WITH {FACTS}
SELECT word, count(*) AS count FROM (SELECT unnest({alpha_sql('title')}) AS word FROM facts)
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6""")

add("available_years", "A6", lambda s, d: kpis.available_years(facts(s, d)), f"""
WITH {FACTS} SELECT DISTINCT year FROM facts""")

add("content_split", "A6b", lambda s, d: kpis.content_split(facts_with_comments(s, d)), f"""
WITH {ALL_FACTS}
SELECT count(*) FILTER (post_type <> 'comment') AS posts,
       count(*) FILTER (post_type = 'comment') AS comments,
       round(count(*) FILTER (post_type <> 'comment') * 100.0::DOUBLE / count(*), 6) AS post_percent
FROM all_facts""")

add("comment_kpis", "A7", lambda s, d: kpis.comment_kpis(remarks(s, d)), f"""
WITH {REMARKS}
SELECT count(*) AS total_comments,
       count(*) FILTER (controversiality > 0) AS total_controversial_comments,
       round(avg(ups), 6) AS avg_comment_upvotes, round(avg(downs), 6) AS avg_comment_downvotes,
       round(avg(score), 6) AS avg_comment_score,
       round(count(*) FILTER (controversiality > 0) * 100.0::DOUBLE / count(*), 6)
         AS controversial_percent
FROM remarks""")

add("daily_comments", "A8", lambda s, d: kpis.daily_comments(remarks(s, d)), f"""
WITH {REMARKS}
SELECT {day_text('created_date')} AS bucket, count(*) AS total_comments,
       count(*) FILTER (controversiality > 0) AS controversial_comments,
       count(*) FILTER (controversiality = 0) AS normal_comments
FROM remarks GROUP BY 1""")

add("score_split", "A9 F15", lambda s, d: kpis.score_split(remarks(s, d)), f"""
WITH {REMARKS}
SELECT CASE sign(score) WHEN 1 THEN 'positive' WHEN -1 THEN 'negative' ELSE 'neutral' END AS label,
       count(*) AS value,
       round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM remarks), 6) AS percent
FROM remarks GROUP BY 1""")

add("controversial_split", "A10", lambda s, d: kpis.controversial_split(remarks(s, d)), f"""
WITH {REMARKS}
SELECT l.position, l.label, count(controversiality) AS value,
       round(count(controversiality) * 100.0::DOUBLE / (SELECT count(*) FROM remarks), 6) AS percent
FROM (VALUES (0::BIGINT, 'controversial', true), (1, 'non_controversial', false))
     l(position, label, hot)
LEFT JOIN remarks ON (controversiality > 0) = hot GROUP BY 1, 2""")

add("sentiment_kpis", "A11 F14", lambda s, d: kpis.sentiment_kpis(scored(s, d)), f"""
WITH {SCORED}
SELECT round(avg(sentiment), 6) AS avg_sentiment,
       count(*) FILTER (sentiment > 0) AS positive_posts,
       count(*) FILTER (sentiment < 0) AS negative_posts,
       count(*) FILTER (sentiment = 0) AS neutral_posts FROM scored""")

add("sentiment_timeline", "A12", lambda s, d: kpis.sentiment_timeline(scored(s, d)), f"""
WITH {SCORED}
SELECT {day_text('created_date')} AS bucket,
       count(*) FILTER (sentiment > 0) AS positive_posts,
       count(*) FILTER (sentiment < 0) AS negative_posts,
       count(*) FILTER (sentiment = 0) AS neutral_posts,
       round(avg(sentiment), 6) AS avg_sentiment, count(*) AS total
FROM scored GROUP BY 1""")

add("sentiment_heatmap", "A13 J7", lambda s, d: words.sentiment_heatmap(scored(s, d)), f"""
WITH {SCORED}, topics AS (
  SELECT word FROM post_words GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8)
SELECT t.word AS topic, m.bucket, count(p.word) AS count,
       round(coalesce(avg(p.sentiment), 0), 6) AS avg_sentiment
FROM topics t CROSS JOIN (SELECT DISTINCT strftime(created_date, '%Y-%m') AS bucket FROM scored) m
LEFT JOIN post_words p ON p.word = t.word AND strftime(p.created_date, '%Y-%m') = m.bucket
GROUP BY 1, 2""")

add("controversial_words", "A14 O4 F17",
    lambda s, d: words.controversial_words(scored(s, d)), f"""
WITH {STATS}, pool AS (SELECT * FROM stats ORDER BY mentions DESC, topic LIMIT 12)
SELECT topic, mentions, round(avg_controversy, 6) AS controversy_score FROM pool
ORDER BY round(avg_controversy, 9) DESC, topic LIMIT 8""")

add("best_topics", "A15 F18 W9", lambda s, d: words.best_topics(scored(s, d)), f"""
WITH {STATS}, pool AS (SELECT * FROM stats ORDER BY mentions DESC, topic LIMIT 60),
candidates AS (SELECT * FROM pool WHERE mentions >= 5 AND avg_sentiment > 0),
ranked AS (
  SELECT *, avg_sentiment * 0.55::DOUBLE + avg_engagement / (SELECT coalesce(nullif(
         max(avg_engagement), 0), 1) FROM candidates) * 0.30::DOUBLE
         + positive_rate * 0.15::DOUBLE AS opportunity_score
  FROM candidates)
SELECT topic, mentions, round(avg_sentiment, 6) AS avg_sentiment,
       round(avg_engagement, 6) AS avg_engagement, round(positive_rate, 6) AS positive_rate,
       round(opportunity_score, 6) AS opportunity_score
FROM ranked ORDER BY round(opportunity_score, 9) DESC, topic LIMIT 8""")

add("avoid_topics", "A16", lambda s, d: words.avoid_topics(scored(s, d)), f"""
WITH {STATS}, pool AS (SELECT * FROM stats ORDER BY mentions DESC, topic LIMIT 80),
candidates AS (
  SELECT * FROM pool WHERE mentions >= 5
  AND NOT (avg_sentiment >= 0 AND negative_rate < 0.03 AND avg_controversy < 0.5)),
ranked AS (
  SELECT *, greatest(-avg_sentiment, 0) * 0.45::DOUBLE + negative_rate * 0.30::DOUBLE
         + avg_controversy / (SELECT coalesce(nullif(max(avg_controversy), 0), 1)
                              FROM candidates) * 0.25::DOUBLE AS avoid_score
  FROM candidates)
SELECT topic, mentions, round(avg_sentiment, 6) AS avg_sentiment,
       round(negative_rate, 6) AS negative_rate, round(avg_controversy, 6) AS avg_controversy,
       round(avoid_score, 6) AS avoid_score
FROM ranked ORDER BY round(avoid_score, 9) DESC, topic LIMIT 8""")


def _trend_sql(pool: int) -> str:
    return f"""{SCORED}, pool AS (
  SELECT word FROM post_words GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {pool}),
grid AS (
  SELECT w.word, b.bucket, count(p.word) AS v,
         row_number() OVER (PARTITION BY w.word ORDER BY b.bucket) - 1 AS i
  FROM pool w CROSS JOIN (SELECT DISTINCT created_date AS bucket FROM scored) b
  LEFT JOIN post_words p ON p.word = w.word AND p.created_date = b.bucket
  GROUP BY w.word, b.bucket),
sized AS (
  SELECT *, count(*) OVER (PARTITION BY word) AS n,
         max(v) OVER (PARTITION BY word) AS peak FROM grid),
figures AS (
  SELECT word AS topic, n, peak,
         (n * sum(i * v) - sum(i) * sum(v))::DOUBLE
           / (n * sum(i * i) - sum(i) * sum(i))::DOUBLE AS slope,
         max(v) FILTER (i = n - 1) AS latest, min(i) FILTER (v = peak) AS peak_at,
         (sum(v) FILTER (i >= n - 2))::DOUBLE / 2 AS recent,
         (sum(v) FILTER (i < greatest(1, n // 2)))::DOUBLE / greatest(1, n // 2) AS early,
         (sum(v) FILTER (i >= greatest(1, n // 2)))::DOUBLE
           / greatest(n - greatest(1, n // 2), 1) AS late
  FROM sized GROUP BY word, n, peak),
dying AS (
  SELECT *, CASE WHEN peak > 0 THEN latest::DOUBLE / peak ELSE 0 END AS ratio FROM figures
  WHERE n >= 3 AND peak >= 3 AND peak_at <= n - 3 AND recent <= peak * 0.55::DOUBLE
        AND slope < -0.02::DOUBLE AND late < early * 0.85::DOUBLE)"""


add("trend_figures", "A17 W8", lambda s, d: trends.trend_figures(scored(s, d)).drop("half", "series"), f"""
WITH {_trend_sql(25)}
SELECT topic, n, round(slope, 6) AS slope, peak, latest, peak_at, recent,
       round(early, 6) AS early, round(late, 6) AS late FROM figures""")

add("dying_trends", "A17 O3", lambda s, d: trends.dying_trends(scored(s, d), pool=200), f"""
WITH {_trend_sql(200)}
SELECT topic, round(slope, 6) AS slope, latest, peak, round(ratio, 6) AS saturation_ratio,
       'dying' AS status FROM dying
ORDER BY dying.slope, dying.ratio, topic LIMIT 8""")

add("saturation_timeline", "A18",
    lambda s, d: trends.saturation_timeline(scored(s, d), pool=200), f"""
WITH {_trend_sql(200)}, first_three AS (SELECT * FROM dying ORDER BY slope, ratio, topic LIMIT 3)
SELECT word, {day_text('bucket')} AS bucket, v AS count,
       CAST(sum(v) OVER (PARTITION BY bucket) AS BIGINT) AS total
FROM grid SEMI JOIN first_three ON word = topic""")

add("word_timeline_top", "A18 J7", lambda s, d: trends.word_timeline(scored(s, d)), f"""
WITH {_trend_sql(5)}
SELECT word, {day_text('bucket')} AS bucket, v AS count,
       CAST(sum(v) OVER (PARTITION BY bucket) AS BIGINT) AS total FROM grid""")

add("word_timeline_one", "A18", lambda s, d: trends.word_timeline(scored(s, d), " Tion "), f"""
WITH {SCORED}
SELECT 'tion' AS word, {day_text('created_date')} AS bucket,
       count(*) FILTER (list_contains(tokens, 'tion')) AS count,
       count(*) FILTER (list_contains(tokens, 'tion')) AS total
FROM scored GROUP BY 2""")

add("event_overview", "A19",
    lambda s, d: kpis.event_overview(known_collections(feed(s, d)), "ts"), f"""
WITH {FEED}
SELECT count(*) FILTER (event_type = 'view') AS total_posts,
       count(*) FILTER (event_type = 'click') AS total_likes,
       count(*) FILTER (event_type = 'purchase') AS total_follows,
       count(*) AS total_engagement, count(DISTINCT CAST(ts AS DATE)) AS active_days,
       round(count(*)::DOUBLE / count(DISTINCT CAST(ts AS DATE)), 6) AS avg_engagement_per_day
FROM feed WHERE event_type IN ('view', 'click', 'purchase')""")

add("event_daily", "A20",
    lambda s, d: kpis.event_daily(known_collections(feed(s, d)), "ts"), f"""
WITH {FEED}
SELECT {day_text('ts')} AS bucket, count(*) FILTER (event_type = 'view') AS posts,
       count(*) FILTER (event_type = 'click') AS likes,
       count(*) FILTER (event_type = 'purchase') AS follows, count(*) AS total
FROM feed WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1""")

add("posts_per_word", "A22 F3 O1", lambda s, d: words.posts_per_word(posts(s, d), "text"), f"""
WITH {POSTS}
SELECT word, count(*) AS posts FROM (
  SELECT unnest(list_distinct(list_filter(
    string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> ''))) AS word FROM posts)
GROUP BY 1""")

add("word_controversy", "A23 F13",
    lambda s, d: words.word_controversy(posts(s, d), "text", "like_count", "reply_count"), f"""
WITH {POSTS}, used AS (
  SELECT CASE WHEN reply_count = 0 THEN 0 ELSE like_count::DOUBLE / reply_count END AS ratio,
         unnest(list_distinct(list_filter(
    string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> ''))) AS word FROM posts)
SELECT word, round(avg(ratio), 9) AS avg_like_to_comment_ratio FROM used GROUP BY 1""", digits=9)

add("count_by_langs", "A24 F11",
    lambda s, d: kpis.count_by(posts(s, d), "langs", "langs").select(
        F.array_join("langs", ",").alias("langs"), "count"), f"""
WITH {POSTS} SELECT array_to_string(langs, ',') AS langs, count(*) AS count FROM posts GROUP BY langs""")

add("count_by_collection", "A24",
    lambda s, d: kpis.count_by(feed(s, d), "commit.collection", "collection"), f"""
WITH {FEED} SELECT collection, count(*) AS count FROM feed GROUP BY 1""")

add("texts_by_author", "A25",
    lambda s, d: kpis.texts_by_author(posts(s, d), "did", "text", "post_id", per_part=2).select(
        "did", "part", F.size("texts").alias("n_texts"),
        F.md5(F.array_join("texts", "\n")).alias("digest")), f"""
WITH {POSTS}
SELECT did, part, count(*) AS n_texts,
       md5(string_agg(text, chr(10) ORDER BY post_id)) AS digest
FROM (SELECT *, (row_number() OVER (PARTITION BY did ORDER BY post_id) - 1) // 2 AS part FROM posts)
GROUP BY did, part""")

add("mention_split", "A26", lambda s, d: kpis.mention_split(posts(s, d), "text", WORD), f"""
WITH {POSTS}
SELECT list_contains(string_split(text, ' '), '{WORD}') AS has_word, count(*) AS count
FROM posts GROUP BY 1""")

add("pivot_average", "A27",
    lambda s, d: posts(s, d).groupBy("source").pivot("lang", ["en", "fr", "de", "es"]).agg(
        F.avg("like_count")), f"""
WITH {POSTS}
SELECT source, round(avg(like_count) FILTER (lang = 'en'), 6) AS en,
       round(avg(like_count) FILTER (lang = 'fr'), 6) AS fr,
       round(avg(like_count) FILTER (lang = 'de'), 6) AS de,
       round(avg(like_count) FILTER (lang = 'es'), 6) AS es
FROM posts GROUP BY 1""")


def _ingestion(s, d):
    return series.ingestion_metrics(
        series.labelled(table(s, d, "events"), "ts", "firehose"),
        series.labelled(posts(s, d), "ts", "getPosts"),
    )


add("ingestion_metrics", "T3 U1", _ingestion, f"""
WITH {INGESTION}
SELECT {time_text('time_bucket')} AS time_bucket, source_type, record_count FROM ingestion""")

add("ingestion_stats", "A28", lambda s, d: series.ingestion_stats(_ingestion(s, d), LOW, HIGH), f"""
WITH {INGESTION}
SELECT {time_text('time_bucket')} AS time_bucket, source_type,
       CAST(sum(record_count) AS BIGINT) AS record_count
FROM ingestion WHERE time_bucket BETWEEN '{LOW}' AND '{HIGH}' GROUP BY 1, 2""")

add("word_series_10m", "T1", gold_series, f"""
WITH {SERIES}
SELECT word, {time_text('time_range')} AS time_range,
       round(avg_vader_sentiment_score, 6) AS avg_vader_sentiment_score, word_count FROM series""")

add("word_series_2h", "T2", lambda s, d: gold_series(s, d, "2 hours"), f"""
WITH {series_sql('2 hours')}
SELECT word, {time_text('time_range')} AS time_range,
       round(avg_vader_sentiment_score, 6) AS avg_vader_sentiment_score, word_count FROM series""")

add("word_series_occurrences", "T1 F4",
    lambda s, d: series.word_series(
        english_scored(s, d), width="1 day", tokenizer="ws", count="occurrences", lower=False), f"""
WITH {POSTS}, english_tokens AS (
  SELECT *, {alpha_sql('text')} AS tokens FROM posts WHERE langs = ['en']), used AS (
  SELECT ts, {sentiment_sql('tokens')} AS score, unnest(list_filter(
    string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> '')) AS word
  FROM english_tokens)
SELECT word, {time_text("time_bucket(INTERVAL '1 day', ts)")} AS time_range,
       round(avg(score), 6) AS avg_vader_sentiment_score, count(*) AS word_count
FROM used GROUP BY 1, 2""")

add("controversy_series", "T4 P13", gold_controversy, f"""
WITH {controversy_sql()}
SELECT topic_name, {time_text('time_bucket')} AS time_bucket,
       round(average_like_to_comment_ratio, 9) AS average_like_to_comment_ratio FROM topics""", digits=9)

add("crosslink_series", "T5 P10", gold_links, f"""
WITH {links_sql()}
SELECT topic_name, {time_text('time_bucket')} AS time_bucket, link_count FROM crosslinks""")

add("word_sentiment", "A29 P9",
    lambda s, d: series.word_sentiment(gold_series(s, d), "Thing", LOW, HIGH), f"""
WITH {SERIES}
SELECT {time_text('time_range')} AS time_range,
       round(avg(avg_vader_sentiment_score), 6) AS sentiment_score
FROM series WHERE lower(word) = 'thing' AND time_range BETWEEN '{LOW}' AND '{HIGH}' GROUP BY 1""")

add("popular_words", "A30 J3", lambda s, d: series.popular_words(gold_series(s, d), 10, LOW, HIGH), f"""
WITH {SERIES}, top AS (
  SELECT word, sum(word_count) AS total_count FROM series
  WHERE time_range BETWEEN '{LOW}' AND '{HIGH}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT word, CAST(any_value(total_count) AS BIGINT) AS total_count,
       {time_text('time_range')} AS time_range, CAST(sum(word_count) AS BIGINT) AS popularity
FROM series JOIN top USING (word) WHERE time_range BETWEEN '{LOW}' AND '{HIGH}'
GROUP BY word, time_range""")

add("word_popularity", "A31",
    lambda s, d: series.word_popularity(gold_series(s, d), WORD, LOW, HIGH), f"""
WITH {SERIES}
SELECT {time_text('time_range')} AS time_range, CAST(sum(word_count) AS BIGINT) AS word_count
FROM series WHERE lower(word) = '{WORD}' AND time_range BETWEEN '{LOW}' AND '{HIGH}' GROUP BY 1""")

add("declining_words", "A32 F34",
    lambda s, d: trends.declining_words(gold_series(s, d, "1 day"), 10, LOW, HIGH).withColumn(
        "slope", F.col("slope") * 1e6), f"""
WITH {series_sql('1 day')}, sums AS (
  SELECT word, count(*)::HUGEINT AS n, sum(epoch(time_range)::HUGEINT) AS sx,
         sum(word_count)::HUGEINT AS sy, sum(epoch(time_range)::HUGEINT * word_count) AS sxy,
         sum(epoch(time_range)::HUGEINT * epoch(time_range)::HUGEINT) AS sxx
  FROM series GROUP BY 1), steepest AS (
  SELECT word, (n * sxy - sx * sy)::DOUBLE / nullif(n * sxx - sx * sx, 0)::DOUBLE AS slope
  FROM sums ORDER BY slope ASC NULLS LAST, word LIMIT 10)
SELECT word, round(any_value(slope) * 1e6, 6) AS slope, {time_text('time_range')} AS time_range,
       CAST(sum(word_count) AS BIGINT) AS word_count
FROM series JOIN steepest USING (word) GROUP BY word, time_range""")

add("cross_topics", "A33", lambda s, d: series.cross_topics(gold_links(s, d), 10), f"""
WITH {links_sql()}
SELECT topic_name, CAST(sum(link_count) AS BIGINT) AS links FROM crosslinks
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")

add("word_controversy_series", "A34",
    lambda s, d: series.word_controversy_series(gold_controversy(s, d), "Tion", LOW, HIGH), f"""
WITH {controversy_sql()}
SELECT {time_text('time_bucket')} AS time_bucket,
       round(average_like_to_comment_ratio, 9) AS average_like_to_comment_ratio
FROM topics WHERE lower(topic_name) = 'tion'""", digits=9)

_RANKED = f"""{controversy_sql('1 day')}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY time_bucket
           ORDER BY round(average_like_to_comment_ratio, 9) DESC, topic_name) AS rn FROM topics)"""

add("top_topics_per_day", "W1",
    lambda s, d: series.top_per_bucket(gold_controversy(s, d, "1 day"), 5, LOW, HIGH), f"""
WITH {_RANKED}
SELECT topic_name, {time_text('time_bucket')} AS time_bucket,
       round(average_like_to_comment_ratio, 9) AS average_like_to_comment_ratio, rn
FROM ranked WHERE rn <= 5""", digits=9)

add("range_controversy", "A35",
    lambda s, d: series.range_controversy(gold_controversy(s, d, "1 day"), 10), f"""
WITH {_RANKED}
SELECT topic_name, round(avg(average_like_to_comment_ratio), 9) AS value
FROM ranked WHERE rn <= 10 GROUP BY 1
ORDER BY round(avg(average_like_to_comment_ratio), 9) DESC, topic_name LIMIT 10""", digits=9)

for _grain in ("month", "week"):
    add(f"rollup_{_grain}", "A36",
        lambda s, d, grain=_grain: series.rollup_series(
            kpis.daily_series(facts_with_comments(s, d)), "bucket",
            ["posts", "upvotes", "comments", "total"], grain), f"""
WITH {ALL_FACTS}
SELECT {day_text(f"date_trunc('{_grain}', created_date)")} AS {_grain},
       count(*) FILTER (post_type <> 'comment') AS posts, round(sum(ups), 6) AS upvotes,
       count(*) FILTER (post_type = 'comment') AS comments, round(sum(engagement), 6) AS total
FROM all_facts GROUP BY 1""")

add("word_sentiment_avg", "A37b",
    lambda s, d: words.word_sentiment_avg(
        english_scored(s, d), tokens_clean("text"), "score"), f"""
WITH {SERIES} SELECT word, round(avg(score), 6) AS avg_sentiment FROM used GROUP BY 1""")

add("distinct_authors", "A38",
    lambda s, d: posts(s, d).select("did", "lang").distinct().groupBy("lang").agg(
        F.countDistinct("did").alias("authors")), f"""
WITH {POSTS} SELECT lang, count(DISTINCT did) AS authors FROM posts GROUP BY 1""")


@query("snapshot_tables", "S21 F8", f"""
WITH {ALL_FACTS}, tokenized AS (
  SELECT *, {alpha_sql('title')} AS tokens FROM facts), keywords AS (
  SELECT word AS label, count(*) AS value, row_number() OVER (ORDER BY count(*) DESC, word) AS rank
  FROM (SELECT unnest(tokens) AS word FROM tokenized) GROUP BY 1)
SELECT 'kpis' AS report, 'total_content' AS label, count(*)::DOUBLE AS value, 7::BIGINT AS run_id
FROM all_facts
UNION ALL SELECT 'kpis', 'total_posts', count(*) FILTER (post_type <> 'comment'), 7 FROM all_facts
UNION ALL SELECT 'kpis', 'avg_sentiment', round(avg({sentiment_sql('tokens', POSITIVE_WORDS, NEGATIVE_WORDS)}), 6), 7 FROM tokenized
UNION ALL SELECT 'kpis', 'avg_score', round(avg(score), 6), 7 FROM all_facts
UNION ALL SELECT 'kpis', 'avg_comments', round(avg(num_comments), 6), 7 FROM all_facts
UNION ALL SELECT 'content_split', 'posts', count(*) FILTER (post_type <> 'comment'), 7 FROM all_facts
UNION ALL SELECT 'content_split', 'comments', count(*) FILTER (post_type = 'comment'), 7 FROM all_facts
UNION ALL SELECT 'top_keywords', label, value, 7 FROM keywords WHERE rank <= 10
UNION ALL SELECT 'timeline', {day_text('created_date')}, count(*), 7 FROM all_facts
          WHERE post_type <> 'comment' GROUP BY 2""")
def _snapshots(s, d):
    tables = snapshot_tables(facts_with_comments(s, d), 7)

    def tall(name, *columns):
        pairs = F.array(
            *[F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("value"))
              for c in columns]
        )
        return tables[name].select(F.lit(name).alias("report"), F.inline(pairs), "run_id")

    return (
        tall("kpis", "total_content", "total_posts", "avg_sentiment", "avg_score", "avg_comments")
        .unionByName(tall("content_split", "posts", "comments"))
        .unionByName(tables["top_keywords"].select(
            F.lit("top_keywords").alias("report"), "label",
            F.col("value").cast("double").alias("value"), "run_id"))
        .unionByName(tables["timeline"].select(
            F.lit("timeline").alias("report"), F.date_format("bucket", "yyyy-MM-dd").alias("label"),
            F.col("count").cast("double").alias("value"), "run_id"))
    )


@query("forum_overview", "A1 A2 A3 A4 A5 A6 A6b", f"""
WITH {ALL_FACTS}, chosen AS (SELECT * FROM all_facts WHERE month IN (1, 2, 3, 7))
SELECT 'available_years' AS part, CAST(year AS VARCHAR) AS label, year::DOUBLE AS value
FROM (SELECT DISTINCT year FROM all_facts)
UNION ALL SELECT 'kpis', 'total_posts', count(*) FILTER (post_type <> 'comment') FROM chosen
UNION ALL SELECT 'content_split', 'comments', count(*) FILTER (post_type = 'comment') FROM chosen
UNION ALL SELECT 'post_type_split', post_type, count(*) FROM chosen GROUP BY 2
UNION ALL (SELECT 'top_keywords', word, count(*) FROM (
  SELECT unnest({alpha_sql('title')}) AS word FROM chosen WHERE post_type <> 'comment')
  GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 6)
UNION ALL SELECT 'timeline', {day_text('created_date')}, count(*) FROM chosen
          WHERE post_type <> 'comment' GROUP BY 2
UNION ALL SELECT 'timeline_series', {day_text('created_date')}, round(sum(engagement), 6)
          FROM chosen GROUP BY 2""")
def _forum_overview(s, d):
    bundle = insights.forum_overview(facts_with_comments(s, d), "overall", "1,2,3,7")
    day = F.date_format("bucket", "yyyy-MM-dd")
    return stacked([
        tall(bundle, "available_years", F.col("year"), F.col("year")),
        tall(bundle, "kpis", F.lit("total_posts"), F.col("total_posts")),
        tall(bundle, "content_split", F.lit("comments"), F.col("comments")),
        tall(bundle, "post_type_split", F.col("label"), F.col("value")),
        tall(bundle, "top_keywords", F.col("word"), F.col("count")),
        tall(bundle, "timeline", day, F.col("count")),
        tall(bundle, "timeline_series", day, F.col("total")),
    ])


@query("comments_overview", "A6 A7 A8 A9 A10", f"""
WITH {REMARKS}, chosen AS (SELECT * FROM remarks WHERE month IN (2, 4, 6, 8))
SELECT 'available_years' AS part, CAST(year AS VARCHAR) AS label, year::DOUBLE AS value
FROM (SELECT DISTINCT year FROM remarks)
UNION ALL SELECT 'kpis', 'total_comments', count(*) FROM chosen
UNION ALL SELECT 'timeline_series', {day_text('created_date')},
          count(*) FILTER (controversiality > 0) FROM chosen GROUP BY 2
UNION ALL SELECT 'controversial_split', 'controversial', count(*) FILTER (controversiality > 0)
          FROM chosen
UNION ALL SELECT 'score_split',
          CASE sign(score) WHEN 1 THEN 'positive' WHEN -1 THEN 'negative' ELSE 'neutral' END, count(*)
          FROM chosen GROUP BY 2""")
def _comments_overview(s, d):
    bundle = insights.comments_overview(remarks(s, d), "overall", "2,4,6,8")
    return stacked([
        tall(bundle, "available_years", F.col("year"), F.col("year")),
        tall(bundle, "kpis", F.lit("total_comments"), F.col("total_comments")),
        tall(bundle, "timeline_series", F.date_format("bucket", "yyyy-MM-dd"),
              F.col("controversial_comments")),
        tall(bundle, "controversial_split", F.col("label"), F.col("value")).filter(
            F.col("label") == "controversial"),
        tall(bundle, "score_split", F.col("label"), F.col("value")),
    ])


add("top_communities", "S21",
    lambda s, d: snapshot_tables(
        facts(s, d).join(
            forum_posts(s, d).select(F.col("id").alias("post_id"), "subreddit"), "post_id"),
        7, "subreddit")["top_communities"], f"""
WITH {POSTS}
SELECT row_number() OVER (ORDER BY count(*) DESC, source) AS rank, source AS label,
       count(*) AS value, 7::BIGINT AS run_id
FROM posts GROUP BY source ORDER BY count(*) DESC, source LIMIT 10""")


@query("feature_insights", "A11 A12 A13 A14 A15 A16 A17 A18", f"""
WITH {_trend_sql(25)}, stats AS (
  SELECT word AS topic, count(*) AS mentions, avg(sentiment) AS avg_sentiment,
         avg(ups + num_comments + greatest(score, 0)) AS avg_engagement,
         avg(num_comments / (abs(score) + 1)) AS avg_controversy,
         avg(CASE WHEN sentiment > 0 THEN 1.0 ELSE 0.0 END) AS positive_rate,
         avg(CASE WHEN sentiment < 0 THEN 1.0 ELSE 0.0 END) AS negative_rate
  FROM post_words GROUP BY word),
hot AS (SELECT * FROM (SELECT * FROM stats ORDER BY mentions DESC, topic LIMIT 12)
        ORDER BY round(avg_controversy, 9) DESC, topic LIMIT 8),
chances AS (SELECT * FROM (SELECT * FROM stats ORDER BY mentions DESC, topic LIMIT 60)
            WHERE mentions >= 5 AND avg_sentiment > 0),
best AS (SELECT topic, avg_sentiment * 0.55::DOUBLE + avg_engagement / (SELECT coalesce(nullif(
           max(avg_engagement), 0), 1) FROM chances) * 0.30::DOUBLE + positive_rate * 0.15::DOUBLE
           AS score FROM chances),
risks AS (SELECT * FROM (SELECT * FROM stats ORDER BY mentions DESC, topic LIMIT 80)
          WHERE mentions >= 5
          AND NOT (avg_sentiment >= 0 AND negative_rate < 0.03 AND avg_controversy < 0.5)),
shun AS (SELECT topic, greatest(-avg_sentiment, 0) * 0.45::DOUBLE + negative_rate * 0.30::DOUBLE
           + avg_controversy / (SELECT coalesce(nullif(max(avg_controversy), 0), 1) FROM risks)
           * 0.25::DOUBLE AS score FROM risks)
SELECT 'controversial_topics' AS part, topic AS label, round(avg_controversy, 6) AS value FROM hot
UNION ALL SELECT 'best_topics_to_post', topic, round(score, 6) FROM (
  SELECT * FROM best ORDER BY round(score, 9) DESC, topic LIMIT 8)
UNION ALL SELECT 'topics_to_avoid', topic, round(score, 6) FROM (
  SELECT * FROM shun ORDER BY round(score, 9) DESC, topic LIMIT 8)
UNION ALL SELECT 'trend_summary', topic, round(slope, 6) FROM (
  SELECT * FROM dying ORDER BY slope, ratio, topic LIMIT 8)
UNION ALL SELECT 'sentiment_kpis', 'avg_sentiment', round(avg(sentiment), 6) FROM scored
UNION ALL SELECT 'sentiment_timeline', {day_text('created_date')}, round(avg(sentiment), 6)
FROM scored GROUP BY 2
UNION ALL SELECT 'word_popularity', word, sum(v) FROM (
  SELECT word, v FROM grid WHERE word IN (
    SELECT word FROM post_words GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)) GROUP BY 2
UNION ALL SELECT 'topic_sentiment_heatmap', word, round(avg(sentiment), 6) FROM post_words
WHERE word IN (SELECT word FROM post_words GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8)
GROUP BY 2""")
def _insights(s, d):
    """Parts of the report as rows; the tables hold one month, so the heat map has one
    column per topic."""
    report = insights.feature_insights(facts(s, d), positive=GOOD, negative=POOR)

    def rows(part, label, value):
        return report[part].select(
            F.lit(part).alias("part"), label.alias("label"), value.cast("double").alias("value"))

    topic = F.col("topic")
    popular = report["word_popularity"].groupBy("word").agg(F.sum("count").alias("count"))
    parts = [
        rows("controversial_topics", topic, F.col("controversy_score")),
        rows("best_topics_to_post", topic, F.col("opportunity_score")),
        rows("topics_to_avoid", topic, F.col("avoid_score")),
        rows("trend_summary", topic, F.col("slope")),
        rows("sentiment_kpis", F.lit("avg_sentiment"), F.col("avg_sentiment")),
        rows("sentiment_timeline", F.date_format("bucket", "yyyy-MM-dd"), F.col("avg_sentiment")),
        popular.select(F.lit("word_popularity").alias("part"), F.col("word").alias("label"),
                       F.col("count").cast("double").alias("value")),
        rows("topic_sentiment_heatmap", topic, F.col("avg_sentiment")),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
