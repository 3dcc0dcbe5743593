"""Registered queries: row functions and filters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hearsay.functions import media, scores, text, times, values
from hearsay.functions.vocab import (
    IMAGE_MARKS, NAMESPACE_URL, POST_COLLECTION, VIDEO_MARKS, default_stopwords,
)
from hearsay.operators import filters, insights
from hearsay.operators.facts import comment_facts, post_facts
from hearsay.operators.ranks import scale_minmax, share
from hearsay.operators.kpis import media_split
from hearsay.plans.inputs import (
    ALL_FACTS, FACTS, FEED, GOOD, POOR, POSTS, REMARKS, alpha_sql, clean_sql, day_text,
    facts, facts_with_comments, feed, forum_comments, forum_posts, posts, remarks, rows_of,
    sentiment_sql, sql_list, stacked, table, tall, time_text,
)
from hearsay.plans.registry import add, query

BLANKS_SQL = "[ \\t\\n\\x0B\\f\\r]+"


def _digest(tokens):
    """Token lists as count and hash: whole texts are compared, results stay small."""
    return F.size(tokens).alias("n"), F.md5(F.array_join(tokens, " ")).alias("digest")


def _digest_sql(tokens: str) -> str:
    return f"CAST(len({tokens}) AS BIGINT) AS n, md5(array_to_string({tokens}, ' ')) AS digest"


# Tokenizers -------------------------------------------------------------------------------

add("tokens_ws", "F3 P21",
    lambda s, d: posts(s, d).select("post_id", *_digest(F.array_sort(text.tokens_ws("text")))), f"""
WITH {POSTS}, t AS (SELECT post_id, list_sort(list_distinct(list_filter(string_split_regex(
  lower(text), '{BLANKS_SQL}'), lambda t: t <> ''))) AS tokens FROM posts)
SELECT post_id, {_digest_sql('tokens')} FROM t""")

add("tokens_ws_repeated", "F4",
    lambda s, d: posts(s, d).select(
        "post_id", *_digest(text.tokens_ws("text", unique=False, lower=False))), f"""
WITH {POSTS}, t AS (SELECT post_id, list_filter(string_split_regex(
  text, '{BLANKS_SQL}'), lambda t: t <> '') AS tokens FROM posts)
SELECT post_id, {_digest_sql('tokens')} FROM t""")

add("tokens_clean", "F5 J2",
    lambda s, d: posts(s, d).select(
        "post_id", *_digest(text.tokens_clean("text", unique=False))), f"""
WITH {POSTS}, t AS (SELECT post_id, {clean_sql('text', False)} AS tokens FROM posts)
SELECT post_id, {_digest_sql('tokens')} FROM t""")

add("tokens_alpha", "F6 J2",
    lambda s, d: posts(s, d).select("post_id", *_digest(text.tokens_alpha("text"))), f"""
WITH {POSTS}, t AS (SELECT post_id, {alpha_sql('text')} AS tokens FROM posts)
SELECT post_id, {_digest_sql('tokens')} FROM t""")

add("sentence_words", "F7",
    lambda s, d: posts(s, d).select("post_id", *_digest(text.sentence_words("text"))), f"""
WITH {POSTS}, t AS (SELECT post_id, list_transform(list_filter(string_split_regex(
  text, '{BLANKS_SQL}'), lambda t: t <> ''),
  lambda t: lower(trim(t, '.,!?;:()[]{{}}"'''))) AS tokens FROM posts)
SELECT post_id, {_digest_sql('tokens')} FROM t""")

add("stopword_uses", "F8 P14",
    lambda s, d: posts(s, d).select(F.explode(text.tokens_clean("text", [], False)).alias("word"))
    .filter(F.col("word").isin(default_stopwords())).groupBy("word")
    .agg(F.count(F.lit(1)).alias("uses")), f"""
WITH {POSTS}, used AS (SELECT unnest(regexp_extract_all(lower(regexp_replace(text,
  '[^a-zA-Z0-9]+', ' ', 'g')), '\\b[a-z][a-z0-9]+\\b')) AS word FROM posts)
SELECT word, count(*) AS uses FROM used WHERE word IN {sql_list(default_stopwords())} GROUP BY 1""")

add("drop_stopwords", "P14",
    lambda s, d: filters.drop_stopwords(
        posts(s, d).select(F.explode(text.tokens_clean("text", [])).alias("word")),
        "word", default_stopwords()).groupBy("word").agg(F.count(F.lit(1)).alias("posts")), f"""
WITH {POSTS}, used AS (SELECT unnest({clean_sql('text')}) AS word FROM posts)
SELECT word, count(*) AS posts FROM used GROUP BY 1""")

# Text ---------------------------------------------------------------------------------------

add("string_functions", "F9 X6",
    lambda s, d: posts(s, d).select(
        "post_id",
        F.upper("source").alias("upper_source"),
        F.lower(F.upper("lang")).alias("lower_lang"),
        F.initcap("source").alias("initcap_source"),
        F.col("text").contains("the").alias("has_the"),
        F.col("text").startswith("The").alias("starts_the"),
        F.split("text", " ").getItem(0).alias("first_word"),
        F.concat("source", F.lit("hello")).alias("greeted"),
        F.length("text").alias("length"),
        F.md5(F.replace("text", F.lit(" "), F.lit(""))).alias("packed")), f"""
WITH {POSTS}
SELECT post_id, upper(source) AS upper_source, lower(lang) AS lower_lang,
       upper(source[1]) || source[2:] AS initcap_source, contains(text, 'the') AS has_the,
       starts_with(text, 'The') AS starts_the, string_split(text, ' ')[1] AS first_word,
       source || 'hello' AS greeted, length(text) AS length, md5(replace(text, ' ', '')) AS packed
FROM posts""")

add("scrub_nul", "F10",
    lambda s, d: posts(s, d).select(
        "post_id", F.md5(text.scrub_nul(F.concat("text", F.lit("\u0000"), "source"))).alias(
            "digest")), f"""
WITH {POSTS} SELECT post_id, md5(text || source) AS digest FROM posts""")

add("langs_exploded", "F11 P2 P3",
    lambda s, d: posts(s, d).select("post_id", "langs", F.explode("langs").alias("lang")).select(
        "post_id", "lang", text.lang_any("langs", "fr").alias("any_fr"),
        text.lang_only("langs", "de").alias("only_de")), f"""
WITH {POSTS} SELECT post_id, lang, lang = 'fr' AS any_fr, lang = 'de' AS only_de FROM posts""")

add("first_text", "F33",
    lambda s, d: posts(s, d).select(
        "post_id", F.md5(text.first_text(
            F.when(F.col("lang") == "fr", F.col("text")), F.when(F.col("lang") == "de", "none"),
            "source")).alias("digest")), f"""
WITH {POSTS}
SELECT post_id, md5(CASE lang WHEN 'fr' THEN text WHEN 'de' THEN 'none' ELSE source END) AS digest
FROM posts""")

add("word_match", "P9",
    lambda s, d: posts(s, d).filter(text.word_eq("lang", "EN")).groupBy("lang").agg(
        F.count(F.lit(1)).alias("posts")), f"""
WITH {POSTS} SELECT lang, count(*) AS posts FROM posts WHERE lower(lang) = 'en' GROUP BY 1""")

add("mentions", "P10",
    lambda s, d: posts(s, d).filter(text.mentions("text", "EXAMPLE.")).select("post_id"), f"""
WITH {POSTS} SELECT post_id FROM posts WHERE contains(lower(text), 'example.')""")

add("mentions_exact_case", "P10",
    lambda s, d: posts(s, d).filter(text.mentions("text", "The", False)).select("post_id"), f"""
WITH {POSTS} SELECT post_id FROM posts WHERE contains(text, 'The')""")

add("link_tokens", "P11",
    lambda s, d: filters.link_tokens(
        table(s, d, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("text")),
        "text", "https://").select("page_id", "token"), f"""
SELECT page_id, unnest(list_distinct(list_filter(string_split_regex(
  lower(url || ' ' || html), '{BLANKS_SQL}'), lambda t: starts_with(t, 'https://')))) AS token
FROM pages""")

add("hashtags", "P12",
    lambda s, d: filters.hashtags(
        posts(s, d).withColumn("text", F.concat_ws(" #", "text", "source", "lang")), "text"
    ).groupBy("token").agg(
        F.count(F.lit(1)).alias("posts")), f"""
WITH {POSTS}, t AS (SELECT unnest(list_distinct(list_filter(string_split_regex(
  lower(text || ' #' || source || ' #' || lang), '{BLANKS_SQL}'),
  lambda t: starts_with(t, '#')))) AS token FROM posts)
SELECT token, count(*) AS posts FROM t GROUP BY 1""")

add("long_texts", "P16",
    lambda s, d: filters.min_len(posts(s, d), "text", 400).select("post_id"), f"""
WITH {POSTS}
SELECT post_id FROM posts WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 400""")

# Languages, feeds, calendars -----------------------------------------------------------------

add("lang_any", "P2",
    lambda s, d: posts(s, d).filter(text.lang_any("langs", "en")).select("post_id"), f"""
WITH {POSTS} SELECT post_id FROM posts WHERE list_contains(langs, 'en')""")

add("lang_only", "P3",
    lambda s, d: posts(s, d).filter(text.lang_only("langs", "en")).select("post_id"), f"""
WITH {POSTS} SELECT post_id FROM posts WHERE langs = ['en']""")

add("lang_raw", "P4",
    lambda s, d: posts(s, d).filter(text.lang_raw(F.to_json("langs"), "en")).select("post_id"), f"""
WITH {POSTS} SELECT post_id FROM posts WHERE contains(CAST(to_json(langs) AS VARCHAR), '"en"')""")

add("created_posts", "P1",
    lambda s, d: filters.created_posts(feed(s, d)).select("event_id", "did"), f"""
WITH {FEED} SELECT event_id, did FROM feed
WHERE collection = '{POST_COLLECTION}' AND operation = 'create'""")

add("known_collections", "P5",
    lambda s, d: filters.known_collections(feed(s, d)).select("event_id", "collection"), f"""
WITH {FEED} SELECT event_id, collection FROM feed
WHERE event_type IN ('view', 'click', 'purchase')""")

add("valid_year", "P6",
    lambda s, d: filters.valid_year(
        table(s, d, "orders"), "o_orderdate", 1996, 1997).select("o_orderkey"), """
SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1997""")

add("calendar_filter", "P7",
    lambda s, d: filters.calendar_filter(
        table(s, d, "orders").select(
            "o_orderkey", F.year("o_orderdate").alias("year"),
            F.month("o_orderdate").alias("month")), 1997, "3,1,3").select("o_orderkey"), """
SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1997 AND month(o_orderdate) IN (1, 3)""")

add("between_times", "P8",
    lambda s, d: filters.between_ts(
        table(s, d, "events"), "ts", "2024-01-05 00:00:00", "2024-01-20 00:00:00").select(
        "event_id"), """
SELECT event_id FROM events WHERE ts BETWEEN '2024-01-05' AND '2024-01-20'""")

add("controversial_posts", "P13 F13 X1",
    lambda s, d: filters.controversial(posts(s, d)).select("post_id", "like_to_comment_ratio"), f"""
WITH {POSTS}
SELECT post_id, round(like_count::DOUBLE / reply_count, 6) AS like_to_comment_ratio
FROM posts WHERE reply_count >= 50 AND like_count <> 0""")

add("null_handling", "P15",
    lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").select(
        "doc_id", F.coalesce("toxic", F.lit(-1)).alias("toxic"),
        F.col("quality").isNull().alias("unlabelled"),
        F.col("quality").isNotNull().alias("labelled"), "quality")
    .fillna(0, subset=["quality"]), """
SELECT doc_id, CAST(coalesce(toxic, -1) AS BIGINT) AS toxic, quality IS NULL AS unlabelled,
       quality IS NOT NULL AS labelled, CAST(coalesce(quality, 0) AS BIGINT) AS quality
FROM documents LEFT JOIN labels USING (doc_id)""")

add("dropped_nulls", "P15",
    lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").dropna(
        subset=["toxic"]).select("doc_id", "toxic"), """
SELECT doc_id, CAST(toxic AS BIGINT) AS toxic FROM documents JOIN labels USING (doc_id)""")


def _threads(s, d):
    """Turns with the URI of the thread root: missing, malformed or whole."""
    role = F.col("role")
    whole = F.concat(F.lit("at://"), "conv_id", F.lit("/post/"), "turn")
    uri = F.when(role == "system", "at://x").when(F.col("turn") > 0, whole)
    return table(s, d, "conversations").select(
        F.col("conv_id").cast("string").alias("did"), "turn", uri.alias("root_uri")
    )


_THREADS = """threads AS (
  SELECT CAST(conv_id AS VARCHAR) AS did, turn, CASE WHEN role = 'system' THEN 'at://x'
         WHEN turn > 0 THEN 'at://' || conv_id || '/post/' || turn END AS root_uri
  FROM conversations), rooted AS (
  SELECT did, turn, CASE WHEN root_uri IS NULL THEN 'none_error'
         WHEN strpos(substr(root_uri, 6), '/') > 0 THEN split_part(substr(root_uri, 6), '/', 1)
         ELSE 'error' END AS root_id FROM threads)"""

add("root_authors", "F2 X2",
    lambda s, d: _threads(s, d).select("did", "turn", values.root_author("root_uri").alias("root_id")),
    f"WITH {_THREADS} SELECT did, turn, root_id FROM rooted")

add("thread_roots", "P18",
    lambda s, d: filters.split_roots(_threads(s, d), "root_uri")[0].select("did", "turn"),
    f"WITH {_THREADS} SELECT did, turn FROM rooted WHERE root_id = 'none_error'")

add("self_replies", "P18 P19",
    lambda s, d: filters.self_replies(
        filters.split_roots(_threads(s, d), "root_uri")[1]).select("did", "turn"),
    f"WITH {_THREADS} SELECT did, turn FROM rooted WHERE did = root_id")

add("posts_only", "P20",
    lambda s, d: filters.posts_only(facts_with_comments(s, d), titled=True).select("post_id"), f"""
WITH {ALL_FACTS} SELECT post_id FROM all_facts WHERE post_type <> 'comment' AND title <> ''""")

add("nested_projection", "P22",
    lambda s, d: feed(s, d).withColumn(
        "commit", F.col("commit").withField(
            "label", F.concat("commit.record.kind", F.lit("/"), "commit.rkey")))
    .withColumnRenamed("did", "author").withColumn("tag", F.lit("hello"))
    .select("author", F.col("commit").getItem("label").alias("label"), "tag",
            F.col("time_us").cast("string").alias("time_text")), f"""
WITH {FEED} SELECT did AS author, event_type || '/' || event_id AS label, 'hello' AS tag,
       CAST(epoch_us(ts) AS VARCHAR) AS time_text FROM feed""")

add("conformed", "P23",
    lambda s, d: filters.conform(
        table(s, d, "events"),
        "event_type STRING, event_id STRING, value BIGINT, user_id DOUBLE"), """
SELECT event_type, CAST(event_id AS VARCHAR) AS event_id, CAST(trunc(value) AS BIGINT) AS value,
       CAST(user_id AS DOUBLE) AS user_id FROM events""")

add("sampled_series", "P24",
    lambda s, d: filters.hash_sample(table(s, d, "events"), "event_id", 0.2).select(
        "event_id", "event_type"), f"""
SELECT event_id, event_type FROM events
WHERE CAST('0x' || substr(md5('42:' || event_id), 1, 8) AS BIGINT) < {int(0.2 * 2**32)}""")

add("embeddable", "P25",
    lambda s, d: filters.embeddable(
        posts(s, d).withColumn(
            "record", F.when(F.col("lang") != "fr", F.struct("text", F.col("source").alias("cid")))
        ).withColumn("cid", F.when(F.col("lang") != "es", F.col("record.cid")).otherwise("")),
        "record.text", "cid").select("post_id"), f"""
WITH {POSTS} SELECT post_id FROM posts WHERE lang NOT IN ('fr', 'es')""")

# Identifiers, JSON, defaults ----------------------------------------------------------------

add("post_uris", "F1",
    lambda s, d: posts(s, d).select(
        values.post_uri("did", F.lit(POST_COLLECTION), "post_id").alias("uri")), f"""
WITH {POSTS} SELECT 'at://' || did || '/{POST_COLLECTION}/' || post_id AS uri FROM posts""")

add("json_fields", "F12",
    lambda s, d: table(s, d, "events").select(
        "event_id", values.json_field("props", "$.k", "bigint").alias("k"),
        values.json_field("props", "$.none", "double").alias("none"),
        values.json_field(F.concat(F.lit('{"k": "x'), "event_id", F.lit('"}')), "$.k", "double")
        .alias("bad")), """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       CAST(NULL AS DOUBLE) AS none, CAST(NULL AS DOUBLE) AS bad FROM events""")

add("missing_defaults", "F28",
    lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").select(
        "doc_id", values.num_or_zero("toxic").alias("toxic"),
        values.text_or_empty(F.when(F.col("quality") == 1, F.col("source"))).alias("label")), """
SELECT doc_id, CAST(coalesce(toxic, 0) AS DOUBLE) AS toxic,
       CASE WHEN quality = 1 THEN source ELSE '' END AS label
FROM documents LEFT JOIN labels USING (doc_id)""")

add("row_uids", "F29",
    lambda s, d: posts(s, d).select("post_id", values.row_uid(F.lit(1), "post", "post_id").alias(
        "row_uid")), f"""
WITH {POSTS} SELECT post_id, sha256('1|post|' || post_id) AS row_uid FROM posts""")

_NS = uuid.UUID(NAMESPACE_URL).hex

add("uuids", "F30",
    lambda s, d: posts(s, d).select(
        "post_id", values.uuid5(NAMESPACE_URL, F.concat_ws("/", "source", "text")).alias("uuid")), f"""
WITH {POSTS}, h AS (
  SELECT post_id, sha1(from_hex('{_NS}') || encode(source || '/' || text)) AS h FROM posts)
SELECT post_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-'
       || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-'
       || h[21:32] AS uuid FROM h""")

add("rounded", "F31",
    lambda s, d: table(s, d, "events").select(
        "event_id", F.round(F.col("value") / 7, 2).alias("two"),
        F.round(F.col("value") / 7, 3).alias("three"),
        F.round(F.col("value") / 7, 4).alias("four")), """
SELECT event_id, round(value / 7, 2) AS two, round(value / 7, 3) AS three,
       round(value / 7, 4) AS four FROM events""")

# Times ----------------------------------------------------------------------------------------

add("epoch_parts", "F24",
    lambda s, d: table(s, d, "events").select(
        "event_id", times.seconds_ts(
            F.when(F.col("event_id") % 7 == 0, F.lit("NaN"))
            .when(F.col("event_id") % 7 == 1, F.lit("Infinity"))
            .when(F.col("event_id") % 7 == 2, (times.epoch_micros("ts") / 1_000).cast("string"))
            .when(F.col("event_id") % 7 == 3, F.lit("soon"))
            .otherwise((times.epoch_micros("ts") / 1_000_000).cast("string"))).alias("at"))
    .where("at is not null").select(
        "event_id", F.to_date("at").alias("day"), F.year("at").alias("year"),
        F.month("at").alias("month")), f"""
SELECT event_id, {day_text('ts')} AS day, year(ts) AS year, month(ts) AS month FROM events
WHERE event_id % 7 > 3""")

add("micros_times", "F25",
    lambda s, d: feed(s, d).select("event_id", times.micros_ts("time_us").alias("at")), f"""
SELECT event_id, {time_text('ts')} AS at FROM events""")

add("iso_times", "F26",
    lambda s, d: table(s, d, "events").select(
        "event_id", F.coalesce(F.unix_micros(times.iso_ts(
            F.when(F.col("event_type") == "error", "not a time").otherwise(
                F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))))),
            F.lit(-1)).alias("micros")), """
SELECT event_id, CASE WHEN event_type <> 'error' THEN epoch_us(ts) ELSE -1 END AS micros
FROM events""")

add("month_keys", "F27",
    lambda s, d: table(s, d, "orders").select(
        "o_orderkey", times.month_key("o_orderdate").alias("month"),
        times.iso_text("o_orderdate").alias("iso")), """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso FROM orders""")

add("date_helpers", "F32",
    lambda s, d: table(s, d, "orders").select(
        "o_orderkey", F.date_add(F.to_date("o_orderdate"), 7).alias("later"),
        F.date_sub(F.to_date("o_orderdate"), 7).alias("earlier"),
        F.date_diff(F.to_date("o_orderdate"), F.lit("1996-01-01").cast("date")).alias("days"),
        (F.current_date() > F.to_date("o_orderdate")).alias("past")), f"""
SELECT o_orderkey, {day_text("CAST(o_orderdate AS DATE) + 7")} AS later,
       {day_text("CAST(o_orderdate AS DATE) - 7")} AS earlier,
       CAST(o_orderdate AS DATE) - DATE '1996-01-01' AS days,
       current_date > CAST(o_orderdate AS DATE) AS past FROM orders""")

add("epoch_seconds", "F34",
    lambda s, d: table(s, d, "events").select("event_id", times.epoch_seconds("ts").alias("epoch")), """
SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch FROM events""")

# Scores ---------------------------------------------------------------------------------------

add("like_reply_ratio", "F13 X1",
    lambda s, d: posts(s, d).select(
        "post_id", scores.like_reply_ratio("like_count", "reply_count").alias("ratio")), f"""
WITH {POSTS}
SELECT post_id, round(CASE WHEN reply_count = 0 THEN 0 ELSE like_count::DOUBLE / reply_count END, 6)
       AS ratio FROM posts""")

add("wordlist_sentiment", "F14 F15",
    lambda s, d: posts(s, d).withColumn("tokens", text.tokens_alpha("text")).withColumn(
        "score", scores.wordlist_sentiment("tokens", GOOD, POOR)).select(
        "post_id", "score", scores.sign_label("score").alias("label")), f"""
WITH {POSTS}, t AS (SELECT post_id, {alpha_sql('text')} AS tokens FROM posts),
s AS (SELECT post_id, {sentiment_sql('tokens')} AS score FROM t)
SELECT post_id, round(score, 6) AS score, CASE WHEN score > 0 THEN 'positive'
       WHEN score < 0 THEN 'negative' ELSE 'neutral' END AS label FROM s""")

add("fact_scores", "F17 F18 F19",
    lambda s, d: facts(s, d).select(
        "post_id", scores.controversy_score("num_comments", "score").alias("controversy"),
        scores.interest_value("ups", "num_comments", "score").alias("interest"),
        scores.engagement("ups", "downs", "num_comments").alias("engagement")), f"""
WITH {FACTS}
SELECT post_id, round(num_comments / (abs(score) + 1), 6) AS controversy,
       ups + num_comments + greatest(score, 0) AS interest,
       1 + ups + downs + num_comments AS engagement FROM facts""")

add("post_facts", "S19 F22 F24",
    lambda s, d: post_facts(forum_posts(s, d), 1).withColumn("title", F.md5("title")), f"""
WITH {FACTS}
SELECT 1::BIGINT AS run_id, sha256('1|post|' || post_id) AS row_uid, post_id,
       {day_text('created_date')} AS created_date, year, month, md5(title) AS title, score, ups,
       downs, num_comments, engagement, post_type FROM facts""")

add("comment_facts", "S19",
    lambda s, d: comment_facts(forum_comments(s, d), 1).withColumn("body", F.md5("body")), f"""
WITH {REMARKS}
SELECT 1::BIGINT AS run_id, sha256('1|comment|' || comment_id) AS row_uid, comment_id,
       {day_text('created_date')} AS created_date, year, month, md5(body) AS body, score, ups,
       downs, controversiality FROM remarks""")


def _embedded(s, d):
    """Posts with the embed of a feed record: a page link, a media type, or nothing."""
    pages = table(s, d, "pages").select("page_id", "url")
    kind = F.col("event_type")
    embed = F.when(
        kind != "view",
        F.struct(
            F.when(kind == "signup", "app.embed.Images").when(kind == "error", "app.embed.video")
            .alias("type"),
            F.col("url").alias("uri"),
            F.when(kind == "click", "image/png").alias("mime"),
        ),
    )
    return (
        posts(s, d).withColumn("page_id", F.col("post_id") % rows_of(pages))
        .join(pages, "page_id").withColumn("embed", embed)
        .withColumn("post_type", media.feed_media_type(
            "text", F.col("embed").isNotNull(), "embed.type", "embed.uri", "embed.mime"))
    )


_MEDIA = f"""{POSTS}, media AS (
  SELECT post_id, CASE WHEN event_type = 'view' THEN
                    CASE WHEN trim(text) <> '' THEN 'text' ELSE 'other' END
         WHEN event_type = 'signup' THEN 'photo' WHEN event_type = 'error' THEN 'video'
         WHEN regexp_matches(lower(url), '{VIDEO_MARKS}') THEN 'video'
         WHEN regexp_matches(lower(url), '{IMAGE_MARKS}') THEN 'photo'
         WHEN event_type = 'click' THEN 'photo' ELSE 'other' END AS media
  FROM posts JOIN pages ON page_id = post_id % (SELECT count(*) FROM pages))"""

add("feed_media_types", "F23",
    lambda s, d: _embedded(s, d).select("post_id", F.col("post_type").alias("media")),
    f"WITH {_MEDIA} SELECT post_id, media FROM media")

add("media_split", "A21 F23", lambda s, d: media_split(_embedded(s, d)), f"""
WITH {_MEDIA}
SELECT l.position, l.label, count(media) AS value,
       round(count(media) * 100.0::DOUBLE / (SELECT count(*) FROM media), 6) AS percent
FROM (VALUES (0::BIGINT, 'video'), (1, 'photo'), (2, 'text'), (3, 'other')) l(position, label)
LEFT JOIN media ON media = label GROUP BY 1, 2""")


@query("feed_overview", "A5 A6 A19 A20 A21", f"""
WITH {_MEDIA}, {FEED}, described AS (
  SELECT post_id * ((SELECT count(*) FROM events) // (SELECT count(*) FROM documents)) AS event_id,
         text, media FROM posts JOIN media USING (post_id)), known AS (
  SELECT * FROM feed WHERE event_type IN ('view', 'click', 'purchase')), chosen AS (
  SELECT * FROM known LEFT JOIN described USING (event_id) WHERE month(ts) IN (1, 3))
SELECT 'available_years' AS part, CAST(year(ts) AS VARCHAR) AS label, year(ts)::DOUBLE AS value
FROM known GROUP BY year(ts)
UNION ALL SELECT 'kpis', 'total_posts', count(*) FILTER (event_type = 'view') FROM chosen
UNION ALL SELECT 'kpis', 'total_likes', count(*) FILTER (event_type = 'click') FROM chosen
UNION ALL SELECT 'kpis', 'total_follows', count(*) FILTER (event_type = 'purchase') FROM chosen
UNION ALL SELECT 'kpis', 'active_days', count(DISTINCT CAST(ts AS DATE)) FROM chosen
UNION ALL SELECT 'post_type_split', label, count(medium) FROM (
  VALUES ('video'), ('photo'), ('text'), ('other')) l(label) LEFT JOIN (
    SELECT coalesce(media, 'other') AS medium FROM chosen WHERE event_type = 'view')
  ON medium = label GROUP BY 2
UNION ALL (SELECT 'top_keywords', word, count(*) FROM (
  SELECT unnest({alpha_sql('text')}) AS word FROM chosen WHERE event_type = 'view')
  GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 6)
UNION ALL SELECT 'timeline_series', {day_text('ts')}, count(*) FROM chosen GROUP BY 2""")
def _feed_overview(s, d):
    """Every event of the feed; those that a document was matched to have its text and medium."""
    stride = F.floor(rows_of(table(s, d, "events")) / rows_of(table(s, d, "documents")))
    described = _embedded(s, d).select(
        (F.col("post_id") * stride).alias("event_id"), "text", "post_type")
    events = feed(s, d).join(described, "event_id", "left")
    bundle = insights.feed_overview(events, "ts", "collection", "text", "post_type", months="1,3")
    figures = ("total_posts", "total_likes", "total_follows", "active_days")
    return stacked([
        tall(bundle, "available_years", F.col("year"), F.col("year")),
        *[tall(bundle, "kpis", F.lit(name), F.col(name)) for name in figures],
        tall(bundle, "post_type_split", F.col("label"), F.col("value")),
        tall(bundle, "top_keywords", F.col("word"), F.col("count")),
        tall(bundle, "timeline_series", F.date_format("bucket", "yyyy-MM-dd"), F.col("total")),
    ])

add("share_of_total", "W9",
    lambda s, d: share(
        posts(s, d).groupBy("source").agg(F.sum("like_count").alias("likes")), "likes"), f"""
WITH {POSTS}
SELECT source, CAST(sum(like_count) AS BIGINT) AS likes,
       round(sum(like_count) * 100.0::DOUBLE / (SELECT sum(like_count) FROM posts), 6) AS percent
FROM posts GROUP BY 1""")

add("scaled_minmax", "W9",
    lambda s, d: scale_minmax(
        table(s, d, "events").select("event_id", "value", "event_type"), "value",
        F.col("event_type") != "error").select("event_id", "scaled"), """
WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events WHERE event_type <> 'error')
SELECT event_id, round(greatest(0, least(1, (value - lo) / (hi - lo))), 6) AS scaled
FROM events, b""")
