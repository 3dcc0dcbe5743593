"""Registered queries: joins, windows, keys, set operations, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearsay.functions.text import tokens_clean
from hearsay.functions.vocab import default_stopwords
from hearsay.operators import drift, keys, kpis, ranks, risk, series, trends, words
from hearsay.operators.filters import drop_stopwords
from hearsay.operators.grids import zero_fill
from hearsay.plans.inputs import (
    FACTS, FEED, GOOD, INGESTION, POOR, POSTS, SCORED, SERIES, STATS, clean_sql, day_text,
    facts, feed, gold_series, posts, scored, sql_list, table, time_text,
)
from hearsay.plans.registry import add, query
from hearsay.session import shared_path
from hearsay.sources import ledger, readers, sinks
from hearsay.sources.counted import write_counted, write_parsed
from hearsay.sources.keystore import KeyedTable, ProcessedKeys
from hearsay.streaming.sinks import dual_sink, read_versions

# Joins and keys -------------------------------------------------------------------------------

add("pending_keys", "J1",
    lambda s, d: keys.pending_keys(
        posts(s, d).select("post_id").unionByName(posts(s, d).select("post_id")),
        table(s, d, "labels").select(F.col("doc_id").alias("post_id")), "post_id"), f"""
WITH {POSTS}
SELECT post_id FROM posts WHERE post_id NOT IN (SELECT doc_id FROM labels)""")


def _processed_labels(s, d) -> ProcessedKeys:
    """A store that holds the labelled documents as processed keys."""
    store = ProcessedKeys(s, shared_path(s, "processed"), "post_id", "bigint", 8)
    store.add(table(s, d, "labels").select(F.col("doc_id").alias("post_id")))
    return store


@query("pending_keys_bucketed", "J1", f"""
WITH {POSTS}
SELECT post_id FROM posts WHERE post_id NOT IN (SELECT doc_id FROM labels)""")
def _pending(s, d):
    fetched = posts(s, d).select("post_id")
    return _processed_labels(s, d).pending(fetched.unionByName(fetched))



_PROCESSED = f"""
WITH {POSTS}
SELECT doc_id AS post_id FROM labels
UNION SELECT post_id FROM posts WHERE event_type IN ('view', 'click', 'purchase')"""


def _fetched(s, d):
    status = (
        F.when(F.col("event_type") == "view", 200).when(F.col("event_type") == "click", 400)
        .when(F.col("event_type") == "purchase", 404).otherwise(503)
    )
    return posts(s, d).select("post_id", status.alias("status"))


@query("processed_keys", "J1b", _PROCESSED)
def _processed(s, d):
    done = table(s, d, "labels").select(F.col("doc_id").alias("post_id"))
    return keys.mark_processed(done, _fetched(s, d), "post_id")


@query("processed_keys_bucketed", "J1b", _PROCESSED)
def _processed_bucketed(s, d):
    store = _processed_labels(s, d)
    for _ in range(2):  # a job that is run again adds nothing
        store.mark(_fetched(s, d))
    return store.table()


add("series_for_top", "J3",
    lambda s, d: series.series_for_top(
        gold_series(s, d),
        ranks.top_k(gold_series(s, d).groupBy("word").agg(F.sum("word_count").alias("n")),
                    "n", 5, "word"), "word"), f"""
WITH {SERIES}
SELECT word, {time_text('time_range')} AS time_range,
       round(avg_vader_sentiment_score, 6) AS avg_vader_sentiment_score, word_count
FROM series WHERE word IN (
  SELECT word FROM series GROUP BY 1 ORDER BY sum(word_count) DESC, word LIMIT 5)""")

_RISK = f"""{SERIES}, latest AS (
  SELECT word, arg_max(avg_vader_sentiment_score, time_range) AS score FROM series GROUP BY 1),
said AS (
  SELECT item_id, unnest(list_transform(list_filter(string_split_regex(
    text, '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> ''),
    lambda t: lower(trim(t, '.,!?;:()[]{{}}"''')))) AS word FROM benchmark),
scores AS (
  SELECT item_id, word, count(*) AS uses, any_value(coalesce(score, 0)) AS score
  FROM said LEFT JOIN latest USING (word) GROUP BY 1, 2),
risk AS (
  SELECT item_id, sum(uses * score) / sum(uses) AS avg_score,
         coalesce(sum(uses) FILTER (score < 0), 0)::DOUBLE / sum(uses) AS neg_frac,
         min(score) AS min_score FROM scores GROUP BY 1)"""


def _sentence_scores(s, d):
    return risk.score_sentences(table(s, d, "benchmark"), gold_series(s, d), "item_id", "text")


add("sentence_word_scores", "J4 W2", _sentence_scores, f"""
WITH {_RISK} SELECT item_id, word, uses, round(score, 6) AS score FROM scores""")

add("latest_word_scores", "W2", lambda s, d: risk.latest_word_scores(gold_series(s, d)), f"""
WITH {_RISK} SELECT word, round(score, 6) AS score FROM latest""")

add("sentence_risk", "A37", lambda s, d: risk.sentence_risk(_sentence_scores(s, d), "item_id"), f"""
WITH {_RISK}
SELECT item_id, round(avg_score, 6) AS avg_score, round(neg_frac, 6) AS neg_frac,
       round(min_score, 6) AS min_score FROM risk""")


def _decision_sql(risk_cte: str, key: str) -> str:
    return f"""WITH {risk_cte}, judged AS (
  SELECT *, avg_score <= -0.05 OR neg_frac >= 0.40 OR min_score <= -0.25 AS bad FROM risk)
SELECT {key}, round(avg_score, 6) AS avg_score, round(neg_frac, 6) AS neg_frac,
       round(min_score, 6) AS min_score,
       CASE WHEN bad THEN 'Recommendation: Do not post - rule 1 triggered '
            ELSE 'Recommendation: Post - rule 2 triggered ' END ||
       printf('(avg_score=%.4f, neg_frac=%.2f, min_score=%.4f).', avg_score, neg_frac, min_score)
         AS recommendation,
       CASE WHEN bad THEN 'Avoid' WHEN avg_score >= 0.05 AND neg_frac < 0.25 AND min_score >= 0
            THEN 'Safe' ELSE 'Risky' END AS gauge FROM judged"""


add("post_decisions", "F20 F21 A37",
    lambda s, d: risk.decide(risk.sentence_risk(_sentence_scores(s, d), "item_id")),
    _decision_sql(_RISK, "item_id"))

_WORD_RISK = f"""{POSTS}, said AS (
  SELECT post_id, unnest(list_transform(list_filter(string_split_regex(
    text, '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> ''),
    lambda t: lower(trim(t, '.,!?;:()[]{{}}"''_')))) AS word FROM posts),
scores AS (
  SELECT post_id, CASE WHEN word IN {sql_list(GOOD)} THEN 1.0::DOUBLE
         WHEN word IN {sql_list(POOR)} THEN -1.0 ELSE 0.0 END AS score FROM said),
risk AS (
  SELECT post_id, avg(score) AS avg_score,
         avg(CASE WHEN score < 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS neg_frac,
         min(score) AS min_score FROM scores GROUP BY 1)"""

add("wordlist_decisions", "F20 F21 J10",
    lambda s, d: risk.decide(risk.wordlist_risk(
        posts(s, d).select("post_id", "text"), "text", GOOD, POOR)).drop("text"),
    _decision_sql(_WORD_RISK, "post_id"))

def _per_day(s, d, name, column):
    days = table(s, d, name).groupBy(F.to_date(column).alias("bucket"))
    return days.agg(F.count(F.lit(1)).alias("n"))


# Orders and shipments overlap in time but neither covers the other.
add("merged_timelines", "J5",
    lambda s, d: series.merge_timelines(
        _per_day(s, d, "orders", "o_orderdate"), _per_day(s, d, "lineitem", "l_shipdate"),
        "bucket", "n", ("ordered", "shipped")), f"""
WITH a AS (SELECT CAST(o_orderdate AS DATE) AS bucket, count(*) AS ordered FROM orders GROUP BY 1),
b AS (SELECT CAST(l_shipdate AS DATE) AS bucket, count(*) AS shipped FROM lineitem GROUP BY 1)
SELECT {day_text('bucket')} AS bucket, coalesce(ordered, 0) AS ordered, coalesce(shipped, 0) AS shipped
FROM a FULL JOIN b USING (bucket)""")


def _ingestion(s, d):
    return series.ingestion_metrics(
        series.labelled(table(s, d, "events"), "ts", "firehose"),
        series.labelled(posts(s, d), "ts", "getPosts"),
    )


add("aligned_sources", "J6",
    lambda s, d: series.align_sources(_ingestion(s, d), ["firehose", "getPosts"]), f"""
WITH {INGESTION}
SELECT {time_text('time_bucket')} AS time_bucket,
       CAST(sum(CASE source_type WHEN 'firehose' THEN record_count ELSE 0 END) AS BIGINT) AS firehose,
       CAST(sum(CASE source_type WHEN 'getPosts' THEN record_count ELSE 0 END) AS BIGINT) AS "getPosts"
FROM ingestion GROUP BY 1""")

_DENSE = f"""{SCORED}, top AS (
  SELECT word FROM post_words GROUP BY 1 ORDER BY count(*) DESC, word LIMIT 20),
dense AS (
  SELECT t.word, b.bucket, count(p.word) AS count
  FROM top t CROSS JOIN (SELECT DISTINCT created_date AS bucket FROM scored) b
  LEFT JOIN post_words p ON p.word = t.word AND p.created_date = b.bucket GROUP BY 1, 2)"""


def _filled(s, d):
    titles = scored(s, d)
    days = titles.select(F.col("created_date").alias("bucket"))
    return zero_fill(words.word_day_counts(titles), trends.frequent_words(titles, 20), days,
                     "word", "bucket", ["count"])


def _dense(s, d):
    return trends.daily_grid(scored(s, d), 20, "created_date")


add("zero_filled", "J7", _filled, f"""
WITH {_DENSE} SELECT word, {day_text('bucket')} AS bucket, count FROM dense""")

add("peak_smoothed", "W6", lambda s, d: series.peak_smooth(_dense(s, d), "word", "bucket", "count"),
    f"""
WITH {_DENSE}
SELECT word, {day_text('bucket')} AS bucket, count, max(count) OVER (
       PARTITION BY word ORDER BY bucket ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smoothed
FROM dense""")

add("sampled_points", "W7",
    lambda s, d: series.sample_series(_dense(s, d), "bucket", 7, "word"), f"""
WITH {_DENSE}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY bucket) - 1 AS i,
         count(*) OVER (PARTITION BY word) AS n FROM dense)
SELECT word, {day_text('bucket')} AS bucket, count FROM placed
WHERE n <= 7 OR i IN (SELECT round_even(r * (n - 1)::DOUBLE / 6, 0) FROM range(7) t(r))""")


add("sampled_orders", "W7",
    lambda s, d: series.sample_series(
        table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 101), """
WITH placed AS (
  SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS i,
         count(*) OVER () AS n FROM orders)
SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM placed
WHERE n <= 101 OR i IN (SELECT round_even(r * (n - 1)::DOUBLE / 100, 0) FROM range(101) t(r))""")


_PATCHED = f"""
WITH {POSTS}
SELECT p.did, p.post_id, CASE WHEN u.quality = 1 THEN 'good' ELSE p.source END AS source,
       coalesce(u.toxic, p.reply_count) AS reply_count
FROM posts p LEFT JOIN labels u ON u.doc_id = p.post_id"""


def _payloads(s, d):
    """Payloads and what is to be patched in them."""
    base = posts(s, d).select("did", "post_id", "source", "reply_count")
    updates = table(s, d, "labels").withColumnRenamed("doc_id", "post_id").join(
        base.select("did", "post_id"), "post_id"
    ).select(
        "did", "post_id", F.when(F.col("quality") == 1, "good").alias("source"),
        F.col("toxic").cast("bigint").alias("reply_count"),
    )
    return base, updates


add("patched_payloads", "J8",
    lambda s, d: keys.patch(*_payloads(s, d), ["did", "post_id"], ["source", "reply_count"]),
    _PATCHED)


@query("patched_in_place", "J8", _PATCHED)
def _patched_in_place(s, d):
    base, updates = _payloads(s, d)
    kept = KeyedTable(s, shared_path(s, "payloads"), ("did", "post_id"), 8)
    kept.create(base)
    kept.patch(updates, ["source", "reply_count"])
    return kept.read()


_UPSERTED = f"""
SELECT user_id, {time_text('max(ts)')} AS ts, arg_max(event_id, ts) AS event_id,
       round(arg_max(value, ts), 6) AS value FROM events GROUP BY 1"""


def _views_and_events(s, d):
    events = table(s, d, "events").select("user_id", "ts", "event_id", "value")
    views = table(s, d, "events").filter(F.col("event_type") == "view").select(*events.columns)
    return views, events


add("upserted", "J9 W2",
    lambda s, d: keys.upsert(*_views_and_events(s, d), "user_id", "ts", ["event_id"]), _UPSERTED)


@query("upserted_in_place", "J9 W2", _UPSERTED)
def _upserted_in_place(s, d):
    """A table of the last view of each user, into which all events are merged, some twice."""
    views, events = _views_and_events(s, d)
    kept = KeyedTable(s, shared_path(s, "last-events"), ("user_id",), 8)
    kept.create(keys.latest_per_key(views, "user_id", "ts", ["event_id"]))
    for part in (F.col("event_id") % 2 == 0, F.lit(True), F.col("event_id") % 2 == 1):
        kept.upsert(events.where(part), "ts", ["event_id"])
    return kept.read()


add("latest_per_key", "W2",
    lambda s, d: keys.latest_per_key(
        table(s, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"),
        "o_custkey", "o_orderdate", ["o_orderkey"]), f"""
SELECT o_custkey, {time_text('o_orderdate')} AS o_orderdate, o_orderkey,
       round(o_totalprice, 6) AS o_totalprice
FROM orders QUALIFY row_number() OVER (
  PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")

add("key_batches", "W10",
    lambda s, d: keys.chunk(
        keys.pending_keys(posts(s, d), table(s, d, "labels").select(
            F.col("doc_id").alias("post_id")), "post_id"), "post_id", 25), f"""
WITH {POSTS}, pending AS (
  SELECT post_id FROM posts WHERE post_id NOT IN (SELECT doc_id FROM labels))
SELECT post_id, (row_number() OVER (ORDER BY post_id) - 1) // 25 AS batch FROM pending""")

for _how, _sql in {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN",
                   "full": "FULL JOIN"}.items():
    add(f"join_{_how}", "J12",
        lambda s, d, how=_how: table(s, d, "pages").select(
            F.col("page_id").alias("doc_id"), "url").join(
            table(s, d, "labels").select("doc_id", "toxic"), "doc_id", how)
        .select("doc_id", F.coalesce("url", F.lit("none")).alias("url"),
                F.coalesce("toxic", F.lit(-1)).alias("toxic")), f"""
SELECT doc_id, coalesce(url, 'none') AS url, CAST(coalesce(toxic, -1) AS BIGINT) AS toxic
FROM (SELECT page_id AS doc_id, url FROM pages) {_sql} labels USING (doc_id)""")

add("join_anti", "J12",
    lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left_anti").select(
        "doc_id"), """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")

# Windows, sorts, limits -------------------------------------------------------------------------

_EVENTS = "SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"


def _k_events(s, d):
    return table(s, d, "events").select(
        "event_id", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")
    )


add("global_row_numbers", "W3 W5",
    lambda s, d: ranks.global_order(_k_events(s, d), "user_id", "event_id", "k"), f"""
WITH e AS ({_EVENTS})
SELECT *, row_number() OVER w AS row_number,
       CAST(sum(k) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_sum
FROM e WINDOW w AS (ORDER BY user_id, event_id)""")

add("global_ranks", "W3 W4",
    lambda s, d: ranks.global_ranks(_k_events(s, d), "user_id", "k"), f"""
WITH e AS ({_EVENTS})
SELECT *, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank,
       CAST(sum(k) OVER w AS BIGINT) AS range_sum
FROM e WINDOW w AS (ORDER BY user_id)""")

add("global_ranks_descending", "W3",
    lambda s, d: ranks.global_ranks(_k_events(s, d), "k", descending=True), f"""
WITH e AS ({_EVENTS})
SELECT *, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank
FROM e WINDOW w AS (ORDER BY k DESC)""")

add("total_beside_rows", "W4",
    lambda s, d: _k_events(s, d).withColumn(
        "total", _k_events(s, d).agg(F.sum("k")).scalar()), f"""
WITH e AS ({_EVENTS}) SELECT *, CAST(sum(k) OVER () AS BIGINT) AS total FROM e""")

add("running_totals", "W5",
    lambda s, d: ranks.running_total(_k_events(s, d), "user_id", ["event_id"], "k"), f"""
WITH e AS ({_EVENTS})
SELECT *, CAST(sum(k) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)
               AS BIGINT) AS running_sum FROM e""")

add("sorted_words", "O1",
    lambda s, d: words.word_controversy(posts(s, d), "text", "like_count", "reply_count").groupBy(
        F.round("avg_like_to_comment_ratio").alias("ratio")).agg(
        F.count(F.lit(1)).alias("words")).orderBy(F.desc("words"), F.asc("ratio")), f"""
WITH {POSTS}, used AS (
  SELECT CASE WHEN reply_count = 0 THEN 0 ELSE like_count::DOUBLE / reply_count END AS ratio,
         unnest(list_distinct(list_filter(
    string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda t: t <> ''))) AS word FROM posts),
means AS (SELECT word, avg(ratio) AS ratio FROM used GROUP BY 1)
SELECT round(ratio, 0) AS ratio, count(*) AS words FROM means GROUP BY 1""")

add("top_authors", "O2",
    lambda s, d: ranks.top_k(
        posts(s, d).groupBy("did").agg(F.sum("like_count").alias("likes")), "likes", 10, "did"), f"""
WITH {POSTS}
SELECT did, CAST(sum(like_count) AS BIGINT) AS likes FROM posts
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")

add("pooled_top_topics", "O4",
    lambda s, d: ranks.pool_top_k(
        words.word_stats(scored(s, d)).select("topic", "mentions", "avg_engagement"),
        "mentions", 100, ranks.rank_key("avg_engagement"), 10, "topic"), f"""
WITH {STATS}, pool AS (SELECT * FROM stats ORDER BY mentions DESC, topic LIMIT 100)
SELECT topic, mentions, round(avg_engagement, 6) AS avg_engagement FROM pool
ORDER BY round(avg_engagement, 9) DESC, topic LIMIT 10""")

add("head_and_tail", "O5 A2",
    lambda s, d: ranks.head_tail(kpis.daily_posts(facts(s, d)), "bucket"), f"""
WITH {FACTS}, days AS (SELECT created_date AS bucket, count(*) AS count FROM facts GROUP BY 1)
SELECT {day_text('bucket')} AS bucket, count, 'first' AS part
FROM (SELECT * FROM days ORDER BY bucket LIMIT 10)
UNION ALL SELECT {day_text('bucket')}, count, 'last'
FROM (SELECT * FROM days ORDER BY bucket DESC LIMIT 10)""")

# Set operations -----------------------------------------------------------------------------------

add("union_by_name", "U1",
    lambda s, d: series.union_sources(
        table(s, d, "documents").select("doc_id", "source"),
        table(s, d, "labels").select("doc_id", F.col("toxic").cast("bigint").alias("toxic")))
    .groupBy("source", "toxic").agg(F.count(F.lit(1)).alias("n"))
    .select(F.coalesce("source", F.lit("none")).alias("source"),
            F.coalesce("toxic", F.lit(-1)).alias("toxic"), "n"), """
SELECT coalesce(source, 'none') AS source, CAST(coalesce(toxic, -1) AS BIGINT) AS toxic,
       count(*) AS n
FROM (SELECT doc_id, source FROM documents UNION ALL BY NAME SELECT doc_id, toxic FROM labels)
GROUP BY 1, 2""")

add("union_by_position", "U3",
    lambda s, d: table(s, d, "documents").select("doc_id", "text").union(
        table(s, d, "benchmark").select("item_id", "text")).select(
        "doc_id", F.md5("text").alias("digest")), """
SELECT doc_id, md5(text) AS digest FROM documents
UNION ALL SELECT item_id, md5(text) FROM benchmark""")


@query("schema_drift", "U4", """
WITH old AS (SELECT DISTINCT unnest(json_keys(to_json(e))) AS key FROM events e),
new AS (SELECT DISTINCT unnest(json_keys(to_json(d))) AS key FROM documents d
        UNION SELECT DISTINCT 'lang_' || lang FROM documents)
SELECT key, 'missing' AS change FROM old WHERE key NOT IN (SELECT key FROM new)
UNION ALL SELECT key, 'added' FROM new WHERE key NOT IN (SELECT key FROM old)""")
def _drift(s, d):
    def lines(df):
        return df.select(F.to_json(F.struct(*df.columns)).alias("value"))

    documents = table(s, d, "documents").withColumn("lang_key", F.concat(F.lit("lang_"), "lang"))
    # A key that depends on the row: keys have to come from all lines.
    plain = F.to_json(F.struct("doc_id", "text", "lang", "source", "n_chars"))
    keyed = documents.select(
        F.concat(F.regexp_replace(plain, r"\}$", ',"'), "lang_key", F.lit('":1}')).alias("value")
    )
    return drift.schema_drift(lines(table(s, d, "events")), keyed)


add("array_sets", "U5 F11",
    lambda s, d: posts(s, d).select(
        "post_id",
        F.size(F.array_except(tokens_clean("text", []), F.array(
            *[F.lit(w) for w in default_stopwords()]))).alias("kept"),
        F.size(F.array_distinct(tokens_clean("text", [], False))).alias("distinct_words")), f"""
WITH {POSTS}
SELECT post_id, len({clean_sql('text')}) AS kept,
       len(list_distinct(regexp_extract_all(lower(regexp_replace(text, '[^a-zA-Z0-9]+', ' ', 'g')),
           '\\b[a-z][a-z0-9]+\\b'))) AS distinct_words FROM posts""")

# Sources and sinks: written to the shared folder, read back ------------------------------------------


def _written_json(s, d, name="json"):
    path = shared_path(s, name)
    table(s, d, "events").write.json(path)
    return path


_EVENT_DDL = "event_id BIGINT, event_type STRING, value DOUBLE, props STRING"

add("json_inferred", "S1",
    lambda s, d: readers.read_events(s, _written_json(s, d)).select(
        "event_id", "event_type", "value", "props"), """
SELECT event_id, event_type, round(value, 6) AS value, props FROM events""")


@query("json_pinned", "S2", """
SELECT event_id, event_type, round(value, 6) AS value, props FROM events""")
def _pinned(s, d):
    return readers.read_events(s, _written_json(s, d), _EVENT_DDL)


add("parquet_scan", "S3",
    lambda s, d: readers.read_table(s, f"{d}/events.parquet").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n")), """
SELECT event_type, count(*) AS n FROM events GROUP BY 1""")


def _lines_with_damage(s, d):
    """Events as JSON lines; those of type error are cut short and do not parse."""
    events = table(s, d, "events")
    line = F.to_json(F.struct(*events.columns))
    cut = F.regexp_replace(line, ".{5}$", "")
    return events.select(
        F.when(F.col("event_type") == "error", cut).otherwise(line).alias("value")
    )


@query("malformed_lines", "S4", """
SELECT CASE WHEN event_type = 'error' THEN 'bad' ELSE 'good' END AS state, count(*) AS n
FROM events GROUP BY 1""")
def _malformed(s, d):
    """Lines are parsed and the good ones written; the counts come out of the same pass. Those of
    the good ones are taken from the table that was written."""
    path, parsed = shared_path(s, "lines"), shared_path(s, "parsed")
    _lines_with_damage(s, d).write.text(path)
    counts = write_parsed(s.read.text(path), _EVENT_DDL, parsed)
    if counts["good"] + counts["bad"] != counts["scanned"]:
        raise ValueError(f"counts do not add up: {counts}")
    good = s.read.parquet(parsed).agg(F.count(F.lit(1)).alias("n"))
    return good.select(F.lit("good").alias("state"), "n").unionByName(
        s.createDataFrame([("bad", counts["bad"])], "state STRING, n BIGINT"))


add("converted_format", "S5 S11",
    lambda s, d: sinks.convert_format(
        s, _written_json(s, d), shared_path(s, "converted")).select("event_id", "event_type"), """
SELECT event_id, event_type FROM events""")


@query("compacted_posts", "S6", f"""
WITH {FEED} SELECT event_id, did FROM feed
WHERE event_type = 'view' AND operation = 'create'""")
def _compacted(s, d):
    path = shared_path(s, "compact")
    sinks.compact_posts(feed(s, d), path)
    return readers.read_table(s, path).select("event_id", "did")


_HYDRATED = f"""
WITH {POSTS}
SELECT post_id, CAST(like_count AS DOUBLE) AS likes, CAST(reply_count AS DOUBLE) AS replies,
       md5(text) AS digest FROM posts"""


def hydrated(s, d):
    """Posts as nested records with counters, the shape a fetch returns."""
    return posts(s, d).select(
        F.col("post_id").cast("string").alias("uri"),
        F.struct(
            "text", "langs",
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("createdAt"),
        ).alias("record"),
        F.col("like_count").alias("likeCount"),
        F.col("reply_count").alias("replyCount"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("indexedAt"),
    )


add("topic_round_trip", "S9 S10 F12",
    lambda s, d: readers.decode_topic_json(
        sinks.to_topic_value(hydrated(s, d)).select(F.col("value").cast("binary").alias("value")),
        {"post_id": ("$.uri", "bigint"), "likes": ("$.likeCount", "double"),
         "replies": ("$.replyCount", "double"), "text": ("$.record.text", "string")})
    .select("post_id", "likes", "replies", F.md5("text").alias("digest")), _HYDRATED)


@query("write_modes", "S11", """
SELECT mode, count(*) * factor AS n FROM events,
  (VALUES ('append', 2), ('overwrite', 1), ('ignore', 1)) m(mode, factor) GROUP BY mode, factor""")
def _modes(s, d):
    counts = None
    for mode in ("append", "overwrite", "ignore"):
        path = shared_path(s, mode)
        for _ in range(2):
            sinks.write_table(table(s, d, "events"), path, mode)
        one = readers.read_table(s, path).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(mode).alias("mode"), "n"
        )
        counts = one if counts is None else counts.unionByName(one)
    return counts


@query("dual_sink", "S12", """
SELECT event_type, count(*) AS n, 2::BIGINT AS copies FROM events GROUP BY 1""")
def _dual(s, d):
    """Two micro-batches into a versioned table and a second table; the second batch is
    played twice, as after a crash."""
    path, other = shared_path(s, "versions"), shared_path(s, "copy")
    write = dual_sink(path, lambda batch, n: batch.write.mode("overwrite").parquet(f"{other}/n={n}"))
    counts = table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    early = table(s, d, "events").filter("value < 100").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"))
    write(early, 0)
    write(counts, 1)
    write(counts, 1)
    kept = read_versions(s, path, ["event_type"])
    copies = s.read.parquet(other).groupBy("event_type").agg(F.count(F.lit(1)).alias("copies"))
    return kept.join(copies, "event_type")


@query("csv_export", "S14", f"""
WITH {SERIES}
SELECT word, {time_text('time_range')} AS time_range, round(avg_vader_sentiment_score, 6)
       AS avg_vader_sentiment_score, word_count FROM series""")
def _csv(s, d):
    path = shared_path(s, "csv")
    sinks.export_csv(
        sinks.clean_text_columns(gold_series(s, d)), path,
        ["word", "time_range", "avg_vader_sentiment_score", "word_count"])
    return s.read.schema(
        "word STRING, time_range TIMESTAMP_NTZ, avg_vader_sentiment_score DOUBLE, word_count BIGINT"
    ).option("header", True).csv(path)


@query("refreshed_table", "S13 F10", f"""
WITH {POSTS} SELECT post_id, source || '!' AS source, md5(text) AS digest FROM posts""")
def _refreshed(s, d):
    """A table that is loaded in full a second time; the first load is gone."""
    path = shared_path(s, "refresh")
    rows = posts(s, d).select("post_id", "source", "text")
    sinks.refresh_table(rows.withColumn("source", F.lit("old")), path)
    sinks.refresh_table(rows.withColumn("source", F.concat("source", F.lit("\u0000!"))), path)
    return s.read.parquet(path).select("post_id", "source", F.md5("text").alias("digest"))


@query("rewritten_table", "S16 P14", f"""
WITH {SERIES}
SELECT word, CAST(sum(word_count) AS BIGINT) AS uses FROM series
WHERE word NOT IN {sql_list(GOOD)} GROUP BY 1""")
def _rewritten(s, d):
    path = shared_path(s, "rewrite")
    sinks.write_table(gold_series(s, d), path, "overwrite")
    table_now = sinks.rewrite_table(s, path, lambda df: drop_stopwords(df, "word", GOOD))
    return table_now.groupBy("word").agg(F.sum("word_count").alias("uses"))


@query("hourly_capture", "S17", f"""
SELECT {day_text('ts')} AS date, hour(ts) AS hour, count(*) AS n,
       CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1, 2""")
def _hourly(s, d):
    path = shared_path(s, "hourly")
    sinks.write_hourly(table(s, d, "events"), "ts", path)
    return s.read.schema("event_id BIGINT, date DATE, hour INT").json(path).groupBy(
        "date", "hour").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


_LEDGER = """ledger AS (
  SELECT dense_rank() OVER (ORDER BY CAST(ts AS DATE)) AS run_id, ts AS run_ts,
         event_type AS source_path, 1 AS records_scanned FROM events)"""


def _ledger(s, d):
    """A ledger with a run per day and an entry per event."""
    first = table(s, d, "events").agg(F.min(F.to_date("ts"))).scalar()
    return table(s, d, "events").select(
        (F.date_diff(F.to_date("ts"), first) + 1).cast("bigint").alias("run_id"),
        F.col("ts").alias("run_ts"), F.col("event_type").alias("source_path"),
        F.lit(1).cast("bigint").alias("records_scanned"))


add("run_totals", "S18", lambda s, d: ledger.run_totals(_ledger(s, d)), f"""
WITH {_LEDGER}
SELECT run_id, {time_text('min(run_ts)')} AS run_ts, arg_min(source_path, run_ts) AS source_path,
       CAST(sum(records_scanned) AS BIGINT) AS records_scanned FROM ledger GROUP BY 1""")

add("latest_run", "S18", lambda s, d: ledger.latest_run(_ledger(s, d)), f"""
WITH {_LEDGER}
SELECT run_id, {time_text('min(run_ts)')} AS run_ts, arg_min(source_path, run_ts) AS source_path,
       CAST(sum(records_scanned) AS BIGINT) AS records_scanned
FROM ledger GROUP BY 1 ORDER BY 1 DESC LIMIT 1""")

@query("runs_recorded", "S18", """
SELECT 1::BIGINT AS run_id, 'events' AS source_path, count(*) AS records_scanned FROM events
UNION ALL SELECT 2, 'documents', count(*) FROM documents""")
def _runs_recorded(s, d):
    """Two runs are opened; each loads a table in two portions, adds what was counted while it wrote
    them, and the ledger is read."""
    path = shared_path(s, "ledger")
    for name, key in (("events", "event_id"), ("documents", "doc_id")):
        run, target = ledger.start_run(s, path, name), shared_path(s, name)
        for portion in (0, 1):
            rows = table(s, d, name).where(F.col(key) % 2 == portion)
            scanned = write_counted(rows, target)["scanned"]
            ledger.add_scanned(s, path, run, name, scanned)
    return ledger.run_totals(ledger.read_ledger(s, path)).drop("run_ts")


add("sql_over_nested", "S20",
    lambda s, d: readers.query_view(
        feed(s, d), "feed_events",
        "SELECT commit.collection, commit.record.kind AS kind, count(*) AS n FROM feed_events "
        "WHERE commit.operation = 'create' GROUP BY 1, 2"), f"""
WITH {FEED}
SELECT collection, event_type AS kind, count(*) AS n FROM feed WHERE operation = 'create'
GROUP BY 1, 2""")
