"""Registered queries over long ranges, from a series table with sums per day and month.

The series of the test tables lies in one month, so its days are spread over a year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.operators import ranges
from hearsay.plans.inputs import SERIES, gold_links, gold_series, links_sql, time_text
from hearsay.plans.registry import add
from hearsay.session import shared_path

APART = 11
#: Cuts a day at both ends and holds whole days and whole months between.
LOW, HIGH = "2024-02-06 07:25:00", "2024-10-15 16:40:00"


def _spread(series: DataFrame, ts: str) -> DataFrame:
    return series.withColumn(ts, F.expr(f"{ts} + make_dt_interval({APART} * (day({ts}) - 1))"))


def _spread_sql(ts: str) -> str:
    return f"{ts} + to_days(CAST({APART} * (day({ts}) - 1) AS INTEGER))"


def _words(s, d):
    series = _spread(gold_series(s, d), "time_range")
    levels = ranges.word_levels(s, shared_path(s, "word-levels"), series.schema)
    levels.write(series)
    return levels


def _links(s, d):
    series = _spread(gold_links(s, d), "time_bucket")
    levels = ranges.link_levels(s, shared_path(s, "link-levels"), series.schema)
    levels.write(series)
    return levels


IN_RANGE = f"""{SERIES}, spread AS (
  SELECT word, {_spread_sql('time_range')} AS moved, avg_vader_sentiment_score AS score, word_count
  FROM series), ranged AS (SELECT * FROM spread WHERE moved BETWEEN '{LOW}' AND '{HIGH}')"""

add("popular_words_ranged", "A30 J3", lambda s, d: ranges.popular_words(_words(s, d), 10, LOW, HIGH), f"""
WITH {IN_RANGE}, top AS (
  SELECT word, sum(word_count) AS total_count FROM ranged GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT word, CAST(total_count AS BIGINT) AS total_count, {time_text('moved')} AS time_range,
       CAST(sum(word_count) AS BIGINT) AS popularity
FROM ranged JOIN top USING (word) GROUP BY word, total_count, moved""")

add("declining_words_ranged", "A32 F34",
    lambda s, d: ranges.declining_words(_words(s, d), 10, LOW, HIGH).withColumn(
        "slope", F.col("slope") * 1e6), f"""
WITH {IN_RANGE}, sums AS (
  SELECT word, count(*)::HUGEINT AS n, sum(epoch(moved)::HUGEINT) AS sx,
         sum(word_count)::HUGEINT AS sy, sum(epoch(moved)::HUGEINT * word_count) AS sxy,
         sum(epoch(moved)::HUGEINT * epoch(moved)::HUGEINT) AS sxx
  FROM ranged GROUP BY 1), steepest AS (
  SELECT word, (n * sxy - sx * sy)::DOUBLE / nullif(n * sxx - sx * sx, 0)::DOUBLE AS slope
  FROM sums ORDER BY slope ASC NULLS LAST, word LIMIT 10)
SELECT word, round(slope * 1e6, 6) AS slope, {time_text('moved')} AS time_range,
       CAST(sum(word_count) AS BIGINT) AS word_count
FROM ranged JOIN steepest USING (word) GROUP BY word, slope, moved""")

add("word_moods_ranged", "A29 A37b O2", lambda s, d: ranges.moods(_words(s, d), 20, 5, LOW, HIGH), f"""
WITH {IN_RANGE}
SELECT word, CAST(sum(word_count) AS BIGINT) AS word_count,
       round(sum(score * word_count) / sum(word_count), 6) AS sentiment_score
FROM ranged GROUP BY 1 HAVING sum(word_count) >= 5
ORDER BY round(sum(score * word_count) / sum(word_count), 9) DESC, word LIMIT 20""")

add("cross_topics_ranged", "A33", lambda s, d: ranges.cross_topics(_links(s, d), 10, LOW, HIGH), f"""
WITH {links_sql()}, spread AS (
  SELECT topic_name, {_spread_sql('time_bucket')} AS moved, link_count FROM crosslinks)
SELECT topic_name, CAST(sum(link_count) AS BIGINT) AS links FROM spread
WHERE moved BETWEEN '{LOW}' AND '{HIGH}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
