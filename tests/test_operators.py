"""Operators on small hand-made frames, and against brute force."""

import math
import random
from collections import Counter, defaultdict
from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearsay.operators import (
    drift, facts, filters, grids, insights, keys, kpis, pairs, ranks, risk, series, snapshots, trends,
    valence, words,
)
from hearsay.functions import times
from hearsay.functions.vocab import NEGATIONS


def rows(frame, *columns):
    return sorted(tuple(row) for row in frame.select(*columns).collect())


# Filters --------------------------------------------------------------------------------------


def test_months():
    assert filters.parse_months("3, 1,3") == [1, 3]
    assert filters.parse_months(None) == [] == filters.parse_months("")
    for bad in ("0", "13", "1,14"):
        with pytest.raises(ValueError):
            filters.parse_months(bad)


def test_calendar_filter(spark):
    frame = spark.createDataFrame([(y, m) for y in (2025, 2026) for m in range(1, 13)], "year INT, month INT")
    assert filters.calendar_filter(frame).count() == 24
    assert filters.calendar_filter(frame, 2025, "1,2").count() == 2
    assert filters.calendar_filter(frame, "overall", "12").count() == 2


def test_controversial_and_stopwords(spark):
    frame = spark.createDataFrame([(1, 10, 49), (2, 10, 50), (3, 0, 60), (4, 10, 0), (5, None, 70)], "i INT, like_count BIGINT, reply_count BIGINT")
    assert rows(filters.controversial(frame), "i", "like_to_comment_ratio") == [(2, 0.2)]
    named = spark.createDataFrame([("a",), ("the",), (None,)], "w STRING")
    assert rows(filters.drop_stopwords(named, "w", ["the"]), "w") == [("a",)]


def test_roots_and_self_replies(spark):
    frame = spark.createDataFrame([("a", None), ("a", "at://a/p/1"), ("b", "at://a/p/1"), ("c", "x")], "did STRING, uri STRING")
    roots, replies = filters.split_roots(frame, "uri")
    assert rows(roots, "did") == [("a",)]
    assert rows(replies, "did") == [("a",), ("b",), ("c",)]
    assert rows(filters.self_replies(replies), "did") == [("a",)]


def test_embeddable_skips_null_structs(spark):
    frame = spark.createDataFrame([((("t",), "c"),), (((None,), "c"),), ((None, "c"),), ((("t",), ""),), (None,)], "commit STRUCT<record: STRUCT<text: STRING>, cid: STRING>")
    assert filters.embeddable(frame, "commit.record.text", "commit.cid").count() == 1


# Keys -----------------------------------------------------------------------------------------


def test_pending_and_processed(spark):
    wanted = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("c",)], "k STRING")
    done = spark.createDataFrame([("b",), (None,)], "k STRING")
    assert rows(keys.pending_keys(wanted, done, "k"), "k") == [("a",), ("c",)]
    results = spark.createDataFrame([("a", 200), ("c", 503), ("d", 404), ("e", 400)], "k STRING, status INT")
    after = keys.mark_processed(done, results, "k")
    assert rows(after, "k") == [("a",), ("b",), ("d",), ("e",)]
    assert rows(keys.pending_keys(wanted, after, "k"), "k") == [("c",)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=30))
def test_upsert_is_idempotent(spark, data):
    frame = spark.createDataFrame(data, "k INT, t INT, v INT")
    once = keys.upsert(frame.limit(0), frame, "k", "t", ["v"])
    twice = keys.upsert(once, frame, "k", "t", ["v"])
    want = {}
    for k, t, v in data:
        want[k] = max(want.get(k, (-1, -1)), (t, v))
    assert rows(once, "k", "t", "v") == sorted((k, *tv) for k, tv in want.items())
    assert rows(twice, "k", "t", "v") == rows(once, "k", "t", "v")


def test_patch_keeps_what_an_update_leaves_null(spark):
    base = spark.createDataFrame([("a", 1, "x", 1), ("a", 2, "y", 2), ("b", 1, "z", 3)], "did STRING, rkey INT, p STRING, q INT")
    news = spark.createDataFrame([("a", 1, None, 9), ("b", 1, "new", None), ("c", 1, "no", 0)], "did STRING, rkey INT, p STRING, q INT")
    assert rows(keys.patch(base, news, ["did", "rkey"], ["p", "q"]), "*") == [
        ("a", 1, "x", 9), ("a", 2, "y", 2), ("b", 1, "new", 3)]


def test_chunks_are_full_but_the_last(spark):
    frame = spark.range(1010).select(F.format_string("%05d", "id").alias("k")).repartition(9)
    got = keys.chunk(frame, "k", 25).orderBy("k").collect()
    assert [row["batch"] for row in got] == [i // 25 for i in range(1010)]


# Ranks ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one value."""
    random.seed(7)
    data = [(i, 5 if i % 3 == 0 else random.randrange(40), random.randrange(10)) for i in range(600)]
    return data, spark.createDataFrame(data, "id INT, v INT, n BIGINT").repartition(7)


@pytest.mark.parametrize("descending", [False, True])
def test_global_order_equals_a_sort(skewed, descending):
    data, frame = skewed
    ordered = sorted(data, key=lambda r: (-r[1] if descending else r[1], r[0]))
    want, total = [], 0
    for place, (i, _, n) in enumerate(ordered, 1):
        total += n
        want.append((i, place, total))
    got = ranks.global_order(frame, "v", "id", "n", descending)
    assert rows(got, "id", "row_number", "running_sum") == sorted(want)


@pytest.mark.parametrize("descending", [False, True])
def test_global_ranks_equal_brute_force(skewed, descending):
    data, frame = skewed
    before = (lambda a, b: a > b) if descending else (lambda a, b: a < b)
    want = []
    for i, v, _ in data:
        ahead = [row for row in data if before(row[1], v)]
        want.append((i, len(ahead) + 1, len({row[1] for row in ahead}) + 1,
                     sum(row[2] for row in data if row[1] == v or before(row[1], v))))
    got = ranks.global_ranks(frame, "v", "n", descending)
    assert rows(got, "id", "rank", "dense_rank", "range_sum") == sorted(want)


def test_rows_without_a_sort_value_are_ranked_too(spark):
    frame = spark.createDataFrame([(None,), (None,), (1,), (2,)], "v INT")
    got = ranks.global_ranks(frame, "v").select("rank", "dense_rank").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (1, 1), (3, 2), (4, 3)]


def test_running_total_of_a_hot_key(skewed):
    data, frame = skewed
    want, sums = [], Counter()
    for i, v, n in sorted(data):
        sums[v] += n
        want.append((i, sums[v]))
    got = ranks.running_total(frame, "v", ["id"], "n")
    assert rows(got, "id", "running_sum") == want
    hollow = frame.withColumn("v", F.when(F.col("v") != 5, F.col("v")))
    sums, want = Counter(), []
    for i, v, n in sorted(data):
        sums[None if v == 5 else v] += n
        want.append((i, sums[None if v == 5 else v]))
    assert rows(ranks.running_total(hollow, "v", ["id"], "n"), "id", "running_sum") == want


@pytest.mark.parametrize("kind", ["BIGINT", "INT", "DOUBLE", "DECIMAL(9,2)"])
def test_running_sums_of_missing_values(spark, kind):
    """Missing values add nothing, whatever the type and wherever the partitions and batches end;
    before the first value of a key there is no sum."""
    random.seed(3)
    data = [(i, random.choice(["a", "b", None, "c"]), None if i < 9 or i % 4 == 0 else i % 11) for i in range(400)]
    frame = spark.createDataFrame(data, "id INT, k STRING, n INT").withColumn("n", F.col("n").cast(kind)).repartition(6)
    limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        sums, want = {}, []
        for i, k, n in data:
            sums[k] = sums.get(k) if n is None else (sums.get(k) or 0) + n
            want.append((i, sums[k]))
        got = rows(ranks.running_total(frame, "k", ["id"], "n"), "id", "running_sum")
        assert [(i, x if x is None else int(x)) for i, x in got] == want
        total, want = None, []
        for place, (i, _, n) in enumerate(data, 1):
            total = total if n is None else (total or 0) + n
            want.append((i, place, total))
        got = rows(ranks.global_order(frame, "id", "id", "n"), "id", "row_number", "running_sum")
        assert [(i, p, x if x is None else int(x)) for i, p, x in got] == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)


def test_top_k_ties_and_nulls(spark):
    frame = spark.createDataFrame([("b", 2), ("a", 2), ("c", None), ("d", 3)], "w STRING, n INT")
    assert [r["w"] for r in ranks.top_k(frame, "n", 3, "w").collect()] == ["d", "a", "b"]
    assert [r["w"] for r in ranks.top_k(frame, "n", 4, "w", descending=False).collect()] == ["a", "b", "d", "c"]


def test_top_per_group_is_cut_before_the_shuffle(skewed):
    _, frame = skewed
    top = ranks.top_per_group(frame, "v", "n", 3, "id")
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert top.groupBy("v").count().filter("count > 3").count() == 0


def test_shares_and_scaling(spark):
    frame = spark.createDataFrame([("a", 1), ("b", 3)], "w STRING, n BIGINT")
    assert rows(ranks.share(frame, "n"), "percent") == [(25.0,), (75.0,)]
    assert rows(ranks.share(frame.withColumn("n", F.col("n") * 0), "n"), "percent") == [(0.0,), (0.0,)]
    assert rows(ranks.scale_minmax(frame, "n"), "scaled") == [(0.0,), (1.0,)]
    assert rows(ranks.scale_minmax(frame.filter("n = 1"), "n"), "scaled") == [(0.5,)]
    assert rows(ranks.share_of_max(frame, "n", "s"), "s") == [(1 / 3,), (1.0,)]


# Facts and key figures --------------------------------------------------------------------------

FORUM = "id STRING, title STRING, score BIGINT, ups BIGINT, downs BIGINT, num_comments BIGINT, post_hint STRING, is_video BOOLEAN, url STRING, domain STRING, url_overridden_by_dest STRING, selftext STRING, is_gallery BOOLEAN, crosspost_parent STRING, created_utc DOUBLE"


def test_facts(spark):
    posts = spark.createDataFrame([
        ("1", "t", 5, 6, 1, 2, "image", None, None, None, None, None, None, None, 1_735_689_600.0),
        ("2", None, None, None, None, None, None, None, None, None, None, None, None, None, 1_735_689_599.9),
        ("3", "x", 1, 1, 1, 1, None, None, None, None, None, None, None, None, None)], FORUM)
    comments = spark.createDataFrame([("9", "b", -3, 1, 0, 1, 0.0)], "id STRING, body STRING, score BIGINT, ups BIGINT, downs BIGINT, controversiality BIGINT, created_utc DOUBLE")
    got = facts.post_facts(posts, 4, comments)
    assert rows(got, "run_id", "post_id", F.col("created_date").cast("string"), "year", "month", "title", "score", "engagement", "post_type") == [
        (4, "1", "2025-01-01", 2025, 1, "t", 5.0, 10.0, "image"),
        (4, "2", "2024-12-31", 2024, 12, "", 0.0, 1.0, "other"),
        (4, "9", "1970-01-01", 1970, 1, "b", -3.0, 2.0, "comment")]
    assert got.select("row_uid").distinct().count() == 3
    assert rows(facts.post_facts(posts, 4), "row_uid") == rows(got.filter("post_type != 'comment'"), "row_uid")
    assert rows(facts.comment_facts(comments, 4), "comment_id", "controversiality", "score") == [("9", 1, -3.0)]


def test_kpis_of_nothing_are_zero(spark):
    empty = spark.createDataFrame([], "post_type STRING, score DOUBLE, num_comments DOUBLE, engagement DOUBLE, created_date DATE, ups DOUBLE, downs DOUBLE, controversiality INT, sentiment DOUBLE")
    assert set(kpis.post_kpis(empty).first()) == {0}
    assert set(kpis.comment_kpis(empty).first()) == {0}
    assert set(kpis.sentiment_kpis(empty).first()) == {0}
    assert rows(kpis.controversial_split(empty), "label", "value", "percent") == [
        ("controversial", 0, 0.0), ("non_controversial", 0, 0.0)]


def test_splits_sum_to_hundred(spark):
    frame = spark.createDataFrame([("video",), (None,), ("text",)], "post_type STRING")
    for split in (kpis.type_split(frame), kpis.media_split(frame)):
        assert abs(split.agg(F.sum("percent")).first()[0] - 100) < 1e-9
    assert [r["label"] for r in kpis.media_split(frame).orderBy("position").collect()] == ["video", "photo", "text", "other"]


def test_texts_of_a_hot_author_are_spread_and_kept_in_order(spark):
    frame = spark.range(900).select(
        F.when(F.col("id") % 3 != 0, F.col("id")).alias("who"), F.col("id").cast("string").alias("text"), "id")
    got = kpis.texts_by_author(frame.repartition(7), "who", "text", "id", per_part=50)
    parts = got.filter("who IS NULL").orderBy("part").collect()
    assert [p["part"] for p in parts] == list(range(6))
    assert [t for p in parts for t in p["texts"]] == [str(i) for i in range(0, 900, 3)]
    assert {len(p["texts"]) for p in parts} == {50}
    assert got.filter("who IS NOT NULL AND part != 0").count() == 0


# Words ------------------------------------------------------------------------------------------

GOOD, BAD = ["good", "love"], ["bad", "hate"]


@pytest.fixture(scope="module")
def titles(spark):
    random.seed(3)
    vocabulary = [a + b for a in ("good", "bad", "cat", "dog", "sky", "sun", "red", "tin") for b in ("", "s", "ly")]
    data = []
    for i in range(400):
        text = " ".join(random.choice(vocabulary) for _ in range(random.randrange(0, 9))) + (" everywhere" if i % 2 else "")
        day = date(2025, 1, 1) + timedelta(days=min(random.randrange(60), random.randrange(60)))
        data.append((str(i), day, text, float(random.randrange(-5, 30)), float(random.randrange(30)), float(random.randrange(20)), "comment" if i % 10 == 9 else "text"))
    frame = spark.createDataFrame(data, "post_id STRING, created_date DATE, title STRING, score DOUBLE, ups DOUBLE, num_comments DOUBLE, post_type STRING")
    return data, words.scored_titles(frame, "title", GOOD, BAD)


def brute(data):
    stats = defaultdict(lambda: dict(n=0, s=0.0, e=0.0, c=0.0, pos=0, neg=0, days=Counter(), months=defaultdict(list)))
    days = set()
    for _, day, text, score, ups, comments, kind in data:
        if kind == "comment":
            continue
        days.add(day)
        tokens = [t for t in text.split()]
        sentiment = (sum(t in GOOD for t in tokens) - sum(t in BAD for t in tokens)) / len(tokens) if tokens else 0.0
        for word in set(tokens):
            w = stats[word]
            w["n"] += 1
            w["s"] += sentiment
            w["e"] += ups + comments + max(score, 0)
            w["c"] += comments / (abs(score) + 1)
            w["pos"] += sentiment > 0
            w["neg"] += sentiment < 0
            w["days"][day] += 1
            w["months"][day.strftime("%Y-%m")].append(sentiment)
    pool = sorted(stats, key=lambda w: (-stats[w]["n"], w))
    return stats, pool, sorted(days)


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert x == pytest.approx(y) if isinstance(y, float) else x == y


def test_controversial_best_and_avoid(titles):
    data, scored = titles
    stats, pool, _ = brute(data)
    mean = {w: {k: v[k] / v["n"] for k in ("s", "e", "c", "pos", "neg")} for w, v in stats.items()}

    def best_of(scores, k=8):
        return sorted(scores, key=lambda w: (-round(scores[w], 9), w))[:k]

    c = {w: mean[w]["c"] for w in pool[:12]}
    close([tuple(r) for r in words.controversial_words(scored).collect()],
          [(w, stats[w]["n"], c[w]) for w in best_of(c)])
    some = [w for w in pool[:60] if stats[w]["n"] >= 5 and mean[w]["s"] > 0]
    top = max(mean[w]["e"] for w in some)
    chance = {w: .55 * mean[w]["s"] + .3 * mean[w]["e"] / top + .15 * mean[w]["pos"] for w in some}
    close([tuple(r) for r in words.best_topics(scored).collect()],
          [(w, stats[w]["n"], mean[w]["s"], mean[w]["e"], mean[w]["pos"], chance[w]) for w in best_of(chance)])
    some = [w for w in pool[:80] if stats[w]["n"] >= 5 and not (mean[w]["s"] >= 0 and mean[w]["neg"] < .03 and mean[w]["c"] < .5)]
    top = max(mean[w]["c"] for w in some)
    shun = {w: .45 * max(-mean[w]["s"], 0) + .3 * mean[w]["neg"] + .25 * mean[w]["c"] / top for w in some}
    close([tuple(r) for r in words.avoid_topics(scored).collect()],
          [(w, stats[w]["n"], mean[w]["s"], mean[w]["neg"], mean[w]["c"], shun[w]) for w in best_of(shun)])


def test_heatmap_has_every_cell(titles):
    data, scored = titles
    stats, pool, days = brute(data)
    months = sorted({d.strftime("%Y-%m") for d in days})
    want = []
    for w in sorted(pool[:8]):
        for m in months:
            cell = stats[w]["months"].get(m, [])
            want.append((w, m, len(cell), sum(cell) / len(cell) if cell else 0.0))
    close(rows(words.sentiment_heatmap(scored), "topic", "bucket", "count", "avg_sentiment"), want)


def slope(ys):
    n, xs = len(ys), range(len(ys))
    below = n * sum(x * x for x in xs) - sum(xs) ** 2
    return (n * sum(x * y for x, y in zip(xs, ys)) - sum(xs) * sum(ys)) / below if below else 0.0


def test_dying_trends_and_timelines(titles):
    data, scored = titles
    stats, pool, days = brute(data)
    dying = []
    for w in pool[:25]:
        ys = [stats[w]["days"].get(d, 0) for d in days]
        n, peak = len(ys), max(ys)
        half = max(1, n // 2)
        early, late = sum(ys[:half]) / half, sum(ys[half:]) / max(n - half, 1)
        if (peak >= 3 and ys.index(peak) <= n - 3 and (ys[-1] + ys[-2]) / 2 <= .55 * peak
                and slope(ys) < -.02 and late < .85 * early):
            dying.append((w, slope(ys), ys[-1], peak, ys[-1] / peak, "dying"))
    dying.sort(key=lambda r: (r[1], r[4], r[0]))
    assert dying
    close([tuple(r) for r in trends.dying_trends(scored).collect()], dying[:8])
    got = rows(trends.saturation_timeline(scored), "word", F.col("bucket"), "count", "total")
    three = [r[0] for r in dying[:3]]
    want = sorted((w, d, stats[w]["days"].get(d, 0), sum(stats[v]["days"].get(d, 0) for v in three)) for w in three for d in days)
    assert got == want
    got = rows(trends.word_timeline(scored), "word", "bucket", "count")
    assert got == sorted((w, d, stats[w]["days"].get(d, 0)) for w in pool[:5] for d in days)
    one = rows(trends.word_timeline(scored, " Cat "), "word", "bucket", "count", "total")
    assert one == [("cat", d, stats["cat"]["days"].get(d, 0), stats["cat"]["days"].get(d, 0)) for d in days]


def daily(spark, words_by_day):
    data = []
    for day, texts in enumerate(words_by_day):
        data += [(date(2025, 3, 1) + timedelta(days=day), text, "text") for text in texts]
    return words.scored_titles(spark.createDataFrame(data, "created_date DATE, title STRING, post_type STRING"))


@pytest.mark.parametrize(
    ("counts", "dying"),
    [
        ([9, 8, 7, 2, 1, 0], True),
        ([3, 3, 0, 0], True),
        ([2, 2, 0, 0], False),        # peak too low
        ([0, 0, 9, 9, 0], False),     # peak on one of the last two days
        ([5, 5, 5, 5, 5], False),     # flat
        ([9, 1, 9, 1, 9], False),     # does not fall
        ([9, 0], False),              # too short
    ],
)
def test_dying_rule(spark, counts, dying):
    scored = daily(spark, [["word"] * n + ["filler"] for n in counts])
    found = {row["topic"] for row in trends.dying_trends(scored).collect()}
    assert ("word" in found) == dying


def test_declining_words_without_slope_come_last(spark):
    data = [("up", d, d) for d in range(1, 5)] + [("down", d, 9 - d) for d in range(1, 5)] + [("once", 2, 50)]
    frame = spark.createDataFrame(data, "word STRING, d INT, word_count BIGINT").select(
        "word", F.make_timestamp_ntz(F.lit(2025), F.lit(1), "d", F.lit(0), F.lit(0), F.lit(0)).alias("time_range"), "word_count")
    assert {r["word"] for r in trends.declining_words(frame, 1).collect()} == {"down"}
    assert {r["word"] for r in trends.declining_words(frame, 2).collect()} == {"down", "up"}
    last = trends.declining_words(frame, 3).filter("word = 'once'").collect()
    assert len(last) == 1 and last[0]["slope"] is None
    assert trends.declining_words(frame, 1).first()["slope"] == pytest.approx(-1 / 86400)


# Series -------------------------------------------------------------------------------------------


def test_zero_fill_is_words_times_days_and_has_no_cross_join(spark):
    points = spark.createDataFrame([("a", 1, 5), ("b", 2, 6), ("z", 9, 7)], "w STRING, d INT, n INT")
    keys_ = spark.createDataFrame([("a",), ("b",), ("none",)], "w STRING")
    days = spark.createDataFrame([(1,), (2,), (3,), (3,)], "d INT")
    grid = grids.zero_fill(points, keys_, days, "w", "d", ["n"])
    assert grid.count() == 9
    assert rows(grid.filter("n > 0"), "w", "d", "n") == [("a", 1, 5), ("b", 2, 6)]
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert grids.zero_fill(points, keys_.limit(0), days, "w", "d", ["n"]).count() == 0
    many = spark.range(500).select(F.col("id").cast("string").alias("w"))
    assert grids.zero_fill(points, many, days, "w", "d", ["n"]).count() == 1500
    assert series.series_for_top(points, spark.createDataFrame([("a",), ("z",)], "w STRING"), "w").count() == 2


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 7, 10, 11, 50])
@pytest.mark.parametrize("length", [1, 2, 10, 11])
def test_sample_series(spark, n, length):
    frame = spark.range(length).select((F.col("id") * 3).alias("t"))
    if n <= 0:
        want = []
    elif length <= n:
        want = list(range(length))
    elif n == 1:
        want = [length - 1]
    else:
        want = sorted({0, length - 1, *(round(i * (length - 1) / (n - 1)) for i in range(n))})
    assert [t // 3 for (t,) in rows(series.sample_series(frame, "t", n), "t")] == want


def test_peak_smooth_and_merge(spark):
    frame = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 5, 0, 2])] + [("b", 0, 9)], "k STRING, t INT, v INT")
    assert rows(series.peak_smooth(frame, "k", "t", "v"), "k", "t", "smoothed") == [
        ("a", 0, 5), ("a", 1, 5), ("a", 2, 5), ("a", 3, 2), ("b", 0, 9)]
    left = spark.createDataFrame([(1, 4), (2, 5)], "b INT, n INT")
    right = spark.createDataFrame([(2, 6), (3, 7)], "b INT, n INT")
    assert rows(series.merge_timelines(left, right, "b", "n", ("x", "y")), "*") == [(1, 4, 0), (2, 5, 6), (3, 0, 7)]


def test_word_series_counts_posts_or_uses(spark):
    frame = spark.createDataFrame([("Cat cat dog", "2025-01-01 00:09:59", 1.0), ("cat", "2025-01-01 00:10:00", 0.0), ("cat", None, 1.0), (None, "2025-01-01 00:00:00", 1.0)], "text STRING, t STRING, score DOUBLE").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    per_post = series.word_series(frame)
    assert rows(per_post, "word", F.minute("time_range"), "avg_vader_sentiment_score", "word_count") == [
        ("cat", 0, 1.0, 1), ("cat", 10, 0.0, 1), ("dog", 0, 1.0, 1)]
    assert rows(series.word_series(frame, count="occurrences"), "word", F.minute("time_range"), "word_count") == [
        ("cat", 0, 2), ("cat", 10, 1), ("dog", 0, 1)]


def test_sentiment_series_may_be_weighted(spark):
    frame = spark.createDataFrame([("Cat", 1, 1.0, 3), ("cat", 1, 0.0, 1), ("dog", 1, 9.0, 9)], "word STRING, h INT, avg_vader_sentiment_score DOUBLE, word_count BIGINT").withColumn("time_range", F.make_timestamp_ntz(F.lit(2025), F.lit(1), F.lit(1), "h", F.lit(0), F.lit(0)))
    assert series.word_sentiment(frame, "CAT").first()["sentiment_score"] == 0.5
    assert series.word_sentiment(frame, "CAT", weighted=True).first()["sentiment_score"] == 0.75


def test_top_per_bucket_ties_go_by_name(spark):
    frame = spark.createDataFrame([(t, n, float(r)) for t in (1, 2) for n, r in (("b", 2), ("a", 2), ("c", 1), ("d", 3))], "time_bucket INT, topic_name STRING, average_like_to_comment_ratio DOUBLE")
    got = series.top_per_bucket(frame, 2)
    assert rows(got, "time_bucket", "rn", "topic_name") == [(1, 1, "d"), (1, 2, "a"), (2, 1, "d"), (2, 2, "a")]
    worst = series.top_per_bucket(frame, 1, descending=False)
    assert rows(worst, "topic_name") == [("c",), ("c",)]
    assert rows(series.range_controversy(frame, 2), "topic_name", "value") == [("a", 2.0), ("d", 3.0)]


def test_rollup_weeks_start_on_monday(spark):
    frame = spark.createDataFrame([("2025-01-05", 1), ("2025-01-06", 2), ("2025-02-01", 4)], "d STRING, n INT").withColumn("d", F.to_date("d"))
    assert rows(series.rollup_series(frame, "d", ["n"], "week"), F.col("week").cast("string"), "n") == [
        ("2024-12-30", 1), ("2025-01-06", 2), ("2025-01-27", 4)]
    assert rows(series.rollup_series(frame, "d", ["n"]), F.col("month").cast("string"), "n") == [
        ("2025-01-01", 3), ("2025-02-01", 4)]


# Risk, valence, pairs, drift, snapshots ---------------------------------------------------------------


def test_sentence_risk(spark):
    sentences = spark.createDataFrame([(1, "Good, good bad!"), (2, "unknown")], "id INT, text STRING")
    latest = spark.createDataFrame([("Good", 1, 0.9), ("good", 2, 0.5), ("BAD", 1, -0.3)], "word STRING, time_range INT, avg_vader_sentiment_score DOUBLE")
    assert rows(risk.latest_word_scores(latest), "word", "score") == [("bad", -0.3), ("good", 0.5)]
    scored = risk.score_sentences(sentences, latest, "id", "text")
    assert rows(scored, "id", "word", "uses", "score") == [(1, "bad", 1, -0.3), (1, "good", 2, 0.5), (2, "unknown", 1, 0.0)]
    got = risk.decide(risk.sentence_risk(scored, "id")).orderBy("id").collect()
    assert got[0]["avg_score"] == pytest.approx(0.7 / 3) and got[0]["neg_frac"] == pytest.approx(1 / 3)
    assert got[0]["min_score"] == -0.3 and got[0]["gauge"] == "Avoid" and got[1]["gauge"] == "Risky"


def test_wordlist_risk(spark):
    texts = ["Good, good bad!", "good love", "good cat", "cat", "  ", "_hate_ (bad)"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")
    got = risk.wordlist_risk(frame, "text")
    close(rows(got, "id", "avg_score", "neg_frac", "min_score"), [
        (0, 1 / 3, 1 / 3, -1.0), (1, 1.0, 0.0, 1.0), (2, 0.5, 0.0, 0.0), (3, 0.0, 0.0, 0.0), (5, -1.0, 1.0, -1.0)])
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def valence_brute(text, lexicon):
    total, out = 0.0, text.lower().replace("'", "").split()
    for i, word in enumerate(out):
        if word in lexicon:
            total += lexicon[word] * (-0.74 if set(out[max(0, i - 3):i]) & set(NEGATIONS) else 1)
    return max(-1, min(1, total / (total * total + 15) ** 0.5))


def test_valence_score(spark):
    lexicon = {"good": 1.9, "bad": -2.5, "great": 3.1, "not": -0.5}
    texts = ["good", "not good", "not a b good", "not a b c good", "Don't say bad bad", "great great great bad",
             "", "nothing", "good not bad not good"]
    frame = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "id INT, text STRING").repartition(3)
    table = spark.createDataFrame(list(lexicon.items()), "word STRING, valence DOUBLE")
    scored = valence.valence_score(frame, "text", table, "id")
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    got = dict(rows(scored, "id", "score"))
    assert got.pop(99) == 0.0
    assert got == pytest.approx({i: valence_brute(text, lexicon) for i, text in enumerate(texts)})
    # A word listed twice counts with the mean of its valences; null valences do not count.
    twice = table.selectExpr("word", "explode(array(valence - 1, valence + 1, null)) AS valence")
    again = dict(rows(valence.valence_score(frame, "text", twice, "id"), "id", "score"))
    assert again.pop(99) == 0.0 and again == pytest.approx(got)


CONTEXT_LEXICON = {"good": 1.9, "great": 3.1, "bad": -2.5, "sad": -2.1, "no": -1.2, "kinda": 1.0}


def compound(total, marks=0.0):
    total += (total > 0) * marks - (total < 0) * marks
    return total / math.sqrt(total * total + 15)


@pytest.mark.parametrize("text, total, marks", [
    ("it is good", 1.9, 0), ("it is BAD", -2.5 - 0.733, 0), ("IT IS BAD", -2.5, 0),  # capitals
    ("very good", 1.9 + 0.293, 0), ("very bad", -2.5 - 0.293, 0), ("slightly good", 1.9 - 0.293, 0),
    ("very big good", 1.9 + 0.95 * 0.293, 0), ("very big old good", 1.9 + 0.9 * 0.293, 0),
    ("very big old dog good", 1.9, 0), ("VERY good", 1.9 + 0.293 + 0.733, 0),
    ("VERY bad", -2.5 - 0.293 - 0.733, 0), ("kinda good", 1.9, 0),  # a word of the lexicon is no degree
    ("not good", 1.9 * -0.74, 0), ("isn't a good", 1.9 * -0.74, 0), ("Don’t be so sad", (-2.1 - 0.293) * -0.74, 0),
    ("not a very good", (1.9 + 0.293) * -0.74, 0), ("not one two three good", 1.9, 0),
    ("never so good", (1.9 + 0.293) * 1.5, 0), ("never ever this good", 1.9 * 1.25, 0),
    ("least good", 1.9 * -0.74, 0), ("at least good", 1.9, 0), ("the very least good", 1.9 + 0.95 * 0.293, 0),
    ("good but bad", 0.5 * 1.9 - 1.5 * 2.5, 0), ("But good", 1.5 * 1.9, 0),  # contrast
    ("good!", 1.9, 0.292), ("bad!!", -2.5, 0.584), ("great !!!!!!", 3.1, 1.168),
    ("good?", 1.9, 0), ("good??", 1.9, 0.36), ("bad ?????", -2.5, 0.96), ("nothing!!", 0.0, 0.584),
    ("(good), 'bad'. :)", 1.9 - 2.5, 0), ("", 0.0, 0), (None, 0.0, 0), (" ! ", 0.0, 0.292),
])
def test_valence_rules(spark, text, total, marks):
    lexicon = spark.createDataFrame(list(CONTEXT_LEXICON.items()), "word STRING, valence DOUBLE")
    frame = spark.createDataFrame([(1, text), (2, "good")], "id INT, text STRING")
    got = {r["id"]: r["score"] for r in valence.valence_in_context(frame, "text", lexicon, "id").collect()}
    assert got[1] == pytest.approx(compound(total, marks)) and got[2] == pytest.approx(compound(1.9))


def test_context_is_worked_out_in_columns(spark):
    """No lists per text after the shuffle; rows that share a key still count together."""
    lexicon = spark.createDataFrame(list(CONTEXT_LEXICON.items()), "word STRING, valence DOUBLE")
    frame = spark.createDataFrame(
        [(1, "not good very bad"), (1, "not good very bad"), (2, "a good BAD"), (None, "good")], "id INT, text STRING")
    scored = valence.valence_in_context(frame, "text", lexicon, "id")
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "aggregate(" not in plan
    twice = compound(2 * (1.9 + -2.5 - 0.293) * -0.74)
    got = sorted((r["id"] or 0, r["score"]) for r in scored.collect())
    assert [i for i, _ in got] == [0, 1, 1, 2]
    assert [x for _, x in got] == pytest.approx([0.0, twice, twice, compound(1.9 - 2.5 - 0.733)])


def test_times_that_cannot_be_dated_are_null(spark):
    texts = ["1735689600", "1735689600.5", "NaN", "Infinity", "-Infinity", "1735689600000", "x", None,
             "253402300799", "-62135596800", "253402300800"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id INT, t STRING")
    got = dict(rows(frame.select("id", F.year(times.seconds_ts("t")).alias("y")), "id", "y"))
    assert got == {0: 2025, 1: 2025, **dict.fromkeys((2, 3, 4, 5, 6, 7, 10)), 8: 9999, 9: 1}


def test_untitled_posts_count_in_the_bundle(spark):
    frame = spark.createDataFrame(
        [("good cat", "2025-01-01", 1.0), (None, "2025-01-01", 2.0)], "title STRING, d STRING, score DOUBLE"
    ).select("title", F.to_date("d").alias("created_date"), F.year(F.to_date("d")).alias("year"),
             F.month(F.to_date("d")).alias("month"), "score", F.lit(0.0).alias("ups"),
             F.lit(0.0).alias("num_comments"), F.lit("text").alias("post_type"))
    bundle = insights.feature_insights(frame, positive=["good"], negative=["bad"])
    figures = bundle["sentiment_kpis"].first()
    single = kpis.sentiment_kpis(words.scored_titles(frame, "title", ["good"], ["bad"])).first()
    assert figures["avg_sentiment"] == pytest.approx(single["avg_sentiment"]) == pytest.approx(0.25)
    counted = insights.word_days(words.scored_titles(frame, "title", ["good"], ["bad"]))
    assert counted.filter(F.col("word") == insights.EVERY_POST).first()["count"] == 2
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_pairs(spark):
    threads = spark.createDataFrame([
        ((({"text": "a" * 20, "embed": None},), [((({"text": "b" * 20, "embed": None}),),), ((({"text": "short", "embed": None}),),)]),),
        ((({"text": "c" * 20, "embed": {"images": [{"alt": "x"}]}},), [((({"text": "d" * 20, "embed": None}),),)]),),
        ((({"text": "e" * 20, "embed": None},), None),)],
        "thread STRUCT<post: STRUCT<record: STRUCT<text: STRING, embed: STRUCT<images: ARRAY<STRUCT<alt: STRING>>>>>, replies: ARRAY<STRUCT<post: STRUCT<record: STRUCT<text: STRING, embed: STRUCT<images: ARRAY<STRUCT<alt: STRING>>>>>>>>")
    assert pairs.reply_pairs(threads).count() == 3
    assert rows(pairs.training_pairs(pairs.reply_pairs(threads)), "*") == [("a" * 20, "b" * 20)]


def test_schema_drift_reads_all_lines(spark):
    old = spark.createDataFrame([('{"a": 1}',)] * 300 + [('{"rare": 1}',), ("broken{",)], "value STRING")
    new = spark.createDataFrame([('{"a": 1, "b": {"c": 2}}',)], "value STRING")
    assert rows(drift.schema_drift(old, new), "change", "key") == [("added", "b"), ("missing", "rare")]


def test_snapshots(spark, titles):
    data, scored = titles
    frame = scored.withColumns({"downs": F.lit(0.0), "engagement": F.col("ups")}).drop("tokens", "sentiment")
    tables = snapshots.snapshot_tables(frame, 3, "created_date", 4)
    assert set(tables) == {"kpis", "content_split", "top_keywords", "timeline", "top_communities"}
    assert [r["rank"] for r in tables["top_keywords"].orderBy("rank").collect()] == [1, 2, 3, 4]
    assert {r["run_id"] for t in tables.values() for r in t.collect()} == {3}


def test_insights_agree_with_the_single_operators(spark, titles):
    data, scored = titles
    frame = scored.drop("tokens", "sentiment").withColumns({"year": F.year("created_date"), "month": F.month("created_date")})
    report = insights.feature_insights(frame, positive=GOOD, negative=BAD)
    alone = {
        "sentiment_kpis": kpis.sentiment_kpis(scored),
        "sentiment_timeline": kpis.sentiment_timeline(scored),
        "word_popularity": trends.word_timeline(scored),
        "topic_sentiment_heatmap": words.sentiment_heatmap(scored),
        "controversial_topics": words.controversial_words(scored),
        "best_topics_to_post": words.best_topics(scored),
        "topics_to_avoid": words.avoid_topics(scored),
        "trend_summary": trends.dying_trends(scored),
        "trend_saturation": trends.saturation_timeline(scored),
    }
    for name, want in alone.items():
        columns = sorted(want.columns)
        assert sorted(report[name].columns) == columns
        close(rows(report[name], *columns), rows(want, *columns))
    assert report["trend_series"].select("word").distinct().count() == report["trend_summary"].count()
    february = insights.feature_insights(frame, 2025, "2", "cat", GOOD, BAD)
    assert rows(february["word_popularity"], "word", "bucket", "count", "total") == rows(
        trends.word_timeline(scored.filter(F.month("created_date") == 2), "cat"), "word", "bucket", "count", "total")


def test_overviews(spark, titles):
    data, scored = titles
    frame = scored.withColumns({"year": F.year("created_date"), "month": F.month("created_date"), "downs": F.lit(0.0), "engagement": F.col("ups"), "controversiality": F.lit(1)})
    forum = insights.forum_overview(frame, 2025, "1")
    assert forum["kpis"].first()["total_posts"] + forum["kpis"].first()["total_comments"] < 360
    assert rows(forum["available_years"], "year") == [(2025,)]
    remarks = insights.comments_overview(frame)
    assert remarks["kpis"].first()["controversial_percent"] == 100.0
    events = spark.createDataFrame([("app.bsky.feed.post", "2025-01-01", "sky high", "text"), ("app.bsky.feed.like", "2025-01-02", None, None), ("x", "2025-01-03", None, None)], "c STRING, t STRING, text STRING, m STRING").withColumn("at", F.col("t").cast("timestamp_ntz"))
    feed = insights.feed_overview(events, "at", "c", "text", "m")
    assert tuple(feed["kpis"].select("total_posts", "total_likes", "total_engagement", "active_days").first()) == (1, 1, 2, 2)
    assert rows(feed["top_keywords"], "word") == [("high",), ("sky",)]
