"""Row functions on hand-made rows."""

import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from hearsay.functions import media, scores, text, times, values, vocab


def column(spark, rows, kind, expression):
    frame = spark.createDataFrame([(i, row) for i, row in enumerate(rows)], f"i INT, x {kind}")
    return [row[0] for row in frame.orderBy("i").select(expression).collect()]


def test_english_stopwords_are_sparks(spark):
    assert vocab.ENGLISH_STOPWORDS == StopWordsRemover.loadDefaultStopWords("english")
    assert len(vocab.default_stopwords()) == len({*vocab.ENGLISH_STOPWORDS, *vocab.SOCIAL_STOPWORDS})


def test_tokens_ws(spark):
    rows = ["  Big big\tDog\n", "", "   ", None, "a\u000bb"]
    assert column(spark, rows, "STRING", text.tokens_ws("x")) == [
        ["big", "dog"], [], [], None, ["a", "b"]]
    assert column(spark, rows[:1], "STRING", text.tokens_ws("x", unique=False, lower=False)) == [
        ["Big", "big", "Dog"]]


def test_tokens_clean(spark):
    rows = ["The U.S. café, R2D2 9lives x ok 2cool! rt via Dog dog-house", "Kelvin", ""]
    assert column(spark, rows, "STRING", text.tokens_clean("x")) == [
        ["caf", "r2d2", "dog", "house"], ["elvin"], []]
    assert column(spark, rows[:1], "STRING", text.tokens_clean("x", [], unique=False)) == [
        ["the", "caf", "r2d2", "ok", "rt", "via", "dog", "dog", "house"]]


def test_tokens_alpha(spark):
    rows = ["The CAFÉ isn't over: cats, cats & ox", None]
    assert column(spark, rows, "STRING", text.tokens_alpha("x")) == [["caf", "isn", "cats", "cats"], None]


def test_sentence_words(spark):
    rows = ['"Well," he said -- (no!) _x_', ".,!"]
    assert column(spark, rows, "STRING", text.sentence_words("x")) == [
        ["well", "he", "said", "--", "no", "_x_"], [""]]
    assert column(spark, ["_x_"], "STRING", text.sentence_words("x", vocab.EDGE_PUNCTUATION + "_")) == [["x"]]


def test_array_except_would_lose_repeats(spark):
    rows = [["a", "a", "b", "stop"]]
    assert column(spark, rows, "ARRAY<STRING>", text.without_words("x", ["stop"])) == [["a", "a", "b"]]


def test_langs(spark):
    rows = [["en"], ["en", "fr"], ["en-US"], [], None]
    assert column(spark, rows, "ARRAY<STRING>", text.lang_any("x")) == [True, True, False, False, None]
    assert column(spark, rows, "ARRAY<STRING>", text.lang_only("x")) == [True, False, False, False, None]
    raw = ['["en"]', '["fr","en"]', '["en-US"]', '["zen"]']
    assert column(spark, raw, "STRING", text.lang_raw("x")) == [True, True, False, False]


def test_scrub_and_length(spark):
    assert column(spark, ["a\u0000b", "", None], "STRING", text.scrub_nul("x")) == ["ab", "", None]
    assert column(spark, [" \t abc \n", "abcd"], "STRING", text.long_enough("x", 4)) == [False, True]


def test_root_author(spark):
    uris = [None, "at://did:1/post/2", "at://", "at:/", "at://abc", "at:///x", "", "12345a/b/c", "at://a\nb/c"]
    assert column(spark, uris, "STRING", values.root_author("x")) == [
        "none_error", "did:1", "error", "error", "error", "", "error", "a", "a\nb"]


@settings(max_examples=20, deadline=None)
@given(st.text(st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=40))
def test_uuid5_equals_python(spark, name):
    got = spark.range(1).select(values.uuid5(vocab.NAMESPACE_URL, F.lit(name))).first()[0]
    assert got == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_json_fields(spark):
    rows = ['{"a": {"b": "7"}}', '{"a": 1', '{"a": {"b": "x"}}', None]
    assert column(spark, rows, "STRING", values.json_field("x", "$.a.b", "int")) == [7, None, None, None]
    assert column(spark, ["3", "x", None], "STRING", values.num_or_zero("x")) == [3.0, 0.0, 0.0]


def test_times(spark):
    assert column(spark, [0, 1_700_000_000_123_456, -1], "BIGINT", times.iso_text(times.micros_ts("x"))) == [
        "1970-01-01T00:00:00", "2023-11-14T22:13:20", "1969-12-31T23:59:59"]
    assert column(spark, ["12.5", "x", None], "STRING", times.epoch_micros(times.seconds_ts("x"))) == [
        12_500_000, None, None]
    iso = ["2024-01-01T00:00:01Z", "2024-01-01T02:00:01+02:00", "yesterday", "", "12:30", None]
    assert column(spark, iso, "STRING", F.unix_micros(times.iso_ts("x"))) == [
        1_704_067_201_000_000, 1_704_067_201_000_000, None, None, None, None]


def test_times_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = column(spark, [0], "BIGINT", F.to_date(times.micros_ts("x")).cast("string"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == ["1970-01-01"]


def test_ratio_and_scores(spark):
    frame = spark.createDataFrame([(10, 4), (3, 0), (0, 5), (None, 5), (3, None)], "a BIGINT, b BIGINT")
    assert [r[0] for r in frame.select(scores.like_reply_ratio("a", "b")).collect()] == [2.5, 0.0, 0.0, None, None]
    assert [r[0] for r in frame.select(scores.controversy_score("a", F.lit(-4))).collect()] == [2, 0.6, 0, 0, 0.6]
    assert [r[0] for r in frame.select(scores.interest_value("a", "b", F.lit(-9))).collect()] == [14, 3, 5, 5, 3]
    assert [r[0] for r in frame.select(scores.engagement("a", F.lit(1), "b")).collect()] == [16, 5, 7, 7, 5]


def test_wordlist_sentiment(spark):
    rows = [["good", "good", "bad", "cat"], ["cat"], [], ["hate"]]
    assert column(spark, rows, "ARRAY<STRING>", scores.wordlist_sentiment("x")) == [0.25, 0.0, 0.0, -1.0]


def test_signed_score(spark):
    frame = spark.createDataFrame([("POSITIVE", 0.5), ("negative", 0.25), ("neutral", 0.9)], "l STRING, s DOUBLE")
    assert [r[0] for r in frame.select(scores.signed_score("l", "s")).collect()] == [0.5, -0.25, 0.0]


@pytest.mark.parametrize(
    ("avg", "neg", "low", "verdict", "gauge"),
    [
        (-0.05, 0.0, 0.0, "Do not post - rule 1", "Avoid"),
        (0.5, 0.40, 0.0, "Do not post - rule 1", "Avoid"),
        (0.5, 0.0, -0.25, "Do not post - rule 1", "Avoid"),
        (0.05, 0.0, 0.0, "Post - rule 2", "Safe"),
        (0.05, 0.25, 0.0, "Post - rule 2", "Risky"),
        (0.04, 0.0, 0.0, "Post - rule 2", "Risky"),
        (0.5, 0.1, -0.2, "Post - rule 2", "Risky"),
    ],
)
def test_decisions(spark, avg, neg, low, verdict, gauge):
    numbers = [F.lit(float(x)) for x in (avg, neg, low)]
    row = spark.range(1).select(scores.post_decision(*numbers), scores.risk_gauge(*numbers)).first()
    shown = f"(avg_score={avg:.4f}, neg_frac={neg:.2f}, min_score={low:.4f})."
    assert row[0] == f"Recommendation: {verdict} triggered {shown}"
    assert row[1] == gauge


@settings(max_examples=25, deadline=None)
@given(st.floats(-1, 1), st.integers(0, 400), st.floats(-1, 0))
def test_decision_numbers_are_printed_as_python_does(spark, avg, neg, low):
    neg = neg / 400
    text_ = spark.range(1).select(scores.post_decision(*[F.lit(float(x)) for x in (avg, neg, low)])).first()[0]
    assert text_.endswith(f"(avg_score={avg:.4f}, neg_frac={neg:.2f}, min_score={low:.4f}).")


POST = "post_hint STRING, is_video BOOLEAN, url STRING, domain STRING, url_overridden_by_dest STRING, selftext STRING, is_gallery BOOLEAN, crosspost_parent STRING, poll STRING"


@pytest.mark.parametrize(
    ("post", "kind"),
    [
        (("image", True, "x", None, None, "t", True, "p", "q"), "gallery"),
        (("image", True, "x", None, None, "t", False, "p", "q"), "video"),
        (("HOSTED:video", None, "x", None, None, None, None, None, None), "video"),
        ((None, None, "http://a/b.MP4?x=1", None, None, None, None, None, None), "video"),
        ((None, None, "http://a/b.mp4x", None, None, None, None, None, None), "link"),
        ((None, None, "http://a", "youtu.be", None, None, None, None, None), "video"),
        ((None, None, "http://a", None, "http://b/c.png", None, None, None, None), "image"),
        ((None, None, "http://imgur.com/a", None, None, None, None, None, None), "link"),
        ((None, None, "http://a", "imgur.com", None, None, None, None, None), "image"),
        ((None, None, None, None, None, None, None, None, "poll"), "poll"),
        (("poll", None, None, None, None, None, None, "t3", None), "poll"),
        ((None, None, "http://a", None, None, None, None, "t3", None), "crosspost"),
        (("link", None, None, None, None, "text", None, "", None), "link"),
        ((None, None, "http://a", None, None, "  \n", None, None, None), "link"),
        ((None, None, "http://a", None, None, "text", None, None, None), "text"),
        ((None, None, None, None, None, None, None, None, None), "other"),
    ],
)
def test_forum_post_types(spark, post, kind):
    frame = spark.createDataFrame([post], POST)
    names = [name for name in frame.columns if name != "poll"]
    expression = media.forum_post_type(**{name: name for name in names}, poll_data="poll")
    assert frame.select(expression).first()[0] == kind


@pytest.mark.parametrize(
    ("post", "kind"),
    [
        (("hi", False, None, None, None), "text"),
        (("  ", False, None, None, None), "other"),
        (("hi", True, "app.embed.Video", "x.png", "image/png"), "video"),
        (("hi", True, "app.embed.images", "x.mp4", None), "photo"),
        (("hi", True, "app.embed.external", "http://x/a.MP4", "image/png"), "video"),
        (("hi", True, "app.embed.external", "http://x/a.webp", "video/mp4"), "photo"),
        (("hi", True, "app.embed.external", "http://x", "video/mp4"), "video"),
        (("hi", True, None, None, "IMAGE/png"), "photo"),
        (("hi", True, None, None, None), "other"),
    ],
)
def test_feed_media_types(spark, post, kind):
    frame = spark.createDataFrame([post], "t STRING, e BOOLEAN, k STRING, u STRING, m STRING")
    assert frame.select(media.feed_media_type("t", F.col("e"), "k", "u", "m")).first()[0] == kind
