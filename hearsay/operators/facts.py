"""Raw forum records to fact rows: one projection, no driver loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.functions.media import forum_post_type
from hearsay.functions.scores import engagement
from hearsay.functions.times import seconds_ts
from hearsay.functions.values import num_or_zero, row_uid, text_or_empty


def _dated(df: DataFrame, created: str) -> DataFrame:
    """UTC date parts; rows whose time is missing or bad are dropped."""
    at = seconds_ts(created)
    return df.withColumn("__at", at).filter(F.col("__at").isNotNull())


def _date_parts() -> list[Column]:
    return [
        F.to_date("__at").alias("created_date"),
        F.year("__at").alias("year"),
        F.month("__at").alias("month"),
    ]


def post_facts(
    posts: DataFrame,
    run_id: Column | int,
    comments: DataFrame | None = None,
    created: str = "created_utc",
) -> DataFrame:
    """Fact rows of posts; with ``comments`` these are added as rows of type ``comment``."""
    run = F.lit(run_id) if isinstance(run_id, int) else run_id
    poll = "poll_data" if "poll_data" in posts.columns else None
    kind = forum_post_type(
        post_hint="post_hint",
        is_video="is_video",
        url="url",
        domain="domain",
        url_overridden_by_dest="url_overridden_by_dest",
        selftext="selftext",
        is_gallery="is_gallery",
        crosspost_parent="crosspost_parent",
        poll_data=poll,
    )

    def rows(df: DataFrame, text: str, replies: Column, post_type: Column, label: str) -> DataFrame:
        return _dated(df, created).select(
            run.cast("bigint").alias("run_id"),
            row_uid(run, label, "id").alias("row_uid"),
            F.col("id").cast("string").alias("post_id"),
            *_date_parts(),
            text_or_empty(text).alias("title"),
            num_or_zero("score").alias("score"),
            num_or_zero("ups").alias("ups"),
            num_or_zero("downs").alias("downs"),
            replies.alias("num_comments"),
            engagement("ups", "downs", replies).alias("engagement"),
            post_type.alias("post_type"),
        )

    facts = rows(posts, "title", num_or_zero("num_comments"), kind, "post")
    if comments is None:
        return facts
    return facts.unionByName(rows(comments, "body", F.lit(0.0), F.lit("comment"), "comment"))


def comment_facts(
    comments: DataFrame, run_id: Column | int, created: str = "created_utc"
) -> DataFrame:
    run = F.lit(run_id) if isinstance(run_id, int) else run_id
    return _dated(comments, created).select(
        run.cast("bigint").alias("run_id"),
        row_uid(run, "comment", "id").alias("row_uid"),
        F.col("id").cast("string").alias("comment_id"),
        *_date_parts(),
        text_or_empty("body").alias("body"),
        num_or_zero("score").alias("score"),
        num_or_zero("ups").alias("ups"),
        num_or_zero("downs").alias("downs"),
        num_or_zero("controversiality", "int").alias("controversiality"),
    )
