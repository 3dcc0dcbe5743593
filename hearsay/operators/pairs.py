"""Post and reply pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.operators.filters import without_images


def reply_pairs(threads: DataFrame) -> DataFrame:
    """One row per post and reply of a nested thread; threads without replies give none."""
    rows = threads.select(
        F.col("thread.post.record").alias("post"),
        F.explode("thread.replies").alias("reply"),
    )
    return rows.select(
        F.col("post.text").alias("post_text"),
        F.col("reply.post.record.text").alias("comment_text"),
        F.col("post.embed.images").alias("post_images"),
        F.col("reply.post.record.embed.images").alias("comment_images"),
    )


def turn_pairs(
    turns: DataFrame,
    thread: str,
    turn: str,
    text: str,
    role: str,
    roles: tuple[str, str] = ("user", "assistant"),
) -> DataFrame:
    """Each turn of the first role with the next turn, if that has the second role.

    An equi join on thread and turn number: both sides are hashed by the pair, so a long
    thread is spread over the tasks.
    """
    first = turns.filter(F.col(role) == roles[0]).select(
        thread, turn, F.col(text).alias("post_text")
    )
    second = turns.filter(F.col(role) == roles[1]).select(
        thread, (F.col(turn) - 1).alias(turn), F.col(text).alias("comment_text")
    )
    return first.join(second, [thread, turn])


def training_pairs(pairs: DataFrame, longer_than: int = 15) -> DataFrame:
    """Pairs without images whose texts are both longer than ``longer_than``."""
    images = [name for name in ("post_images", "comment_images") if name in pairs.columns]
    kept = without_images(pairs, *images)
    return kept.filter(
        (F.length("post_text") > longer_than) & (F.length("comment_text") > longer_than)
    ).drop(*images)
