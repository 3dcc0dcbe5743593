"""Row filters. All are plain column predicates, so Catalyst can push them into the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hearsay.functions.scores import like_reply_ratio
from hearsay.functions.text import as_col, long_enough, tokens_ws
from hearsay.functions.values import root_author
from hearsay.functions.vocab import FOLLOW_COLLECTION, LIKE_COLLECTION, POST_COLLECTION


def created_posts(
    df: DataFrame,
    collection: Column | str = "commit.collection",
    operation: Column | str = "commit.operation",
) -> DataFrame:
    return df.filter(
        (as_col(collection) == POST_COLLECTION) & (as_col(operation) == "create")
    )


def known_collections(
    df: DataFrame, collection: Column | str = "commit.collection", allowed: list[str] | None = None
) -> DataFrame:
    """Keep posts, likes and follows."""
    allowed = allowed or [POST_COLLECTION, LIKE_COLLECTION, FOLLOW_COLLECTION]
    return df.filter(as_col(collection).isin(allowed))


def valid_year(df: DataFrame, ts: Column | str, low: int = 2025, high: int = 2026) -> DataFrame:
    """Keep rows whose time parsed and whose year is in range.

    The bounds are compared with the time itself, not with its year, so that a Parquet
    scan can skip row groups.
    """
    ts = as_col(ts)
    return df.filter(
        (ts >= F.lit(f"{low}-01-01 00:00:00").cast("timestamp_ntz"))
        & (ts < F.lit(f"{high + 1}-01-01 00:00:00").cast("timestamp_ntz"))
    )


def parse_months(months: str | None) -> list[int]:
    """``"1,2,3"`` as a sorted list without repeats; a month outside 1-12 is an error."""
    numbers = sorted({int(part) for part in (months or "").split(",") if part.strip()})
    if numbers and not (1 <= numbers[0] and numbers[-1] <= 12):
        raise ValueError("months must lie between 1 and 12")
    return numbers


def calendar_filter(
    df: DataFrame, year: str | int = "overall", months: str | list[int] | None = None
) -> DataFrame:
    """Keep one year (or all: ``overall``) and the listed months (or all)."""
    if str(year) != "overall":
        df = df.filter(F.col("year") == int(year))
    chosen = parse_months(months) if isinstance(months, str) or months is None else months
    return df.filter(F.col("month").isin(chosen)) if chosen else df


def between_ts(df: DataFrame, ts: Column | str, low, high) -> DataFrame:
    """Keep times from ``low`` to ``high``, both included; ``None`` leaves a side open."""
    ts = as_col(ts)
    if low is not None:
        df = df.filter(ts >= F.lit(low).cast("timestamp_ntz"))
    if high is not None:
        df = df.filter(ts <= F.lit(high).cast("timestamp_ntz"))
    return df


def link_tokens(df: DataFrame, text: str, prefix: str, out: str = "token") -> DataFrame:
    """One row per distinct token of a post that starts with ``prefix``."""
    hits = F.filter(tokens_ws(text), lambda token: token.startswith(prefix))
    return df.withColumn(out, F.explode(hits))


def hashtags(df: DataFrame, text: str, out: str = "token") -> DataFrame:
    return link_tokens(df, text, "#", out)


def controversial(
    df: DataFrame,
    likes: str = "like_count",
    replies: str = "reply_count",
    min_replies: int = 50,
    out: str = "like_to_comment_ratio",
) -> DataFrame:
    """Posts with enough replies and a ratio other than zero; adds the ratio."""
    return df.withColumn(out, like_reply_ratio(likes, replies)).filter(
        (F.col(out) != 0) & (F.col(replies) >= min_replies)
    )


def drop_stopwords(df: DataFrame, column: str, words: list[str]) -> DataFrame:
    """Drop rows whose word is a stop word; rows without a word go too."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(words))


def min_len(df: DataFrame, column: Column | str, n: int) -> DataFrame:
    return df.filter(long_enough(column, n))


def without_images(df: DataFrame, *image_columns: Column | str) -> DataFrame:
    """Keep rows where none of the image fields is set."""
    for column in image_columns:
        df = df.filter(as_col(column).isNull())
    return df


def split_roots(
    df: DataFrame, root_uri: Column | str = "commit.record.reply.root.uri", out: str = "root_id"
) -> tuple[DataFrame, DataFrame]:
    """Thread roots and replies; both carry the author of the root."""
    marked = df.withColumn(out, root_author(root_uri))
    return (
        marked.filter(F.col(out) == "none_error"),
        marked.filter(F.col(out) != "none_error"),
    )


def self_replies(df: DataFrame, author: str = "did", root_id: str = "root_id") -> DataFrame:
    return df.filter(F.col(author) == F.col(root_id))


def posts_only(facts: DataFrame, titled: bool = False) -> DataFrame:
    """Leave comments out; with ``titled`` also posts without a title."""
    kept = facts.filter(F.col("post_type") != "comment")
    if titled:
        kept = kept.filter(F.col("title").isNotNull() & (F.col("title") != ""))
    return kept


def conform(df: DataFrame, schema: StructType | str) -> DataFrame:
    """The columns of ``schema``, in its order and with its types."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    return df.select(
        *[F.col(field.name).cast(field.dataType).alias(field.name) for field in schema]
    )


def embeddable(df: DataFrame, text: Column | str, cid: Column | str) -> DataFrame:
    """Rows with both a text and a content id; a null struct on the way counts as missing."""
    kept = df
    for column in (as_col(text), as_col(cid)):
        kept = kept.filter(column.isNotNull() & (column != ""))
    return kept


def hash_sample(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """About ``share`` of the rows, by a hash of their key. Unlike ``DataFrame.sample`` it draws the
    same rows whatever the file layout, and all or none of a key's rows."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return df.filter(place < int(share * 2**32))
