"""What medium a post is: ordered rules as one CASE expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearsay.functions.text import as_col, strip
from hearsay.functions.values import text_or_empty
from hearsay.functions.vocab import (
    IMAGE_DOMAIN, IMAGE_EXTENSION, IMAGE_MARKS, VIDEO_DOMAIN, VIDEO_EXTENSION, VIDEO_HINTS,
    VIDEO_MARKS,
)


def forum_post_type(
    *,
    post_hint: Column | str,
    is_video: Column | str,
    url: Column | str,
    domain: Column | str,
    url_overridden_by_dest: Column | str,
    selftext: Column | str,
    is_gallery: Column | str,
    crosspost_parent: Column | str,
    poll_data: Column | str | None = None,
) -> Column:
    """gallery, video, image, poll, crosspost, link, text or other; the first that fits."""
    hint = F.lower(text_or_empty(post_hint))
    link = F.lower(text_or_empty(url))
    target = F.lower(text_or_empty(url_overridden_by_dest))
    host = F.lower(text_or_empty(domain))
    body = strip(text_or_empty(selftext))
    has_poll = F.lit(False) if poll_data is None else as_col(poll_data).isNotNull()

    def any_match(pattern: str, *columns: Column) -> Column:
        found = F.lit(False)
        for column in columns:
            found = found | column.rlike(pattern)
        return found

    video = (
        F.coalesce(as_col(is_video), F.lit(False))
        | hint.isin(VIDEO_HINTS)
        | any_match(VIDEO_EXTENSION, link, target)
        | any_match(VIDEO_DOMAIN, link, target, host)
    )
    image = (
        (hint == "image")
        | any_match(IMAGE_EXTENSION, link, target)
        | any_match(IMAGE_DOMAIN, host)
    )
    return (
        F.when(F.coalesce(as_col(is_gallery), F.lit(False)), "gallery")
        .when(video, "video")
        .when(image, "image")
        .when(has_poll | (hint == "poll"), "poll")
        .when(text_or_empty(crosspost_parent) != "", "crosspost")
        .when((hint == "link") | ((link != "") & (body == "")), "link")
        .when(body != "", "text")
        .otherwise("other")
    )


def feed_media_type(
    text: Column | str,
    has_embed: Column,
    embed_type: Column | str,
    link: Column | str,
    thumb_mime: Column | str,
) -> Column:
    """video, photo, text or other, from what a feed post embeds."""
    kind = F.lower(text_or_empty(embed_type))
    uri = F.lower(text_or_empty(link))
    mime = F.lower(text_or_empty(thumb_mime))
    plain = F.when(strip(text_or_empty(text)) != "", "text").otherwise("other")
    return (
        F.when(~has_embed, plain)
        .when(kind.contains("video"), "video")
        .when(kind.contains("image"), "photo")
        .when(uri.rlike(VIDEO_MARKS), "video")
        .when(uri.rlike(IMAGE_MARKS), "photo")
        .when(mime.startswith("video/"), "video")
        .when(mime.startswith("image/"), "photo")
        .otherwise("other")
    )
