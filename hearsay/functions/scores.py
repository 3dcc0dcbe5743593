"""Scores and labels computed within one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearsay.functions.text import as_col
from hearsay.functions.values import num_or_zero
from hearsay.functions.vocab import NEGATIVE_WORDS, POSITIVE_WORDS


def like_reply_ratio(likes: Column | str, replies: Column | str) -> Column:
    """Likes per reply, 0 where there are no replies."""
    likes, replies = as_col(likes), as_col(replies)
    return F.when(replies == 0, F.lit(0.0)).otherwise(
        likes.cast("double") / replies.cast("double")
    )


def wordlist_sentiment(
    tokens: Column | str,
    positive: list[str] = POSITIVE_WORDS,
    negative: list[str] = NEGATIVE_WORDS,
) -> Column:
    """(positive - negative hits) / tokens with repeats counted, 0 without tokens."""
    tokens = as_col(tokens)

    def hits(words: list[str]) -> Column:
        return F.size(F.filter(tokens, lambda token: token.isin(list(words))))

    count = F.size(tokens)
    return F.when(
        count > 0, (hits(positive) - hits(negative)).cast("double") / count
    ).otherwise(F.lit(0.0))


def sign_label(score: Column | str) -> Column:
    score = as_col(score)
    return F.when(score > 0, "positive").when(score < 0, "negative").otherwise("neutral")


def controversy_score(comments: Column | str, score: Column | str) -> Column:
    """Comments per point of (absolute) score."""
    return num_or_zero(comments) / (F.abs(num_or_zero(score)) + 1.0)


def interest_value(ups: Column | str, comments: Column | str, score: Column | str) -> Column:
    """Up votes and comments plus the score where it is positive."""
    return num_or_zero(ups) + num_or_zero(comments) + F.greatest(num_or_zero(score), F.lit(0.0))


def engagement(ups: Column | str, downs: Column | str, comments: Column | str) -> Column:
    return num_or_zero(ups) + num_or_zero(downs) + num_or_zero(comments) + 1.0


def normalise_valence(total: Column | str, alpha: float = 15.0) -> Column:
    """A sum of valences squeezed into [-1, 1]."""
    total = as_col(total)
    squeezed = total / F.sqrt(total * total + alpha)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), squeezed))


def signed_score(label: Column | str, score: Column | str) -> Column:
    """Classifier label and confidence as one signed number."""
    label, score = F.lower(as_col(label)), as_col(score)
    return F.when(label == "positive", score).when(label == "negative", -score).otherwise(0.0)


def should_avoid(avg: Column | str, neg_frac: Column | str, low: Column | str) -> Column:
    """Is a sentence too negative to post?"""
    return (as_col(avg) <= -0.05) | (as_col(neg_frac) >= 0.40) | (as_col(low) <= -0.25)


def post_decision(avg: Column | str, neg_frac: Column | str, low: Column | str) -> Column:
    """The recommendation as text."""
    avg, neg_frac, low = as_col(avg), as_col(neg_frac), as_col(low)
    # format_number rounds the exact binary value, halves to even; %.2f does not on the JVM.
    shown = [
        F.replace(F.format_number(number, digits), F.lit(","), F.lit(""))
        for number, digits in ((avg, 4), (neg_frac, 2), (low, 4))
    ]
    numbers = F.format_string("(avg_score=%s, neg_frac=%s, min_score=%s).", *shown)
    verdict = F.when(
        should_avoid(avg, neg_frac, low), "Recommendation: Do not post - rule 1 triggered "
    ).otherwise("Recommendation: Post - rule 2 triggered ")
    return F.concat(verdict, numbers)


def risk_gauge(avg: Column | str, neg_frac: Column | str, low: Column | str) -> Column:
    """Avoid, Safe or Risky."""
    calm = (as_col(avg) >= 0.05) & (as_col(neg_frac) < 0.25) & (as_col(low) >= 0)
    return (
        F.when(should_avoid(avg, neg_frac, low), "Avoid").when(calm, "Safe").otherwise("Risky")
    )
