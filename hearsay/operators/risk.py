"""Should a sentence be posted? Word scores, their summary and the decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.functions.scores import post_decision, risk_gauge
from hearsay.functions.text import sentence_words, strip
from hearsay.functions.vocab import EDGE_PUNCTUATION, NEGATIVE_WORDS, POSITIVE_WORDS


def latest_word_scores(series: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """The latest score of each word, any case; spellings of the same window are averaged.

    With ``words`` (a frame with a column ``word``) only those are looked up. The semi join
    comes before the aggregates, so a large series is cut down first.
    """
    rows = series.select(
        F.lower("word").alias("word"), "time_range", F.col("avg_vader_sentiment_score")
    )
    if words is not None:
        rows = rows.join(words.select("word").distinct(), "word", "left_semi")
    per_window = rows.groupBy("word", "time_range").agg(
        F.avg("avg_vader_sentiment_score").alias("__score")
    )
    # Fixed-width values and keys keep max_by in a hash aggregate.
    return per_window.groupBy("word").agg(F.max_by("__score", "time_range").alias("score"))


def sentence_word_counts(
    sentences: DataFrame, key: str, text: str, edge: str = EDGE_PUNCTUATION
) -> DataFrame:
    """Uses of each word per sentence."""
    words = sentences.select(key, F.explode(sentence_words(text, edge)).alias("word"))
    return words.groupBy(key, "word").agg(F.count(F.lit(1)).alias("uses"))


def score_sentences(sentences: DataFrame, series: DataFrame, key: str, text: str) -> DataFrame:
    """Words of each sentence with their latest score, 0 for unknown words.

    Repeats are folded into ``uses`` before the join. How the scores are joined is left to
    the planner, which knows their size; adaptive execution splits a hot word.
    """
    counts = sentence_word_counts(sentences, key, text)
    joined = counts.join(latest_word_scores(series, counts), "word", "left")
    return joined.select(key, "word", "uses", F.coalesce("score", F.lit(0.0)).alias("score"))


def wordlist_risk(
    sentences: DataFrame,
    text: str,
    positive: list[str] = POSITIVE_WORDS,
    negative: list[str] = NEGATIVE_WORDS,
) -> DataFrame:
    """The columns of ``sentence_risk`` with +1 and -1 for the words of two lists.

    All of it is counted within the row: nothing is exploded, joined or shuffled.
    Sentences without a word are left out, as they have no average.
    """
    # A text has a word if it is not all blanks; a test of the word list itself would be
    # pushed below the projection and split every text once more.
    spoken = sentences.filter(F.length(strip(text)) > 0)
    words = spoken.withColumn("__words", sentence_words(text, EDGE_PUNCTUATION + "_"))

    def uses(listed: list[str]) -> Column:
        return F.size(F.filter("__words", lambda word: word.isin(list(listed))))

    counted = words.withColumns(
        {"__all": F.size("__words"), "__good": uses(positive), "__poor": uses(negative)}
    )
    good, poor, every = F.col("__good"), F.col("__poor"), F.col("__all")
    lowest = F.when(poor > 0, -1.0).when(good < every, 0.0).otherwise(1.0)
    return counted.withColumns(
        {"avg_score": (good - poor) / every, "neg_frac": poor / every, "min_score": lowest}
    ).drop("__words", "__all", "__good", "__poor")


def sentence_risk(scored: DataFrame, key: str) -> DataFrame:
    """Average score, share of negative words and lowest score per sentence, words counted
    as often as they stand in it."""
    uses, score = F.col("uses"), F.col("score")
    return scored.groupBy(key).agg(
        (F.sum(score * uses) / F.sum(uses)).alias("avg_score"),
        (F.sum(F.when(score < 0, uses).otherwise(0)) / F.sum(uses)).alias("neg_frac"),
        F.min("score").alias("min_score"),
    )


def decide(risk: DataFrame) -> DataFrame:
    """Adds the recommendation text and the gauge class."""
    columns = ("avg_score", "neg_frac", "min_score")
    return risk.withColumn("recommendation", post_decision(*columns)).withColumn(
        "gauge", risk_gauge(*columns)
    )
