"""Hooks for Python models. The model is built once per Python worker and partition; texts
travel in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.functions.scores import signed_score


def score_with(
    df: DataFrame, text: str, factory: Callable[[], Callable], out: str = "score"
) -> DataFrame:
    """Add a score column. ``factory()`` returns a function from a list of texts to a list
    of numbers; missing texts are passed as ""."""

    @F.pandas_udf("double")
    def scorer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            yield pd.Series(model(texts.fillna("").tolist()), dtype="float64")

    return df.withColumn(out, scorer(F.col(text)))


def classify_with(
    df: DataFrame, text: str, factory: Callable[[], Callable], out: str = "sentiment_score"
) -> DataFrame:
    """Add a signed score. ``factory()`` returns a function from texts to (label, confidence)
    pairs; positive labels count up, negative ones down, others 0."""

    @F.pandas_udf("label string, confidence double")
    def classifier(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory()
        for texts in batches:
            answers = model(texts.fillna("").tolist())
            yield pd.DataFrame(answers, columns=["label", "confidence"])

    answer = F.col("__answer")
    return (
        df.withColumn("__answer", classifier(F.col(text)))
        .withColumn(out, signed_score(answer["label"], answer["confidence"]))
        .drop("__answer")
    )


def embed(
    df: DataFrame, text: str, factory: Callable[[], Callable], out: str = "vector"
) -> DataFrame:
    """Add a unit-length vector. ``factory()`` returns a function from texts to vectors."""

    @F.pandas_udf("array<float>")
    def encoder(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            yield pd.Series([list(vector) for vector in model(texts.fillna("").tolist())])

    raw = df.withColumn("__raw", encoder(F.col(text)))
    return raw.withColumn(out, unit("__raw")).drop("__raw")


def unit(vector: str) -> Column:
    """A vector scaled to length 1; a zero vector stays."""
    square = F.aggregate(
        F.col(vector),
        F.lit(0.0),
        lambda total, x: total + x.cast("double") * x.cast("double"),
        lambda total: F.sqrt(total),
    )
    return F.when(square == 0, F.col(vector)).otherwise(
        F.transform(F.col(vector), lambda x: (x / square).cast("float"))
    )
