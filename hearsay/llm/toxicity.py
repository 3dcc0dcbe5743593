"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Words that toxic documents hold far more often than others form a weighted lexicon, next to a short
fixed list. A text is described by densities of both, by how close they stand to second-person
words, and by its capitals, punctuation and obfuscation. Boosted trees score the description and
isotonic regression turns scores into shares of toxic documents.

Labelled rows are dealt into folds by a hash. The rows of a fold are described with the lexicon
of the others, so that the trees never see a word's weight that the row itself has raised.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.frames import seeded, slices, written
from hearsay.llm.langid import bucket

#: Labelled rows that are learned from at most, words of a lexicon at most.
TRAIN_ROWS = 20_000
LEXICON = 3_000
#: A lexicon word is in so many toxic documents of the sample at least, and so many times as often
#: as in others.
LEAST_DOCS = 3
LEAST_RATIO = 4.0
FOLDS = 3
SEED = 8
NEAR = 5
SPAN = 50
#: Common insults, second-person words, and look-alikes of letters.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb imbecile loser losers scum trash garbage pathetic "
    "worthless disgusting clown filthy scumbag jerk vermin retard bastard bitch asshole "
    "dumbass crap ugly freak degenerate hate kill".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dein deine dich dir ihr euch euer tu te toi ton ta tes vous "
    "votre vos ti tus usted ustedes vosotros".split()
)
LOOK_ALIKE = str.maketrans("013457@$!", "oieastasi")
_TOKEN = re.compile(r"[^\W_][\w@$!*]*[^\W_]|[^\W_]")

FEATURES = (
    "hits", "weight", "distinct", "hit_count", "densest", "insults", "near", "second_person",
    "capitals", "exclamations", "questions", "symbols", "obfuscated", "size", "word_length",
)


def described(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """The features of a whole text. Empty texts have none of anything."""
    raw = _TOKEN.findall(text or "")
    if not raw:
        return [0.0] * len(FEATURES)
    n = len(raw)
    words = "\n".join(raw).lower().split("\n")
    found = [i for i, w in enumerate(words) if w in lexicon]
    insults = [i for i, w in enumerate(words) if w in INSULTS]
    odd = 0
    for w in {w for w in words if not w.isalpha()}:
        plain = w.translate(LOOK_ALIKE).replace("*", "")
        if plain != w and (plain in lexicon or plain in INSULTS):
            odd += 1
    people = {i for i, w in enumerate(words) if w in SECOND_PERSON}
    hits = sorted({*found, *insults})
    near = sum(any(j in people for j in range(i - NEAR, i + NEAR + 1)) for i in hits) if people else 0
    densest = start = 0
    for end, i in enumerate(hits):
        while i - hits[start] >= SPAN:
            start += 1
        densest = max(densest, end - start + 1)
    chars = len(text)
    return [
        len(found) / n,
        sum(lexicon[words[i]] for i in found) / n,
        float(len({words[i] for i in hits})),
        float(len(hits)),
        float(densest),
        len(insults) / n,
        near / n,
        len(people) / n,
        sum(len(w) > 1 and w.isupper() for w in raw) / n,
        text.count("!") / chars,
        text.count("?") / chars,
        sum(map(text.count, "#*$%&|<>@")) / chars,
        odd / n,
        float(np.log1p(n)),
        sum(map(len, raw)) / n,
    ]


@dataclass
class Model:
    """A lexicon, the trees and the calibration; or, without both kinds of labels, a share."""

    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    share: float


def labelled_rows(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """text, toxic (0.0 or 1.0), fold and weight of ``rows`` labelled rows at the most.

    Labels meet the documents' ids before they are chosen, so those without a document take no
    place. Of each label half the rows are chosen by a seeded hash; ``weight`` is how many
    labelled rows one of them stands for. Null labels do not count; of several labels of a document
    the highest does.
    """
    known = written(
        labels.where("toxic is not null and doc_id is not null")
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("double")).alias("toxic"))
        .join(docs.select("doc_id"), "doc_id", "left_semi"),
        "known-labels",
    )
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = known.limit(0).withColumn("weight", F.lit(1.0))
    for label in (0.0, 1.0):
        first = known.where(F.col("toxic") == label).orderBy(seeded("doc_id", SEED), "doc_id")
        weight = max(1.0, counts.get(label, 0) / (rows // 2))
        chosen = chosen.unionByName(first.limit(rows // 2).withColumn("weight", F.lit(weight)))
    chosen = chosen.withColumn(
        "fold", F.pmod(seeded("doc_id", SEED + 1), F.lit(FOLDS + 1)).cast("int"))
    # The chosen ids are a bounded table.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "text", "toxic", "fold", "weight"
    )


def word_counts(rows: DataFrame) -> DataFrame:
    """word, fold, docs and toxic docs, over the folds that lexicons are made of."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            every, toxic = Counter(), Counter()
            for part in slices(batch):
                for text, label, fold in zip(*(part.column(i).to_pylist() for i in range(3))):
                    own = {(fold, w) for w in
                           "\n".join(_TOKEN.findall(text or "")).lower().split("\n") if w}
                    every.update(own)
                    if label:
                        toxic.update(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for _, w in every], pa.string()),
                 pa.array([f for f, _ in every], pa.int32()),
                 pa.array(list(every.values()), pa.int64()),
                 pa.array([toxic[k] for k in every], pa.int64())],
                ["word", "fold", "docs", "toxic"],
            )

    return (
        rows.where(F.col("fold") < FOLDS).select("text", "toxic", "fold")
        .mapInArrow(batches, "word string, fold int, docs bigint, toxic bigint")
        .groupBy("word", "fold").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    )


def lexicon(counts: DataFrame, totals: dict[int, tuple[int, int]], without: int | None) -> dict:
    """Words and log ratios from all folds but one; LEXICON words at the most."""
    folds = [f for f in totals if f != without and f < FOLDS]
    toxic = sum(totals[f][1] for f in folds)
    clean = sum(totals[f][0] for f in folds) - toxic
    ratio = ((F.col("toxic") + 0.5) / (toxic + 1)) / (
        (F.col("docs") - F.col("toxic") + 0.5) / (clean + 1)
    )
    rows = (
        counts.where(F.col("fold").isin(folds)).groupBy("word")
        .agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
        .where(F.col("toxic") >= LEAST_DOCS)
        .withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO)
        .orderBy(F.desc(F.col("toxic") * F.log("ratio")), "word").limit(LEXICON)
    )
    return {r.word: float(np.log(r.ratio)) for r in rows.collect()}


def _described_rows(rows: DataFrame, lexicons: dict[int, dict], extra: str) -> DataFrame:
    """The rows' extra columns and x (features), each by its fold's lexicon."""
    carried = rows.sparkSession.sparkContext.broadcast(lexicons)
    names = [c.split()[0] for c in extra.split(", ")] if extra else []
    schema = ", ".join(x for x in (extra, "x array<double>") if x)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for part in slices(batch):
                x = [described(text, carried.value[fold]) for text, fold in
                     zip(part.column("text").to_pylist(), part.column("fold").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(x, pa.list_(pa.float64()))],
                    [*names, "x"],
                )

    wanted = list(dict.fromkeys([*names, "text", "fold"]))
    return rows.select(*wanted).mapInArrow(batches, schema)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from the texts of ``docs`` and the label ``toxic``, nothing else of either."""
    sample = written(labelled_rows(docs, labels, rows), "toxic-samples")
    totals = {r.fold: (r.n, int(r.t)) for r in sample.groupBy("fold").agg(
        F.count("*").alias("n"), F.sum("toxic").alias("t")).collect()}
    share = sample.agg(F.sum(F.col("toxic") * F.col("weight")) / F.sum("weight")).first()[0] or 0.0
    counts = written(word_counts(sample), "word-counts")
    full = lexicon(counts, totals, None)
    lexicons = {f: lexicon(counts, totals, f) for f in range(FOLDS)} | {FOLDS: full}
    data = written(
        _described_rows(sample, lexicons, "toxic double, fold int, weight double"),
        "toxic-features",
    ).select("toxic", "fold", "weight", array_to_vector("x").alias("features"))
    learned = [totals.get(f, (0, 0)) for f in range(FOLDS)]
    if not 0 < sum(t for _, t in learned) < sum(n for n, _ in learned):
        return Model(full, None, None, share)
    trees = GBTClassifier(
        labelCol="toxic", maxIter=25, maxDepth=3, stepSize=0.2, minInstancesPerNode=5, seed=SEED
    ).fit(data.where(F.col("fold") < FOLDS))
    if not totals.get(FOLDS, (0, 0))[0]:
        return Model(full, trees, None, share)
    held = _scored(data.where(F.col("fold") == FOLDS), trees).select("raw", "toxic", "weight")
    # The weights give the calibration the labels' own shares back.
    calibration = IsotonicRegression(
        featuresCol="raw", labelCol="toxic", predictionCol="share", weightCol="weight"
    ).fit(held)
    return Model(full, trees, calibration, share)


def _scored(data: DataFrame, trees: GBTClassificationModel) -> DataFrame:
    return trees.transform(data).withColumn("raw", vector_to_array("probability")[1])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row, from its whole text alone. Null texts score as empty ones.
    The calibrated share counts for 98 hundredths; the trees' own probability, which orders
    rows alike, for the rest, so that rows of one step of the calibration stay in order."""
    rows = _described_rows(
        docs.select("doc_id", "text").withColumn("fold", F.lit(FOLDS)),
        {FOLDS: model.lexicon}, "doc_id bigint",
    )
    if model.trees is None:
        return rows.select("doc_id", F.lit(model.share).alias("score"))
    scored = _scored(rows.withColumn("features", array_to_vector("x")), model.trees)
    if model.calibration is None:
        return scored.select("doc_id", F.col("raw").alias("score"))
    return model.calibration.transform(scored.select("doc_id", "raw")).select(
        "doc_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0),
                          0.98 * F.col("share") + 0.02 * F.col("raw"))).alias("score")
    )


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted, learned from the rows that are not held out."""
    model = fit(docs.where(bucket(5) != 0), labels)
    return predict(docs, model).select(
        "doc_id", (bucket(5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
