"""Language identification in two steps: first the family, then the language within it.

A multinomial logistic regression predicts the language family. Within a family, linear
support vector machines tell each two of its languages apart, and the language that wins
most of its duels is predicted. All see the same features: counts of one to three letters in a row,
hashed into a vector of fixed size, square-rooted and brought to length 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.llm.frames import mixed, slices, worker_cache, written

#: Size of the feature vector, rows of a language that a model is fitted on at most, iterations.
FEATURES = 2048
TRAIN_ROWS = 1500
ITERATIONS = 30
SEED = 5
#: How many times the wanted rows of a language are drawn, so that enough are among them.
SPARE = 2.0
#: Code points of a text that are held as numbers at once.
PIECE = 1 << 20
UNKNOWN = "und"
#: Families of some languages. Any other language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "fy", "lb", "af", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "ast", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "baltic": ("lt", "lv"),
    "celtic": ("ga", "gd", "cy", "br"),
    "indic": ("hi", "ur", "bn", "mr", "ne", "pa", "gu", "si"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "turkic": ("tr", "az", "kk", "ky", "uz", "tk", "tt"),
    "semitic": ("ar", "he", "mt", "am"),
    "dravidian": ("ta", "te", "kn", "ml"),
    "malayic": ("id", "ms", "jv", "su", "tl"),
}


def family_of(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang in langs), f"only {lang}")


def _letters() -> np.ndarray:
    """For every code point, whether it is a letter; made once per worker."""
    cache = worker_cache("langid")
    if "letters" not in cache:
        cache["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return cache["letters"]


def features(text: str | None) -> np.ndarray | None:
    """The feature vector of a whole text; None where it holds no letter."""
    counts = np.zeros(FEATURES)
    letters = _letters()
    found = False
    text = text or ""
    for start in range(0, len(text), PIECE):
        codes = np.frombuffer(
            text[start:start + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32
        )
        letter = letters[codes]
        found = found or bool(letter.any())
        # one space for whatever stands between words
        codes = np.where(letter, codes, np.uint32(32))
        codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]]).astype(np.uint64)
        space = codes == 32
        codes = codes[~(space & np.concatenate([[False], space[:-1]]))]
        one = codes + np.uint64(1)
        two = one[:-1] * np.uint64(0x200000) + one[1:]
        three = two[:-1] * np.uint64(0x200000) + one[2:]
        for grams in (one, two, three):
            at = mixed(grams) & np.uint64(FEATURES - 1)
            counts += np.bincount(at.astype(np.int64), minlength=FEATURES)
    if not found:
        return None
    values = np.sqrt(counts)
    return values / np.linalg.norm(values)


@dataclass
class Model:
    """Weights of the family model (one row per family) and of each duel."""

    families: list[str] = field(default_factory=list)
    languages: dict[str, list[str]] = field(default_factory=dict)
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    duels: dict[tuple[str, str], tuple[np.ndarray, float]] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """Language and score: the family's probability times the mean probability of winning the
        language's duels, where a margin counts by the logistic function."""
        if not self.families:
            return UNKNOWN, 0.0
        logits = self.weights @ x + self.bias
        odds = np.exp(logits - logits.max())
        odds /= odds.sum()
        at = int(odds.argmax())
        langs = self.languages[self.families[at]]
        if len(langs) == 1:
            return langs[0], float(odds[at])
        chances = {lang: [] for lang in langs}
        for a, b in combinations(langs, 2):
            weights, bias = self.duels[a, b]
            chance = 1 / (1 + np.exp(-2 * float(np.clip(weights @ x + bias, -20, 20))))
            chances[a].append(chance)
            chances[b].append(1 - chance)
        # most duels won, then the highest chances, then the first name
        best = max(sorted(langs), key=lambda k: (sum(c > 0.5 for c in chances[k]), sum(chances[k])))
        return best, float(odds[at]) * float(np.mean(chances[best]))


def _draw() -> Column:
    """The hash of a row as a number from 0 to 1."""
    return F.pmod(F.col("at"), F.lit(1 << 32)) / (1 << 32)


def drawn_rows(usable: DataFrame, rows: int) -> DataFrame:
    """lang and at of about SPARE times ``rows`` rows of each language, however many it has: those
    whose hash is below a bound that follows from its count."""
    # One row for each language goes to all tasks, so that rows are cut before anything is dealt.
    counts = F.broadcast(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))
    return usable.select("lang", "at").join(counts, "lang").where(
        _draw() < SPARE * rows / F.col("n")).select("lang", "at")


def first_of_each(drawn: DataFrame, rows: int) -> DataFrame:
    """lang and at of the first ``rows`` distinct rows of each language."""
    place = F.dense_rank().over(Window.partitionBy("lang").orderBy(_draw(), "at"))
    return drawn.distinct().withColumn("place", place).where(F.col("place") <= rows).select("lang", "at")


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from text and lang of ``rows`` rows of each language at the most, chosen by a
    seeded hash of doc_id and text, so that no language of a labelled row is left out. Rows
    without text, letters or lang do not count. Without any, the model knows no language."""
    # Cn: a letter of a newer Unicode version than Java's counts too
    usable = labelled.where("lang is not null").where(F.col("text").rlike(r"[\p{L}\p{Cn}]")).select(
        F.col("lang").cast("string").alias("lang"), "text",
        F.xxhash64(F.lit(SEED), "doc_id", "text").alias("at"),
    )
    sample = first_of_each(drawn_rows(usable, rows), rows)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for part in slices(batch):
                langs, vectors = [], []
                for lang, text in zip(part.column("lang").to_pylist(),
                                      part.column("text").to_pylist()):
                    x = features(text)
                    if x is not None:
                        langs.append(lang)
                        vectors.append(x.tolist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs, pa.string()), pa.array(vectors, pa.list_(pa.float64()))],
                    ["lang", "x"],
                )

    # The sample's hashes are a table bounded by the number of languages.
    vectors = written(
        usable.join(F.broadcast(sample), ["lang", "at"]).dropDuplicates(["lang", "at"])
        .select("lang", "text").mapInArrow(batches, "lang string, x array<double>"),
        "language-samples",
    )
    langs = sorted(r.lang for r in vectors.select("lang").distinct().collect())
    model = Model()
    for lang in langs:
        model.languages.setdefault(family_of(lang), []).append(lang)
    model.families = sorted(model.languages)
    data = vectors.select("lang", array_to_vector("x").alias("features"))
    _fit_families(model, data)
    for members in model.languages.values():
        for a, b in combinations(members, 2):
            duel = data.where(F.col("lang").isin(a, b)).select(
                "features", (F.col("lang") == a).cast("double").alias("label")
            )
            svm = LinearSVC(maxIter=ITERATIONS, regParam=1e-4, standardization=False).fit(duel)
            model.duels[a, b] = svm.coefficients.toArray(), float(svm.intercept)
    return model


def _fit_families(model: Model, data: DataFrame) -> None:
    if len(model.families) < 2:
        model.weights, model.bias = np.zeros((1, FEATURES)), np.zeros(1)
        return
    label = F.lit(0.0)
    for i, name in enumerate(model.families):
        label = F.when(F.col("lang").isin(model.languages[name]), float(i)).otherwise(label)
    fitted = LogisticRegression(
        maxIter=ITERATIONS, regParam=1e-4, standardization=False, family="multinomial"
    ).fit(data.select("features", label.alias("label")))
    model.weights = fitted.coefficientMatrix.toArray()
    model.bias = fitted.interceptVector.toArray()


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All rows with lang_pred and score (0 to 1), which replace columns of those names.

    Only the text is looked at, whole. Null texts and texts without a letter are ``und`` with
    score 0. Repeated rows get the same answer.
    """
    kept = docs.drop("lang_pred", "score")
    schema = kept.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    carried = docs.sparkSession.sparkContext.broadcast(model)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for part in slices(batch):
                vectors = map(features, part.column("text").to_pylist())
                found = [(UNKNOWN, 0.0) if x is None else carried.value.predict(x) for x in vectors]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([f[0] for f in found], pa.string()),
                     pa.array([f[1] for f in found], pa.float64())],
                    schema.names,
                )

    return kept.mapInArrow(batches, schema)


def bucket(mod: int) -> Column:
    """The remainder that splits rows into seen and held out; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % mod


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that are not held out."""
    model = fit(docs.where(bucket(4) != 2))
    return predict(
        docs.select("doc_id", (bucket(4) == 2).alias("held_out"), "text"), model
    ).select("doc_id", "held_out", "lang_pred", "score")
