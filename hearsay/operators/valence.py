"""Valence-lexicon sentiment: word valences summed per text and squeezed into [-1, 1].

A valence is turned and damped when one of the three words before it negates it. The
lexicon is a table ``word, valence``.

``valence_score`` has that rule alone; ``valence_in_context`` has the published ones: capitals, words
of degree, negation, "least", contrast, exclamation and question marks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearsay.functions.scores import normalise_valence
from hearsay.functions.vocab import (
    CAPITALS_WEIGHT, CONTRAST_FACTORS, DAMPENERS, DEGREE_DECAY, DEGREE_WEIGHT, EXCLAMATION_WEIGHT,
    INTENSIFIERS, MANY_QUESTIONS_WEIGHT, MOST_EXCLAMATIONS, NEGATION_FACTOR, NEGATION_SPAN,
    NEGATIONS, NEVER_SO_FACTORS, QUESTION_WEIGHT, VALENCE_ALPHA,
)

#: Places before a word that are looked at.
BACK = range(1, NEGATION_SPAN + 1)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def valence_words(text: str) -> Column:
    """Lower-case letter runs in order; apostrophes are dropped, so don't reads dont."""
    bare = F.translate(F.lower(F.coalesce(F.col(text), F.lit(""))), "'’", "")
    return F.regexp_extract_all(bare, F.lit(r"\p{L}+"), 0)


def valence_score(
    df: DataFrame, text: str, lexicon: DataFrame, key: str, out: str = "score"
) -> DataFrame:
    """Add the compound score; texts that are missing or empty score 0.

    ``key`` names one row each. The lexicon may have any size and the planner chooses the join; of
    a word listed more than once the mean valence counts, and words without a valence do not.
    """
    negations = F.array(*[F.lit(word) for word in NEGATIONS])

    def marked(words: Column) -> Column:
        def mark(word, at):
            before = F.slice(
                words, F.greatest(F.lit(1), at + 1 - NEGATION_SPAN), F.least(at, F.lit(NEGATION_SPAN))
            )
            return F.struct(word.alias("word"), F.arrays_overlap(before, negations).alias("negated"))

        return F.transform(words, mark)

    # The words are bound once, as a lambda's variable, so that texts are tokenized once.
    uses = df.select(
        key, F.inline(F.flatten(F.transform(F.array(valence_words(text)), marked)))
    )
    valences = (
        lexicon.where("word IS NOT NULL AND valence IS NOT NULL")
        .groupBy("word").agg(F.avg(F.col("valence").cast("double")).alias("__valence"))
    )
    factor = F.when(F.col("negated"), F.lit(NEGATION_FACTOR)).otherwise(F.lit(1.0))
    totals = (
        uses.join(valences, "word")
        .groupBy(key)
        .agg(F.sum(F.col("__valence") * factor).alias("__total"))
    )
    total = F.coalesce("__total", F.lit(0.0))
    return (
        df.join(totals, key, "left")
        .withColumn(out, normalise_valence(total, VALENCE_ALPHA))
        .drop("__total")
    )


@dataclass(frozen=True)
class ContextWords:
    """The words that the rules of context look for, all in lower case and without apostrophes."""

    up: list[str] = field(default_factory=lambda: list(INTENSIFIERS))
    down: list[str] = field(default_factory=lambda: list(DAMPENERS))
    negations: list[str] = field(default_factory=lambda: list(NEGATIONS))
    contrast: str = "but"


def context_tokens(text: str) -> Column:
    """Words between white space, without punctuation at their ends; one that would keep two letters
    or fewer stays as it is, so that emoticons do."""
    words = F.split(F.coalesce(F.col(text), F.lit("")), "[ \\t\\n\\x0B\\f\\r]+")
    # The bare words are an array of their own: in one lambda each would be cut twice.
    bare = F.transform(words, lambda w: F.btrim(w, F.lit(PUNCTUATION)))
    stripped = F.zip_with(words, bare, lambda w, b: F.when(F.length(b) <= 2, w).otherwise(b))
    return F.filter(stripped, lambda w: w != "")


def _plain(word: Column) -> Column:
    return F.translate(F.lower(word), "'’", "")


def _shouted(word: Column) -> Column:
    return (F.upper(word) == word) & (F.lower(word) != word)


def _with_effects(hits: DataFrame, key: str, words: ContextWords) -> DataFrame:
    """Words of the lexicon with their valence as if nothing stood before them (``alone``), and what
    the three words before them would do to it (``effects``: numbers and flags, null where they
    would do nothing).

    Rows have place (from 1), word, valence, ``before1`` to ``before3`` (the nearest first; null
    without one), shouted (some words of the text are in capitals, but not all) and contrast (the
    place of the first word of contrast, 0 without one).
    """
    at = {k: F.col(f"before{k}") for k in BACK}
    plain = {k: F.col(f"plain{k}") for k in BACK}
    so = {k: F.coalesce(plain[k].isin("so", "this"), F.lit(False)) for k in BACK}
    never_so = {1: F.lit(False), 2: so[1], 3: so[2] | so[1]}
    sign = F.when(F.col("valence") > 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    shouted = F.col("shouted") & _shouted(F.col("word"))
    effects = {
        "first": F.col("valence") + F.when(shouted, sign * CAPITALS_WEIGHT).otherwise(F.lit(0.0)),
        "side": F.when(F.col("contrast") == 0, F.lit(1.0))
        .when(F.col("place") < F.col("contrast"), F.lit(CONTRAST_FACTORS[0]))
        .when(F.col("place") > F.col("contrast"), F.lit(CONTRAST_FACTORS[1])).otherwise(F.lit(1.0)),
        "least": F.coalesce(
            (plain[1] == "least") & ~F.coalesce(plain[2], F.lit("")).isin("at", "very"), F.lit(False)),
    }
    for k in BACK:
        effects[f"weight{k}"] = (
            F.when(plain[k].isin(list(words.up)), F.lit(DEGREE_WEIGHT))
            .when(plain[k].isin(list(words.down)), F.lit(-DEGREE_WEIGHT)).otherwise(F.lit(0.0)))
        effects[f"loud{k}"] = F.coalesce(
            plain[k].isin([*words.up, *words.down]) & F.col("shouted") & _shouted(at[k]), F.lit(False))
        effects[f"factor{k}"] = (
            F.when((plain[k] == "never") & never_so[k], F.lit(NEVER_SO_FACTORS[k - 1]))
            .when(plain[k].isin(list(words.negations)) | at[k].contains("n't"), F.lit(NEGATION_FACTOR))
            .otherwise(F.lit(1.0)))
    some = F.col("least")
    for k in BACK:
        some = some | (F.col(f"weight{k}") != 0) | (F.col(f"factor{k}") != 1)
    # Steps of their own, since nested expressions would be worked out wherever they are mentioned.
    return (
        hits.withColumns({"known": _plain(F.col("word")).isin([*words.up, *words.down]),
                          **{f"plain{k}": _plain(at[k]) for k in BACK}})
        .select(key, "place", "known", *[column.alias(name) for name, column in effects.items()])
        .select(
            key, "place",
            F.when(F.col("known"), F.lit(0.0)).otherwise(F.col("first") * F.col("side")).alias("alone"),
            F.when(some & ~F.col("known"), F.struct(*effects)).alias("effects"),
        )
    )


def _in_context(hits: DataFrame, key: str) -> DataFrame:
    """The valence of each word of the lexicon where it stands, as ``told``.

    ``hits`` has place, alone and effects. Words of the lexicon change nothing after them, which is
    counted by place; rows that share a key and a place stand there together.
    """
    near = Window.partitionBy(key).orderBy("place")
    told = hits.select(
        key, "alone", "effects", F.col("effects.first").alias("told"),
        *[(F.count(F.lit(1)).over(near.rangeBetween(-k, -k)) == 0).alias(f"free{k}") for k in BACK])
    for k in BACK:  # a column for each step: a nested one would mention the one before many times
        now = F.col("told")
        sign = F.when(now < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
        louder = F.when(
            F.col(f"effects.loud{k}"),
            F.when(now > 0, F.lit(CAPITALS_WEIGHT)).otherwise(F.lit(-CAPITALS_WEIGHT)),
        ).otherwise(F.lit(0.0))
        raised = now + (F.col(f"effects.weight{k}") * sign + louder) * DEGREE_DECAY[k - 1]
        told = told.withColumn(
            "told", F.when(F.col(f"free{k}"), raised * F.col(f"effects.factor{k}")).otherwise(now))
    turned = F.col("told") * F.when(
        F.col("effects.least") & F.col("free1"), F.lit(NEGATION_FACTOR)).otherwise(F.lit(1.0))
    return told.select(
        key, F.when(F.col("effects").isNull(), F.col("alone"))
        .otherwise(turned * F.col("effects.side")).alias("told"))


def emphasis(text: str) -> Column:
    """What exclamation and question marks add to the size of a text's sum."""
    marks = lambda sign: F.length(F.col(text)) - F.length(F.replace(F.col(text), F.lit(sign), F.lit("")))
    asked = marks("?")
    return F.least(marks("!"), F.lit(MOST_EXCLAMATIONS)) * EXCLAMATION_WEIGHT + (
        F.when(asked <= 1, F.lit(0.0)).when(asked <= 3, asked * QUESTION_WEIGHT)
        .otherwise(F.lit(MANY_QUESTIONS_WEIGHT))
    )


def valence_in_context(
    df: DataFrame, text: str, lexicon: DataFrame, key: str, out: str = "score",
    words: ContextWords | None = None,
) -> DataFrame:
    """Add the compound score by the published rules of context; missing texts score 0.

    ``key`` names one row each. Idioms of several words are not known. Words are looked up before
    anything is shuffled, if the lexicon is small enough for the planner to send it along; what
    meets per text are then its words of the lexicon, each with the effects of the three words
    before it as numbers.
    """
    words = words or ContextWords()
    tokens = F.col("tokens")
    uses = (
        df.select(key, context_tokens(text).alias("tokens"))
        .withColumn("shouted", F.exists(tokens, _shouted) & F.exists(tokens, lambda w: ~_shouted(w)))
        .withColumn("contrast", F.array_position(F.transform(tokens, F.lower), words.contrast))
        .select(key, "shouted", "contrast", "tokens", F.posexplode("tokens").alias("at", "word"))
        .select(key, "shouted", "contrast", "word", (F.col("at") + 1).alias("place"),
                F.lower("word").alias("of"),
                *[F.get(tokens, F.col("at") - k).alias(f"before{k}") for k in BACK])
    )
    valences = (
        lexicon.where("word IS NOT NULL AND valence IS NOT NULL")
        .groupBy(F.lower("word").alias("of"))
        .agg(F.avg(F.col("valence").cast("double")).alias("valence"))
    )
    hits = _with_effects(uses.join(valences, "of"), key, words)
    sums = _in_context(hits, key).groupBy(key).agg(F.sum("told").alias("__total"))
    total = F.coalesce("__total", F.lit(0.0))
    louder = F.coalesce(emphasis(text), F.lit(0.0)) * F.signum(total)
    return (
        df.join(sums, key, "left")
        .withColumn(out, normalise_valence(total + louder, VALENCE_ALPHA))
        .drop("__total")
    )
