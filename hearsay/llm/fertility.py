"""Quality rules with tokeniser fertility.

A public vocabulary measures how well a text's words fit: characters per token, tokens per word
(fertility), share of tokens that are single bytes because the vocabulary has no better, and the
entropy of the token distribution. The middle half of all documents of a language, leaning on its
script and on all documents by their numbers, sets a band for each measure, and what is outside a
band is rejected. Bands come from exact percentiles over all documents that pass the base rules.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.llm.frames import slices, worker_cache, written

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
WINDOW = 3
#: Words that a worker keeps with their tokens.
MEMO_WORDS = 400_000
#: Documents that a wider group counts for in the bands of a narrower one.
PRIOR_DOCS = 100
#: Per measure: how many times the middle half's width the band reaches below and above the
#: median, and the least width, as a share of the median and as such. Four widths are 5.4
#: standard deviations of a normal distribution; the measures' main modes end there. Entropy has no
#: second mode, but its lower tail is long.
BANDS = {
    "chars_per_token": (4.0, 4.0, 0.02, 0.0),
    "fertility": (4.0, 4.0, 0.04, 0.0),
    "byte_share": (4.0, 4.0, 0.0, 0.05),
    "entropy": (3.5, 3.5, 0.05, 0.0),
}
#: Decimals on which measures are ranked for the percentiles, which are exact and so the same in any run.
DIGITS = 3


def repeated_words(hashes: np.ndarray) -> int:
    """Words in windows of WINDOW words that are found twice or more, the first included."""
    if len(hashes) <= WINDOW:
        return 0
    n = len(hashes) - WINDOW + 1
    _, words = np.unique(hashes, return_inverse=True)
    codes = words[:n].astype(np.uint64)
    for i in range(1, WINDOW):
        # renumbered at each step, so that codes stay exact
        codes = codes * np.uint64(len(hashes)) + words[i:n + i].astype(np.uint64)
        _, codes = np.unique(codes, return_inverse=True)
        codes = codes.astype(np.uint64)
    held = np.bincount(codes.astype(np.int64))[codes.astype(np.int64)] > 1
    covered = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(held)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + WINDOW, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def script_of(text: str) -> str:
    """The script that most letters of the whole text are of, as Unicode names it; the first by name of
    several."""
    names = worker_cache("fertility").setdefault("scripts", {})
    counts: Counter[str] = Counter()
    for letter, n in Counter(text).items():
        if letter not in names:
            names[letter] = (
                unicodedata.name(letter, "UNKNOWN").split()[0].lower() if letter.isalpha() else "")
        counts[names[letter]] += n
    counts.pop("", None)
    return min(counts, key=lambda name: (-counts[name], name)) if counts else "none"


class Tokens:
    """Token ids of words by a sentencepiece model; one per worker."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        size = self.model.vocab_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(size)])
        self.memo: dict[bytes, bytes] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        fresh = [w for w in dict.fromkeys(words) if w not in memo]
        if fresh:
            if len(memo) + len(fresh) > MEMO_WORDS:
                memo.clear()
                fresh = list(dict.fromkeys(words))
            found = self.model.encode([w.decode() for w in fresh], num_threads=1)
            memo.update(zip(fresh, (np.array(ids, np.int32).tobytes() for ids in found)))
        return np.frombuffer(b"".join([memo[w] for w in words]), np.int32)


def tokens_of(content: bytes) -> Tokens:
    cache = worker_cache("fertility")
    if cache.get("content") != content:
        cache["content"], cache["tokens"] = content, Tokens(content)
    return cache["tokens"]


MEASURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, chars_per_token double, fertility double, byte_share double, "
    "entropy double, script string"
)


def measure(text: str | None, tokens: Tokens) -> tuple:
    text = text or ""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, SPACES))
    base = (len(words), chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text),
            repeated_words(np.array(list(map(hash, words)), np.int64)))
    if not words:
        return (*base, None, None, None, None, "none")
    ids = tokens.of(words)
    if not len(ids):
        return (*base, None, None, None, None, script_of(text))
    shares = np.bincount(ids)
    shares = shares[shares > 0] / len(ids)
    return (*base, chars / len(ids), len(ids) / len(words), float(tokens.is_byte[ids].mean()),
            float(-(shares * np.log2(shares)).sum()), script_of(text))


def measured(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, lang and the measures of each row's whole text. Null and empty texts have no words
    and null token measures. The model file (of fixed size) is read by the driver and broadcast."""
    with open(model_file, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = f"doc_id bigint, lang string, {MEASURES}"
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    fields = [x.split() for x in MEASURES.split(", ")]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(content.value)
        for batch in rows:
            for part in slices(batch):
                found = [measure(text, tokens) for text in part.column("text").to_pylist()]
                columns = [pa.array([f[i] for f in found], kinds[kind])
                           for i, (_, kind) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("lang"), *columns],
                    ["doc_id", "lang", *[name for name, _ in fields]],
                )

    return docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").mapInArrow(
        batches, schema
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )


def quartiles(rows: DataFrame, group: str) -> DataFrame:
    """The group, its docs, and the quartiles of each measure of the documents that pass the base
    rules."""
    return rows.where(~F.col("base_failed")).groupBy(group).agg(
        F.count("*").alias("docs"),
        *[F.percentile(F.round(m, DIGITS), F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(m)
          for m in BANDS],
    )


def _leaning(own: str, docs: str, wider: Column) -> Column:
    """Quartiles of a group that lean on those of the wider one by PRIOR_DOCS documents."""
    n = F.coalesce(F.col(docs), F.lit(0))
    mixed = F.zip_with(own, wider, lambda x, y: (n * x + PRIOR_DOCS * y) / (n + PRIOR_DOCS))
    return F.coalesce(mixed, wider)


def inside_bands() -> Column:
    """Whether all measures are within the bands of the row: from the quartiles of its language,
    which lean on those of the language's script, which lean on those of all documents."""
    inside = F.lit(True)
    for m, (below, above, share, least) in BANDS.items():
        wider = _leaning(f"script_{m}", "script_docs", F.col(f"all_{m}"))
        found = _leaning(f"lang_{m}", "lang_docs", wider)
        low, mid, high = (F.get(found, i) for i in range(3))
        width = F.greatest(high - low, share * F.abs(mid), F.lit(least))
        inside &= (F.col(m) >= mid - below * width) & (F.col(m) <= mid + above * width)
    return inside


def judged(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, the base measures, the token measures, base_failed and kept of every row.

    Kept is a document that passes the base rules and whose measures are inside the bands of its
    language. Bands follow from the quartiles of the documents that pass the base rules; those of
    a language lean on its script's (the script of most of its documents, which is that of most
    letters of a text) as if PRIOR_DOCS more documents had these, and those of a script on all
    documents'. So a small language is judged mostly by its script, a null lang by the text's own
    script, and no group changes its bands at a certain size. Repeated rows count as often as they
    occur. An empty table gives no rows.
    """
    rows = written(
        measured(docs, model_file).withColumn("base_failed", base_failed()), "measures"
    )

    def named(found: DataFrame, of: str) -> DataFrame:
        return found.withColumnsRenamed({name: f"{of}_{name}" for name in ("docs", *BANDS)})

    whole = named(quartiles(rows.withColumn("one", F.lit(1)), "one"), "all").first()  # one row
    scripts = (
        rows.where("lang is not null and not base_failed")
        .groupBy("lang", "script").agg(F.count("*").alias("n"))
        .groupBy("lang").agg(F.max_by("script", F.struct("n", "script")).alias("usual"))
    )
    langs = named(quartiles(rows.where("lang is not null"), "lang"), "lang").join(scripts, "lang")
    both = (
        rows.join(langs, "lang", "left")
        .withColumn("script", F.coalesce("usual", "script"))
        .join(named(quartiles(rows, "script"), "script"), "script", "left")
        .withColumns({
            f"all_{m}": F.lit(list(whole[f"all_{m}"]) if whole else None).cast("array<double>")
            for m in BANDS
        })
    )
    inside = inside_bands()
    return both.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"),
        "chars_per_token", "fertility", "byte_share", "entropy",
    )
