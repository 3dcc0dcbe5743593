"""Text columns: tokenizers, stop words, matching and scrubbing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearsay.functions.vocab import EDGE_PUNCTUATION, SHORT_STOPWORDS, default_stopwords

# Java and RE2 disagree on the vertical tab in \s, so white space is spelled out.
BLANKS = r"[ \t\n\x0B\f\r]+"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def without_words(tokens: Column | str, words: list[str]) -> Column:
    """Tokens not in ``words``; repeats stay (``array_except`` would drop them)."""
    if not words:
        return as_col(tokens)
    return F.filter(as_col(tokens), lambda token: ~token.isin(list(words)))


def tokens_ws(text: Column | str, unique: bool = True, lower: bool = True) -> Column:
    """Tokens between white space; the empty edge tokens are dropped."""
    text = as_col(text)
    pieces = F.split(F.lower(text) if lower else text, BLANKS)
    tokens = F.filter(pieces, lambda token: token != "")
    return F.array_distinct(tokens) if unique else tokens


def tokens_clean(
    text: Column | str, stopwords: list[str] | None = None, unique: bool = True
) -> Column:
    """Lower-case ASCII words of two characters or more that start with a letter.

    Everything but ASCII letters and digits separates words. ``stopwords=None`` takes
    the default list; pass ``[]`` to keep all words.
    """
    # One extraction instead of replacing separators first: regexp_replace costs several
    # times as much as the rest. Case is folded last, so that no other letter (the Kelvin
    # sign, say) turns into an ASCII one.
    pattern = F.lit("(?<![a-zA-Z0-9])[a-zA-Z][a-zA-Z0-9]+")
    words = F.transform(F.regexp_extract_all(as_col(text), pattern, 0), F.lower)
    kept = without_words(words, default_stopwords() if stopwords is None else stopwords)
    return F.array_distinct(kept) if unique else kept


def tokens_alpha(
    text: Column | str, stopwords: list[str] | None = None, unique: bool = False
) -> Column:
    """Runs of three or more ASCII letters, lower-cased, without stop words."""
    words = F.regexp_extract_all(F.lower(as_col(text)), F.lit("[a-z]{3,}"), 0)
    kept = without_words(words, SHORT_STOPWORDS if stopwords is None else stopwords)
    return F.array_distinct(kept) if unique else kept


TOKENIZERS = {"clean": tokens_clean, "alpha": tokens_alpha, "ws": tokens_ws}


def tokenize(text: Column | str, tokenizer: str = "clean", **options) -> Column:
    """One of the tokenizers by name, so that batch and stream jobs can share a choice."""
    return TOKENIZERS[tokenizer](text, **options)


def sentence_words(text: Column | str, edge: str = EDGE_PUNCTUATION) -> Column:
    """Words of a sentence, in order and with repeats, cut at the edges and lower-cased."""
    words = F.filter(F.split(as_col(text), BLANKS), lambda word: word != "")
    return F.transform(words, lambda word: F.lower(F.btrim(word, F.lit(edge))))


def word_eq(column: Column | str, word: str) -> Column:
    return F.lower(as_col(column)) == F.lower(F.lit(word))


def mentions(column: Column | str, needle: str, ignore_case: bool = True) -> Column:
    """Does the text hold ``needle``?"""
    if ignore_case:
        return F.lower(as_col(column)).contains(needle.lower())
    return as_col(column).contains(needle)


def lang_any(langs: Column | str, code: str = "en") -> Column:
    return F.array_contains(as_col(langs), code)


def lang_only(langs: Column | str, code: str = "en") -> Column:
    return as_col(langs) == F.array(F.lit(code))


def lang_raw(raw: Column | str, code: str = "en") -> Column:
    """Language test on the JSON text of the list; the quotes keep ``en`` from matching
    longer codes."""
    return as_col(raw).contains(f'"{code}"')


def strip(column: Column | str) -> Column:
    """White space cut at both ends (``trim`` alone cuts blanks only)."""
    return F.btrim(as_col(column), F.lit(" \t\n\x0b\f\r"))


def long_enough(column: Column | str, n: int) -> Column:
    return F.length(strip(column)) >= n


def scrub_nul(column: Column | str) -> Column:
    """Drop NUL characters, which SQL stores reject."""
    return F.translate(as_col(column), "\u0000", "")


def first_text(*columns: Column | str) -> Column:
    """The first of several text columns that is there."""
    return F.coalesce(*[as_col(column) for column in columns])
