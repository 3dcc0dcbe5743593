import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, key int"

#: Nulls in every column, empty and long texts, ties, repeated rows.
LONG = "".join(f"Line number {i} of a very long text with words.\n" for i in range(4000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 1, "x", 0),
    (2, "the quick brown fox jumps over the lazy dog near the river bank today. ", "en", "a", 1, "x", 0),
    (2, "the quick brown fox jumps over the lazy dog near the river bank today. ", "en", "a", 1, "x", 0),
    (3, None, "en", "a", 1, None, None),
    (4, "", None, None, None, "x", 0),
    (5, "\n\n \t\n", "de", "b", 1, "x", 0),
    (6, "12345 !!! 678", "de", "b", 1, "x", 0),
    (None, "Eine Zeile ohne Nummer, aber mit Text.", "de", "b", 1, "x", 0),
    (7, "a" * 30_000, "en", "c", 1, "x", 0),
    (8, LONG, "en", "c", 1, "x", 0),
    (9, LONG + "and one more", "en", "c", 1, "x", 0),
    (10, "Zwei Zeilen.\nThe quick brown fox jumps over the lazy dog near the river bank today.",
     "de", None, 1, "x", 0),
    (11, "日本語のテキスト 🙂 naïve café", None, "ä", 1, "x", 0),
]


@pytest.fixture(scope="session")
def odd_rows():
    return ROWS


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf_documents(spark, tmp_path_factory):
    """A folder with a documents table of the odd rows, near and exact copies, and its rows."""
    from test_ngrams import noisy_copies

    rows = [(i, text) for i, (_, text) in enumerate(noisy_copies(77) + noisy_copies(78))]
    rows += [(1000 + r[0], r[1]) for r in ROWS if r[0] is not None]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).write.parquet(
        f"{folder}/documents.parquet"
    )
    return folder, rows
