import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ngrams import brute, noisy_copies

from hearsay.llm import minhash
from hearsay.llm.queries import QUERIES


def found(df, **options):
    rows = minhash.near_duplicates(df, **options).collect()
    for r in rows:
        assert r.kept == (r.component_id is None or r.doc_id == r.component_id)
    return sorted((tuple(r)[:3] for r in rows), key=str)


@pytest.mark.parametrize("distance", [0, 5, 13, 14, 20, 27, 28, 35])
def test_signatures_within_the_distance_share_a_key(distance):
    draw = np.random.default_rng(distance)
    signs = draw.integers(0, 1 << minhash.BITS, (300, minhash.SYMBOLS)).astype(np.uint16)
    changed = signs.copy()
    for row in changed:
        at = draw.choice(minhash.SYMBOLS, distance, replace=False)
        row[at] += draw.integers(1, 1 << minhash.BITS, distance).astype(np.uint16)
    ours, theirs = (minhash.chunk_keys(x, distance) for x in (signs, changed))
    assert all(set(a) & set(b) for a, b in zip(ours.tolist(), theirs.tolist()))
    # Others have none in common.
    assert not set(ours[0].tolist()) & set(ours[1].tolist())


def test_errors_of_the_chunks():
    """Any way to spread the errors over the chunks leaves one with as few as are allowed."""
    for chunks in (1, 2, 3, 4):
        for distance in range(9):
            allowed = minhash.chunk_errors(distance, chunks)
            draw = random.Random(distance)
            for _ in range(300):
                errors = [0] * chunks
                for _ in range(distance):
                    errors[draw.randrange(chunks)] += 1
                assert any(e <= a for e, a in zip(errors, allowed))


def test_signatures_estimate_the_similarity():
    """Symbols agree as often as the sets are similar, and close sets are hardly ever missed."""
    draw = np.random.default_rng(5)
    for n, other in ((200, 17), (40, 3), (3000, 243)):
        agree = []
        for _ in range(60):
            values = draw.integers(0, 1 << 62, n + other).astype(np.uint64)
            a, b = values[:n], values[other:]
            agree.append((minhash.signature(a) == minhash.signature(b)).mean())
        assert abs(np.mean(agree) - (n - other) / (n + other)) < 0.02
    assert minhash.missed(0.85) < 1 / 45_000
    assert minhash.missed(0.9) < 1 / 100_000_000


def test_odd_rows(odd_docs, odd_rows, no_docs):
    got = found(odd_docs.withColumn("node", F.lit(1)).withColumn("n", F.lit("x")))
    expected = brute([(r[0], r[1]) for r in odd_rows], 3, 85)
    assert [g for g in got if g[0] is not None] == [e for e in expected if e[0] is not None]
    assert [g[2] for g in got if g[0] is None] == [None]
    assert found(no_docs) == []


@pytest.mark.parametrize("seed, limits", [
    (1, {}), (2, {"CELL_NODES": 3}), (3, {"CELL_SHINGLES": 150, "CELL_NODES": 7, "HASHED": 10}),
])
def test_against_brute_force(spark, monkeypatch, seed, limits):
    """The same groups, whole or cell by cell."""
    for name, value in limits.items():
        monkeypatch.setattr(minhash, name, value)
    rows = noisy_copies(seed) + noisy_copies(seed + 50)
    rows = [(i, text) for i, (_, text) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    expected = brute(rows, 3, 85)
    assert found(df) == expected
    assert len({e[2] for e in expected}) < len(rows) - 40


def test_ids_that_repeat(spark):
    """Rows that share an id but not the text are in the groups of their texts."""
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (5, " ".join(words) + " end"), (5, "quite another text here"),
            (5, "quite another text here"), (3, "quite another text here"), (None, " ".join(words))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = found(df)
    assert got == sorted([(1, 58, 1), (5, 59, 1), (5, 2, 3), (5, 2, 3), (3, 2, 3), (None, 58, None)],
                         key=str)


def test_query_against_brute_force(spark, sf_documents):
    folder, rows = sf_documents
    got = QUERIES["op11_minhash"](spark, folder)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r)[:3] for r in got.collect()), key=str) == brute(rows, 3, 85)
