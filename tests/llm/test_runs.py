import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from hearsay.llm import runs
from hearsay.llm.queries import QUERIES


def brute(words):
    """All runs by the definition: every period, every maximal stretch, smallest periods only."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                smaller = any(all(words[x] == words[x + p] for x in range(i, j + q - p))
                              for p in range(1, q))
                if not smaller:
                    found[(i, q)] = j + q - i
            i = j
    return sorted((s, n, q) for (s, q), n in found.items())


def dropped(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_words(draw):
    """Random words from alphabets of all sizes, with planted repeats and changes in them."""
    letters = draw.choice([1, 2, 3, 10, 1000])
    words = [str(draw.randrange(letters)) for _ in range(draw.randrange(0, 90))]
    for _ in range(draw.randrange(0, 4)):
        q = draw.randrange(1, 40)
        piece = [str(draw.randrange(letters)) for _ in range(q)]
        planted = (piece * 9)[: draw.randrange(q, 6 * q + 1)]
        at = draw.randrange(len(words) + 1)
        words[at:at] = planted
    if words and draw.random() < 0.5:
        words[draw.randrange(len(words))] = "x"
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_documents_searched_together(seed):
    draw = random.Random(seed)
    texts = [[w.encode() for w in some_words(draw)] for _ in range(250)]
    found = runs.runs_of(texts)
    assert found == [brute(words) for words in texts]
    assert sum(map(len, found)) > 250
    for words, own in zip(texts, found):
        text = [w.decode() for w in words]
        assert runs.collapse(words, own).decode() == dropped(text, own)


@pytest.mark.parametrize("q", range(1, 70))
def test_every_period_at_every_place(q):
    """The shortest runs of a period, at all places against the dyadic blocks."""
    piece = [f"p{i}".encode() for i in range(q)]
    length = max(6, 4 * q)
    texts, expected = [], []
    for shift in range(0, 2 * q + 3, max(1, q // 8)):
        for n in (length - 1, length, length + 1):
            stretch = [piece[i % q] for i in range(n)]
            texts.append([b"a%d" % i for i in range(shift)] + stretch + [b"z", b"y"])
            expected.append([(shift, n, q)] if n >= length else [])
    assert runs.runs_of(texts) == expected


def test_long_documents():
    """A long run, a Fibonacci word and a document of one word against the definition."""
    assert runs.runs_of([[b"a"] * 200_000]) == [[(0, 200_000, 1)]]
    piece = [b"%d" % i for i in range(5_000)]
    assert runs.runs_of([[b"x"] + piece * 6 + piece[:17]]) == [[(1, 30_017, 5_000)]]
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 900:
        a, b = b, b + a
    assert runs.runs_of([b, b * 2]) == [brute(b), brute(b * 2)]


def test_wavelet_tree():
    import numpy as np

    draw = np.random.default_rng(3)
    for n in (1, 2, 3, 64, 100):
        values = draw.permutation(n)
        tree = runs.WaveletTree(values)
        left = draw.integers(0, n, 50)
        right = np.minimum(n, left + 1 + draw.integers(0, n, 50))
        after = np.array([draw.choice(values[a:b]) for a, b in zip(left, right)])
        expected = [min((v for v in values[a:b] if v > x), default=-1)
                    for a, b, x in zip(left, right, after)]
        assert tree.successor(left, right, after).tolist() == expected


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected_row(doc, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n = len(words)
    g, rest = divmod(zlib.crc32(str(doc).encode()), 10)
    if doc is not None and not rest and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return doc, len(found), *top, digest(lines), digest(dropped(words, found))


def test_query_against_brute_force(spark, tmp_path):
    """Odd rows and documents of all kinds through the registered query."""
    draw = random.Random(11)
    rows = [(i, draw.choice([" ", "\n", "\t\x0b "]).join(some_words(draw))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "one"), (204, "           "),
             (205, "Ab ab Ab ab Ab ab Ab ab"), (205, "Ab ab Ab ab Ab ab Ab ab"), (205, "other"),
             (None, "a a a a a a a"), (-7, "a b " * 40), (206, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").withColumns(
        {"runs": F.lit(1), "start": F.lit("x"), "lang": F.lit(None).cast("string")}
    ).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op13_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                           "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted((expected_row(*r) for r in rows), key=key)


def test_columns_and_odd_rows(odd_docs, odd_rows, no_docs, monkeypatch):
    """Other columns stay, clashing ones are replaced, and the batches do not matter."""
    monkeypatch.setattr(runs, "BATCH_WORDS", 50)
    got = runs.periodic_runs(odd_docs.withColumn("runs", F.lit(0)))
    assert got.columns == [*odd_docs.columns, "runs", "collapsed"]
    rows = got.select("doc_id", "text", "key", "runs", "collapsed").collect()
    assert len(rows) == len(odd_rows)
    for row in rows:
        words = [w.decode() for w in (row.text or "").encode().split()]
        if len(words) < 1000:
            assert [tuple(r) for r in row.runs] == brute(words)
        assert row.collapsed == dropped(words, [tuple(r) for r in row.runs])
    assert runs.periodic_runs(no_docs).collect() == []
