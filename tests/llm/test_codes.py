import hashlib
import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hearsay.llm import codes
from hearsay.llm.queries import QUERIES, SQL



def brute(rows, entries=256, rounds=4):
    """rows: (vec_id, vector, label). The codes by the definition, in Python's integers."""
    kept = [(i, v, label) for i, v, label in rows if v is not None
            and all(x is not None and math.isfinite(x) and abs(x) < 2 ** 52 for x in v)]
    if not kept:
        return []
    width = 4 * max(1, -(-max(len(v) for _, v, _ in kept) // 4))
    kept = [(i, [math.floor(1024 * x) for x in v] + [0] * (width - len(v)), label, v)
            for i, v, label in kept]
    part = width // 4
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:entries]
    cut = lambda v: [v[i * part:(i + 1) * part] for i in range(4)]
    books = [list(b) for b in zip(*(cut(r[1]) for r in first))]
    away = lambda p, e: sum((a - b) ** 2 for a, b in zip(p, e))
    nearest = lambda p, book: min(range(len(book)), key=lambda e: (away(p, book[e]), e))
    for _ in range(rounds):
        for i in range(4):
            got = defaultdict(list)
            for r in kept:
                p = cut(r[1])[i]
                got[nearest(p, books[i])].append(p)
            for e, own in got.items():
                books[i][e] = [sum(x) // len(own) for x in zip(*own)]
    flat = ",".join(str(x) for book in books for e in book for x in e)
    digest = hashlib.sha256(flat.encode()).hexdigest()
    out, of_label = [], defaultdict(int)
    for i, v, label, _ in kept:
        own = [nearest(p, books[k]) for k, p in enumerate(cut(v))]
        error = sum(away(p, books[k][own[k]]) for k, p in enumerate(cut(v)))
        out.append((i, bytes(own).hex(), min(error, codes.MOST), label))
        of_label[label] += min(error, codes.MOST)
    return sorted(((i, c, e, min(of_label[label], codes.MOST), digest) for i, c, e, label in out),
                  key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)


def found(df):
    return sorted(map(tuple, codes.digests(df).collect()), key=str)


def clustered(seed, n, dim, spread=0.05):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 0.4, (12, dim))
    vectors = centres[draw.integers(0, 12, n)] + draw.normal(0, spread, (n, dim))
    vectors[draw.integers(0, n, n // 5)] = vectors[0]  # copies of one
    return [(int(i), [float(np.float32(x)) for x in v], int(i) % 5 or None)
            for i, v in zip(draw.permutation(n) * 3, vectors)]


@pytest.mark.parametrize("seed, n, dim, limits", [
    (1, 700, 8, {"LEAF": 5, "BLOCK_ROWS": 90}), (2, 300, 16, {}), (3, 900, 4, {"LEAF": 16}),
])
def test_against_brute_force(spark, monkeypatch, seed, n, dim, limits):
    for name, value in limits.items():
        monkeypatch.setattr(codes, name, value)
    rows = clustered(seed, n, dim)
    assert found(frame(spark, rows)) == brute(rows)


def test_odd_rows(spark):
    """Nulls everywhere, vectors that do not count, ragged and empty ones, copies, ties, clashing
    columns, huge components."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.25, 1.0, -1.0], 1), (2, None, 1), (3, [0.5, None, 1.0, 1.0], 1),
            (4, [0.5, nan, 1.0, 1.0], None), (5, [0.5, inf, 1.0, 1.0], None), (6, [], None),
            (7, [0.5, 0.25, 1.0], None), (1, [0.5, 0.25, 1.0, -1.0], 1), (1, [0.0, 0.0, 0.0, 0.0], 2),
            (None, [9.0, 9.0, 9.0, 9.0], 2), (8, [-0.0001, 0.0, 0.0, 0.0, 7.0], 3),
            (9, [1e30, 0.0, 0.0, 0.0], 3)]
    assert found(frame(spark, rows)) == brute(rows)
    assert found(frame(spark, rows).withColumn("code", F.lit(1)).withColumn("error", F.lit("x"))) == (
        brute(rows))
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(1, None, 1), (2, [None], 1)])) == []


def test_huge_components(spark, monkeypatch):
    """Squares beyond 64 bits are compared exactly; an error beyond a long is the largest long."""
    draw = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(0, 10 ** draw.integers(3, 15), 4)], 1)
            for i in range(300)]
    rows += [(1000 + i, rows[i][1], 1) for i in range(0, 300, 2)]
    monkeypatch.setattr(codes, "LEAF", 4)
    assert found(frame(spark, rows)) == brute(rows)


def test_balls_are_owned():
    """Far clusters: balls go to entries whole, and only few points are compared."""
    draw = np.random.default_rng(6)
    points = (np.repeat(np.arange(16)[:, None] * 10_000, 250, axis=0)
              + draw.integers(-400, 400, (4000, 6))).astype(np.int64)
    tree = codes.grown(points)
    assert sorted(tree["order"].tolist()) == list(range(4000))
    for at in range(len(tree["start"])):
        own = tree["points"][tree["start"][at]:tree["stop"][at]]
        assert (own.sum(axis=0) == tree["sums"][at]).all()
        away = np.sqrt(((own - tree["centre"][at]) ** 2).sum(axis=1))
        assert away.max() <= tree["radius"][at] * (1 + 1e-9) + 1e-6
    entries = points[::250]
    balls, owners, leaves = codes.owned(tree, entries)
    assert sum(len(entry) for _, entry in leaves) < 400 < len(points)
    assert len(balls) < 200
    got, errors = codes.tree_codes(tree, entries)
    away = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (got == away.argmin(axis=1)).all() and (errors == away.min(axis=1)).all()


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    relation = connection.sql(SQL["op12_codes"])
    got = QUERIES["op12_codes"](spark, folder)
    assert sorted(got.columns) == sorted(relation.columns)
    names = sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(
        tuple(map(lambda x: x, r)) for r in relation.select(", ".join(names)).fetchall())
    assert got.count() == 500
