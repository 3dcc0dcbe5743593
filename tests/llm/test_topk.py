import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from check_queries import canonical, connect
from hearsay.llm import topk
from hearsay.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def packed(v):
    return struct.pack(f"<{len(v)}q", *v)


def brute(rows, every, k):
    vectors = {}
    for i, x in rows:
        if i is None or not x or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = [max(-2 ** 56, min(2 ** 56, math.floor(256 * c))) for c in x]
        vectors[i] = min(vectors.get(i, v), v, key=packed)
    out = []
    for q, a in vectors.items():
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors.items()
                            if i != q and len(b) == len(a))
            out += [(q, rank, i, max(-2 ** 63, min(2 ** 63 - 1, -s)))
                    for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("slices", [1, 2, 5])
def test_against_brute_force(spark, slices, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 23)
    draw = random.Random(slices)
    rows = [(i, [draw.choice([-0.5, 0.0, 0.25, 0.7]) for _ in range(5)]) for i in range(150)]
    rows += [(i, [0.5] * 5) for i in range(200, 260)]  # one hot vector
    rows += [(300, None), (301, []), (302, [0.1, None, 0.2, 0.3, 0.4]), (303, [float("nan")] * 5),
             (304, [float("inf")] * 5), (None, [0.1] * 5), (310, [0.5, 0.5]), (320, [0.1, 0.2]),
             (330, [9.0, 9.0, 9.0]), (0, rows[0][1]), (40, [1e9] * 5)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn(
        "score", F.lit("clash")
    )
    found = topk.nearest(frame, every=10, k=5, slices=slices)
    assert sorted(map(tuple, found.collect())) == brute(rows, 10, 5)


@pytest.mark.parametrize("slices", [1, 2, 3])
def test_large_components(spark, slices, monkeypatch):
    """Parts and scores beyond 2**61, 2**63 and 2**100 are exact, rank exactly, and one that is no
    long is given as the nearest long."""
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 9)
    draw = random.Random(slices)
    rows = [(0, [2e9 / 256, 2e9 / 256]), (1, [1.25e9 / 256, 0.25e9 / 256])]
    rows += [(10 + i, [draw.choice([-1, 1]) * 10 ** draw.uniform(3, 8) for _ in range(2)]) for i in range(40)]
    rows += [(100 + i, [draw.choice([-1, 1]) * 10 ** draw.uniform(6, 19) for _ in range(4)]) for i in range(40)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = sorted(map(tuple, topk.nearest(frame, every=5, k=60, slices=slices).collect()))
    assert found == brute(rows, 5, 60)
    scores = {(q, v): s for q, _, v, s in found}
    assert scores[0, 1] == 3_000_000_000_000_000_000
    assert sum(abs(s) >= 2 ** 63 - 1 for s in scores.values()) > 20


def test_nothing(spark):
    frame = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.nearest(frame, every=10, k=5).count() == 0


def test_query_matches_sql(spark):
    found = canonical(QUERIES["op4_topk"](spark, FOLDER).toPandas())
    assert found == canonical(connect(FOLDER).sql(SQL["op4_topk"]).df())


def test_resolved_sends_no_vector_with_a_pair(spark):
    """Every pair's exact score, of two dimensions and beyond 64 bits; a bin gets a vector once and a
    query's vector once, whatever number of pairs meet there."""
    draw = np.random.default_rng(5)
    rows = [(i, draw.integers(-2**40, 2**40, 8 if i % 3 else 5)) for i in range(60)]
    frame = spark.createDataFrame(
        [(i, len(v), bytearray(v.astype("<i8").tobytes())) for i, v in rows],
        "id bigint, dim int, v binary")
    wanted = [(q, i) for q, a in rows[::4] for i, b in rows if len(a) == len(b)]
    pairs = spark.createDataFrame(wanted, "query bigint, id bigint").repartition(4)
    found = topk.resolved(pairs, frame, 3, topk.WIDE)
    vectors = dict(rows)
    expected = {(q, i): sum(int(x) * int(y) for x, y in zip(vectors[q], vectors[i])) for q, i in wanted}
    assert {(r.query, r.id): int(r.score) for r in found.collect()} == expected
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan.split("MapInArrow")[1].split("Join")[0]


def test_no_row_holds_a_pair_of_nodes(spark, monkeypatch):
    """A vector node comes once, ahead of the query nodes that meet it."""
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 20)
    frame = spark.createDataFrame(
        [(i, 4, bytearray(np.arange(4, dtype="<i8") + i)) for i in range(70)],
        "id bigint, dim int, v binary").withColumn("cutoff", F.lit(None).cast("bigint"))
    queries = topk.nodes(topk.blocked(frame.where("id % 2 = 0"), {4: 35}, 5, F.col("cutoff")), 2)
    vectors = topk.nodes(topk.blocked(frame, {4: 70}, 20, F.col("cutoff")), 2)
    rows = [r for part in topk.met(queries, vectors, {4: 70}).rdd.glom().collect() for r in part]
    of_vectors = [r for r in rows if r.asking is None]
    assert len(of_vectors) == vectors.count()
    assert len(rows) - len(of_vectors) == queries.count() * len({r.block for r in of_vectors})
    at = None
    for r in rows:
        at = (r.slice, r.block) if r.asking is None else at
        assert at == (r.slice, r.block)
