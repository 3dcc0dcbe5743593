"""Vector search and model hooks."""

import random

import numpy
import pytest
from pyspark.sql import functions as F

from hearsay.operators import models, vectors


def brute(vecs, queries, k):
    out = []
    unit = lambda v: v / (numpy.linalg.norm(v) or 1.0)
    for q, query in queries:
        scored = sorted((-round(float(unit(query) @ unit(v)), 12), i) for i, v in vecs)
        out += [(q, i, place, -s) for place, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def data():
    """A third of the vectors are copies of one."""
    rng = numpy.random.default_rng(5)
    copy = rng.normal(size=8)
    vecs = [(i, copy if i % 3 == 0 else rng.normal(size=8)) for i in range(300)] + [(999, numpy.zeros(8))]
    queries = [(q, rng.normal(size=8)) for q in range(7)] + [(50, copy)]
    return vecs, queries


@pytest.mark.parametrize("options", [
    {}, {"block_rows": 7}, {"block_rows": 3, "most_balls": 5}, {"block_bytes": 8 * 8 * 20},
])
def test_nearest_equals_brute_force(spark, data, options):
    vecs, queries = data
    base = spark.createDataFrame([(i, v.tolist()) for i, v in vecs], "vec_id INT, embedding ARRAY<DOUBLE>").repartition(5)
    asked = spark.createDataFrame([(q, v.tolist()) for q, v in queries], "query_id INT, embedding ARRAY<DOUBLE>")
    got = vectors.nearest(base, asked, 4, **options).collect()
    want = brute(vecs, queries, 4)
    assert sorted((r["query_id"], r["vec_id"], r["rn"]) for r in got) == [w[:3] for w in want]
    scores = {(r["query_id"], r["vec_id"]): r["score"] for r in got}
    assert all(scores[w[0], w[1]] == pytest.approx(w[3]) for w in want)


def test_copies_do_not_swell_the_partial_result(data):
    import pandas

    vecs, queries = data
    best = vectors._block_best(4, "vec_id", "query_id")
    unit = lambda v: v / (numpy.linalg.norm(v) or 1.0)
    block = pandas.DataFrame({"vec_id": [i for i, _ in vecs], "v": [unit(v) for _, v in vecs]})
    asked = pandas.DataFrame({"query_id": [q for q, _ in queries], "q": [unit(v) for _, v in queries]})
    assert len(best(block, asked)) == 4 * len(queries)


def test_far_balls_are_skipped_and_blocks_are_bounded(spark):
    """Clusters: a query visits few balls; no meeting holds more rows than a block has."""
    rng = numpy.random.default_rng(8)
    centres = rng.normal(size=(20, 16))
    vecs = [(i, centres[i % 20] + rng.normal(size=16) / 30) for i in range(2000)]
    queries = [(q, centres[q] + rng.normal(size=16) / 30) for q in range(20)]
    base = spark.createDataFrame([(i, v.tolist()) for i, v in vecs], "vec_id INT, embedding ARRAY<DOUBLE>")
    asked = spark.createDataFrame([(q, v.tolist()) for q, v in queries], "query_id INT, embedding ARRAY<DOUBLE>")
    balls = vectors.balls_of(base, "vec_id", "embedding", block_rows=25)
    assert sum(balls.sizes) == 2000 and 40 <= len(balls.sizes) <= 80
    plain = asked.toDF("qid", "q")
    first = vectors.visits(plain, balls, 5)
    assert first.count() < 3 * 20
    best = vectors.nearest(base, asked, 5, block_rows=25)
    floors = best.where("rn = 5").select(F.col("query_id").alias("qid"), F.col("score").alias("floor"))
    again = vectors.visits(plain.join(floors, "qid"), balls, 5, second=True)
    assert first.count() + again.count() < 0.35 * 20 * len(balls.sizes)
    assert not again.join(first, ["qid", "ball"]).count()
    sizes = balls.rows.groupBy("ball", F.expr("pmod(xxhash64(id), 1)")).count()
    blocks = balls.blocks()
    assert all(r["count"] <= 25 * blocks[r["ball"]] for r in sizes.collect())
    want = brute(vecs, queries, 5)
    assert sorted((r["query_id"], r["vec_id"], r["rn"]) for r in best.collect()) == [w[:3] for w in want]


def test_vectors_that_do_not_count(spark):
    """Null, holed and short vectors are left out, on both sides; no vectors give no rows."""
    shape = "vec_id INT, embedding ARRAY<DOUBLE>"
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [1.0]), (5, [0.0, 0.0])], shape)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0])], "query_id INT, embedding ARRAY<DOUBLE>")
    got = vectors.nearest(base, asked, 4)
    assert sorted((r["query_id"], r["vec_id"], r["score"], r["rn"]) for r in got.collect()) == [(1, 1, 1.0, 1), (1, 5, 0.0, 2)]
    empty = vectors.nearest(base.limit(0), asked, 4)
    assert empty.columns == got.columns and empty.collect() == []


def test_long_texts_only(spark):
    found = spark.createDataFrame([(1, i, 1.0 - i / 10, i + 1) for i in range(4)], "query_id INT, vec_id INT, score DOUBLE, rn INT")
    texts = spark.createDataFrame([(0, "  short "), (1, " " * 80 + "x"), (2, "y" * 60), (3, "z" * 70)], "vec_id INT, text STRING")
    got = vectors.retrieve_texts(found, texts, "vec_id", "text", limit=1).collect()
    assert [(r["vec_id"], r["place"]) for r in got] == [(2, 1)]
    assert vectors.retrieve_texts(found, texts, "vec_id", "text").count() == 2


def test_points_need_text_and_id(spark):
    frame = spark.createDataFrame([("t", "c", [1.0]), ("", "c", [1.0]), ("t", None, [1.0])], "text STRING, cid STRING, v ARRAY<FLOAT>")
    got = vectors.points(frame, "6ba7b811-9dad-11d1-80b4-00c04fd430c8", "text", "cid", "v", ["text", "cid"]).collect()
    assert len(got) == 1 and got[0]["payload"]["cid"] == "c" and got[0]["id"][14] == "5"


def test_hooks_build_the_model_once_per_partition(spark, tmp_path):
    folder = str(tmp_path)

    def factory():
        import os
        import uuid

        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        return lambda texts: [float(len(text)) for text in texts]

    frame = spark.range(0, 1000, 1, 2).select(F.when(F.col("id") > 0, F.col("id").cast("string")).alias("text"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = models.score_with(frame, "text", factory).agg(F.sum("score"), F.min("score")).first()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert got[0] == sum(len(str(i)) for i in range(1, 1000)) and got[1] == 0.0
    assert len(list(tmp_path.iterdir())) == 2


def test_labels_and_unit_vectors(spark):
    frame = spark.createDataFrame([("up",), ("down",), (None,)], "text STRING")
    answers = {"up": ("POSITIVE", 0.75), "down": ("negative", 0.5), "": ("neutral", 1.0)}
    got = models.classify_with(frame, "text", lambda: lambda texts: [answers[t] for t in texts])
    assert [r["sentiment_score"] for r in got.collect()] == [0.75, -0.5, 0.0]
    encoded = models.embed(frame, "text", lambda: lambda texts: [[3.0 * len(t), 4.0 * len(t)] for t in texts])
    assert [tuple(round(x, 6) for x in r["vector"]) for r in encoded.collect()] == [(0.6, 0.8), (0.6, 0.8), (0.0, 0.0)]
