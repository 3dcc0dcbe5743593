"""Nearest texts by cosine similarity, exact.

Vectors are never paired with queries row by row. Unit vectors are dealt to balls around a bounded
number of centres. How near a query can be to anything in a ball follows from its angle to the centre
and from the ball's widest angle, so a query first visits the balls of the highest bounds that hold
k vectors, and then only those whose bound reaches its k-th score; the others are skipped.
A task multiplies a block of a ball's vectors with a block of the queries that visit it and passes on
only the k best per query. Blocks are bounded in rows and in bytes on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.functions.text import long_enough, strip
from hearsay.functions.values import uuid5
from hearsay.operators.filters import embeddable
from hearsay.operators.ranks import top_per_group
from hearsay.session import shared_path

# Vectors and queries of a block, and bytes of their components. A ball is meant to be one block.
BLOCK_ROWS = 16_384
BLOCK_BYTES = 64 << 20
# Balls at most: their centres go to every task (2,048 of 384 doubles take 6 MB).
MOST_BALLS = 2_048
# Scores are compared on twelve decimals; bounds leave more room than that.
SLACK = 1e-9


@dataclass
class Balls:
    """Unit vectors (id, v, ball) with the centre, size and least cosine of each ball."""

    rows: DataFrame
    centres: list
    sizes: list[int]
    least: list[float]
    block_rows: int

    def blocks(self) -> list[int]:
        return [max(1, -(-size // self.block_rows)) for size in self.sizes]


def _whole(column: str, dims: int | None = None) -> Column:
    """Not null, without nulls, and of the given length."""
    whole = F.col(column).isNotNull() & ~F.exists(column, lambda x: x.isNull())
    return whole if dims is None else whole & (F.size(column) == dims)


def _by_ball(values: list, key: str = "ball") -> Column:
    """The value of a row's ball, from a list with one for each ball."""
    return F.element_at(F.array(*[F.lit(value) for value in values]), F.col(key) + 1)


def _unit_rows():
    """A function from an Arrow column of lists to a matrix of unit rows (zeros stay)."""

    def unit_rows(column, dims: int):
        import numpy

        matrix = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
        lengths = numpy.linalg.norm(matrix, axis=1, keepdims=True)
        return matrix / numpy.where(lengths == 0, 1.0, lengths)

    return unit_rows


def _dealt(vectors: DataFrame, centres, dims: int) -> DataFrame:
    """id, v (unit), ball (of the nearest centre) and the cosine to it."""
    import numpy

    carried = vectors.sparkSession.sparkContext.broadcast(numpy.array(centres))
    unit_rows = _unit_rows()
    kind = vectors.schema["id"].dataType.simpleString()

    def deal(batches: Iterator) -> Iterator:
        import numpy
        import pyarrow

        for batch in batches:
            unit = unit_rows(batch.column("v"), dims)
            cosines = unit @ carried.value.T
            ball = cosines.argmax(axis=1)
            lists = pyarrow.FixedSizeListArray.from_arrays(pyarrow.array(unit.ravel()), dims)
            yield pyarrow.RecordBatch.from_arrays(
                [batch.column("id"), lists.cast(pyarrow.list_(pyarrow.float64())),
                 pyarrow.array(ball.astype("int32")),
                 pyarrow.array(cosines[numpy.arange(len(ball)), ball])],
                ["id", "v", "ball", "cosine"],
            )

    return vectors.select("id", "v").mapInArrow(
        deal, f"id {kind}, v array<double>, ball int, cosine double")


def balls_of(
    vectors: DataFrame, vector_id: str, vector: str, block_rows: int = BLOCK_ROWS,
    block_bytes: int = BLOCK_BYTES, most_balls: int = MOST_BALLS,
) -> Balls | None:
    """The vectors dealt to balls; None without any. Centres are the vectors that come first by a
    hash of their ids. The rows are written by ball, so that a scan for some balls skips the
    row groups of others."""
    import numpy

    spark = vectors.sparkSession
    rows = vectors.where(_whole(vector)).select(F.col(vector_id).alias("id"), F.col(vector).alias("v"))
    count, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not count:
        return None
    rows = rows.where(F.size("v") == dims)
    block_rows = max(1, min(block_rows, block_bytes // (8 * max(1, dims))))
    wanted = min(most_balls, -(-count // block_rows))
    first = rows.orderBy(F.xxhash64("id"), "id").limit(wanted).select("v").collect()
    centres = numpy.unique(numpy.array([row.v for row in first], float).reshape(-1, dims), axis=0)
    lengths = numpy.linalg.norm(centres, axis=1, keepdims=True)
    centres = centres / numpy.where(lengths == 0, 1.0, lengths)
    path = shared_path(spark, "balls")
    _dealt(rows, centres, dims).repartitionByRange("ball", F.xxhash64("id")).sortWithinPartitions(
        "ball").write.parquet(path)
    dealt = spark.read.parquet(path)
    sizes, least = [0] * len(centres), [1.0] * len(centres)
    for row in dealt.groupBy("ball").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("c")).collect():
        sizes[row.ball], least[row.ball] = row.n, row.c
    return Balls(dealt, centres.tolist(), sizes, least, block_rows)


def visits(queries: DataFrame, balls: Balls, k: int, second: bool = False) -> DataFrame:
    """qid, q (unit) and the balls that a query visits.

    First those of the highest bounds that hold k vectors. With ``second`` the queries have
    ``floor``, the k-th score so far (null, if there is none), and visit what is left and may reach
    it.
    """
    import numpy

    dims = len(balls.centres[0])
    carried = queries.sparkSession.sparkContext.broadcast(
        tuple(map(numpy.array, (balls.centres, balls.sizes, balls.least))))
    unit_rows = _unit_rows()
    kind = queries.schema["qid"].dataType.simpleString()

    def choose(batches: Iterator) -> Iterator:
        import numpy
        import pyarrow

        centres, sizes, least = carried.value
        widest = numpy.arccos(numpy.clip(least, -1, 1))
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                unit = unit_rows(part.column("q"), dims)
                angles = numpy.arccos(numpy.clip(unit @ centres.T, -1, 1))
                bounds = numpy.cos(numpy.maximum(0, angles - widest)) + SLACK
                bounds[:, sizes == 0] = -numpy.inf
                order = numpy.argsort(-bounds, axis=1, kind="stable")
                before = numpy.cumsum(sizes[order], axis=1) - sizes[order]
                chosen = numpy.zeros(bounds.shape, bool)
                numpy.put_along_axis(chosen, order, before < k, axis=1)
                if second:
                    floors = part.column("floor").to_numpy(zero_copy_only=False).astype(float)
                    floors = numpy.where(numpy.isnan(floors), -numpy.inf, floors)
                    chosen = ~chosen & (bounds >= floors[:, None])
                chosen &= sizes > 0
                at, ball = numpy.nonzero(chosen)
                lists = pyarrow.FixedSizeListArray.from_arrays(pyarrow.array(unit[at].ravel()), dims)
                yield pyarrow.RecordBatch.from_arrays(
                    [part.column("qid").take(pyarrow.array(at)),
                     lists.cast(pyarrow.list_(pyarrow.float64())),
                     pyarrow.array(ball.astype("int32"))],
                    ["qid", "q", "ball"],
                )

    columns = ["qid", "q", *["floor"] * second]
    return queries.select(*columns).mapInArrow(choose, f"qid {kind}, q array<double>, ball int")


def _met(balls: Balls, visiting: DataFrame, k: int, vector_id: str, query_id: str) -> DataFrame:
    """The k best of each meeting of a block of a ball with a block of the queries that visit it."""
    asked = [0] * len(balls.sizes)
    for row in visiting.groupBy("ball").count().collect():  # one row per ball
        asked[row.ball] = row["count"]
    query_blocks = [max(1, -(-n // balls.block_rows)) for n in asked]
    needed = [ball for ball, n in enumerate(asked) if n]

    def dealt(df: DataFrame, key: str, own: str, counts: list, other: str, others: list) -> DataFrame:
        every = F.sequence(F.lit(0), _by_ball(others) - 1)
        return df.withColumn(own, F.pmod(F.xxhash64(key), _by_ball(counts)).cast("int")).withColumn(
            other, F.explode(every))

    left = dealt(balls.rows.where(F.col("ball").isin(needed)).select("id", "v", "ball"), "id",
                 "vb", balls.blocks(), "qb", query_blocks).withColumnRenamed("id", vector_id)
    right = dealt(visiting, "qid", "qb", query_blocks, "vb", balls.blocks()).withColumnRenamed(
        "qid", query_id)
    kinds = {f.name: f.dataType.simpleString() for f in (*left.schema, *right.schema)}
    shape = f"`{query_id}` {kinds[query_id]}, `{vector_id}` {kinds[vector_id]}, score double"
    best = _block_best(k, vector_id, query_id)

    def meet(block, asking):
        return best(block, asking)

    keys = ["ball", "vb", "qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, shape)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    vector_id: str = "vec_id",
    vector: str = "embedding",
    query_id: str = "query_id",
    query: str = "embedding",
    **limits: int,
) -> DataFrame:
    """The k nearest vectors per query: ``query_id, vector_id, score, rn``; ties by id.

    Vectors that are null, hold a null or have another length than most of a kind (the longest) are
    left out, and so are such queries. ``limits`` are those of ``balls_of``; the result is the same
    with any.
    """
    balls = balls_of(vectors, vector_id, vector, **limits)
    if balls is None:
        shape = [vectors.schema[vector_id], queries.schema[query_id]]
        return queries.sparkSession.createDataFrame(
            [], f"`{query_id}` {shape[1].dataType.simpleString()}, "
            f"`{vector_id}` {shape[0].dataType.simpleString()}, score double, rn int")
    spark = queries.sparkSession
    asking = queries.where(_whole(query, len(balls.centres[0]))).select(
        F.col(query_id).alias("qid"), F.col(query).alias("q"))

    def written(df: DataFrame, label: str) -> DataFrame:
        path = shared_path(spark, label)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    asking = written(asking, "queries")
    first = written(visits(asking, balls, k), "visits")
    found = written(_met(balls, first, k, vector_id, query_id), "found")
    best = top_per_group(found, query_id, "score", k, vector_id)
    floors = best.where(F.col("rn") == k).select(F.col(query_id).alias("qid"), F.col("score").alias("floor"))
    more = written(visits(asking.join(floors, "qid", "left"), balls, k, second=True), "visits")
    if not more.isEmpty():
        found = found.unionByName(_met(balls, more, k, vector_id, query_id))
    return top_per_group(found, query_id, "score", k, vector_id)


def _block_best(k: int, vector_id: str, query_id: str):
    """A function from a block of unit vectors and a block of unit queries to the k best per query.

    Scores are cut to twelve decimals, so that copies of a vector tie whatever their place
    in the block; of those level with the k-th score the smallest ids are taken. However
    many copies there are, k rows per query and block are passed on.
    """
    cells = 4_000_000

    def best(block, queries):
        import numpy
        import pandas

        empty = pandas.DataFrame({query_id: [], vector_id: [], "score": []})
        if not len(block) or not len(queries):
            return empty
        block = block.sort_values(vector_id)
        ids, asked = block[vector_id].to_numpy(), queries[query_id].to_numpy()
        matrix = numpy.stack(block["v"].to_numpy()).T
        questions = numpy.stack(queries["q"].to_numpy())
        keep = min(k, len(block))
        step = max(1, cells // len(block))
        parts = []
        for start in range(0, len(asked), step):
            scores = numpy.round(questions[start:start + step] @ matrix, 12)
            limit = numpy.partition(scores, -keep, axis=1)[:, -keep][:, None]
            above, level = scores > limit, scores == limit
            room = keep - above.sum(axis=1, keepdims=True)
            chosen = above | (level & (level.cumsum(axis=1) <= room))
            at_query, at_vector = numpy.nonzero(chosen)
            parts.append(pandas.DataFrame({
                query_id: asked[start:start + step][at_query],
                vector_id: ids[at_vector],
                "score": scores[at_query, at_vector],
            }))
        return pandas.concat(parts, ignore_index=True)

    return best


def retrieve_texts(
    found: DataFrame, texts: DataFrame, vector_id: str, text: str, query_id: str = "query_id",
    min_length: int = 60, limit: int = 5,
) -> DataFrame:
    """Of the vectors found, the first ``limit`` per query whose text is long enough."""
    joined = found.join(texts.select(vector_id, strip(text).alias(text)), vector_id)
    kept = joined.filter(long_enough(text, min_length))
    return top_per_group(kept, query_id, "score", limit, vector_id, out="place")


def points(
    df: DataFrame, namespace: str, text: str, cid: str, vector: str, payload: list[str]
) -> DataFrame:
    """Rows of a vector store: id from the content id, vector and payload."""
    return embeddable(df, text, cid).select(
        uuid5(namespace, cid).alias("id"),
        F.col(vector).alias("vector"),
        F.struct(*payload).alias("payload"),
    )
