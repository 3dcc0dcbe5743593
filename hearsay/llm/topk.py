"""Exact top-k search by inner product with a three-phase uniform threshold.

A node holds one slice of the components of a block of vectors; a score is the sum of its parts
over the slices.

1. Every node gathers, per query, its list of the k highest parts. The rows on the lists are
   scored exactly, and the k-th best score of a query is a safe cutoff: the result cannot
   hold less.
2. The cutoff goes to all nodes. A score that reaches it has a part of at least cutoff / slices, so
   every node sends the rows whose part reaches this uniform threshold.
3. Parts of a row are added up. Where all slices were sent the sum is the score; the other rows
   are resolved exactly, and the best k stay. Ids go to where vectors are, never vectors along with
   every pair of ids.

All parts and scores are exact: 64-bit integers where the largest component of the table leaves room
for that, else decimals of 38 digits.

Queries and vectors meet in blocks. Equal vectors are searched once and given back to their rows
at the end; of each, the k + 1 smallest ids are all that a result can show.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.llm.frames import binaries, written

SCALE = 256
#: Scaled components beyond this are cut to it: inner products of 16,384 of them have 38 digits.
COMPONENT_BOUND = 1 << 56
MOST_LONG = (1 << 63) - 1
WIDE = "decimal(38,0)"
SLICES = 2
#: Rows of a block at most, and bytes of their components.
QUERY_BLOCK = 512
VECTOR_BLOCK = 4096
BLOCK_BYTES = 16 << 20


def quantized(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, dim, v (floor(256 * x) of each component as little-endian 64-bit integers) and most
    (the largest size of these).

    Left out are rows with a null id, and vectors that are null, empty or hold a null or a
    non-finite component; components beyond COMPONENT_BOUND are cut to it. Of rows that share an
    id the one with the smallest v counts, so repeated rows count once.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids, dims, packed, most = [], [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i is None or not x.is_valid or not len(x) or x.values.null_count:
                    continue
                found = np.floor(SCALE * x.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(found).all():
                    found = np.clip(found, -COMPONENT_BOUND, COMPONENT_BOUND)
                    ids.append(i)
                    dims.append(len(found))
                    packed.append(found.astype("<i8").tobytes())
                    most.append(int(np.abs(found).max()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), binaries(packed),
                 pa.array(most, pa.int64())],
                ["vec_id", "dim", "v", "most"],
            )

    return (
        vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("v"))
        .mapInArrow(batches, "vec_id bigint, dim int, v binary, most bigint")
        .groupBy("vec_id").agg(
            F.min_by(F.struct("dim", "most"), "v").alias("of"), F.min("v").alias("v"))
        .select("vec_id", "of.dim", "v", "of.most")
    )


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows: by doubles, by 64-bit integers or by Python's integers,
    whichever hold the largest that can be."""
    most = int(np.abs(left).max(initial=0)) * int(np.abs(right).max(initial=0)) * left.shape[1]
    if most < 1 << 53:
        return (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return left @ right.T
    return left.astype(object) @ right.T.astype(object)


def rowwise(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of each row with its partner."""
    most = int(np.abs(left).max(initial=0)) * int(np.abs(right).max(initial=0)) * left.shape[1]
    kind = np.int64 if most < 1 << 63 else object
    return (left.astype(kind) * right.astype(kind)).sum(axis=1)


def numbers(values: np.ndarray, kind: str) -> pa.Array:
    """Integers as an Arrow column of the score type."""
    if kind != WIDE:
        return pa.array(values.astype(np.int64), pa.int64())
    if values.dtype == object:
        return pa.array([Decimal(x) for x in values.tolist()], pa.decimal128(38, 0))
    return pa.array(values, pa.int64()).cast(pa.decimal128(38, 0))


def score_kind(most: int, dim: int) -> str:
    """The type that holds all sums of ``dim`` products of components up to ``most``."""
    return "bigint" if most * most * dim < 1 << 62 else WIDE


def cut(dim: int, slices: int) -> list[tuple[int, int]]:
    ends = [dim * i // slices for i in range(slices + 1)]
    return list(zip(ends, ends[1:]))


def nodes(blocks: DataFrame, slices: int) -> DataFrame:
    """The slices of every block: dim, block, slice, ids, parts (both packed 64-bit integers)."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at in range(batch.num_rows):
                dim, block, items = (batch.column(i)[at].as_py() for i in range(3))
                whole = np.frombuffer(b"".join(x["v"] for x in items), "<i8").reshape(len(items), dim)
                ids = np.array([x["id"] for x in items], "<i8").tobytes()
                cutoffs = [None if x["cutoff"] is None else str(x["cutoff"]) for x in items]
                for s, (start, stop) in enumerate(cut(dim, slices)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dim], pa.int32()), pa.array([block], pa.int32()),
                         pa.array([s], pa.int32()), binaries([ids]),
                         pa.array([cutoffs], pa.list_(pa.string())),
                         binaries([np.ascontiguousarray(whole[:, start:stop]).tobytes()])],
                        ["dim", "block", "slice", "ids", "cutoffs", "parts"],
                    )

    return blocks.mapInArrow(
        batches, "dim int, block int, slice int, ids binary, cutoffs array<string>, parts binary"
    )


def blocked(rows: DataFrame, sizes: dict[int, int], size: int, cutoff: Column) -> DataFrame:
    """dim, block and items (id, v, cutoff) with about ``size`` rows to a block, fewer where they are
    long."""
    return (
        rows.withColumn("block", F.pmod(F.xxhash64("id"), _per_dim(sizes, size)).cast("int"))
        .groupBy("dim", "block")
        .agg(F.collect_list(F.struct("id", "v", cutoff.alias("cutoff"))).alias("items"))
    )


def _blocks(dim: int, n: int, size: int) -> int:
    return -(-n // max(1, min(size, BLOCK_BYTES // (8 * dim))))


def _per_dim(sizes: dict[int, int], size: int) -> Column:
    found = F.lit(1)
    for dim, n in sizes.items():
        found = F.when(F.col("dim") == dim, _blocks(dim, n, size)).otherwise(found)
    return found


def met(queries: DataFrame, vectors: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """Every vector node, followed by the query nodes of its slice: dim, slice, block, asking (null for
    the vector node), ids, parts, cutoffs. No row holds a pair of nodes."""
    q = queries.select(
        "dim", "slice", F.col("block").alias("asking"), "ids", "parts", "cutoffs",
        F.explode(F.sequence(F.lit(0), _per_dim(sizes, VECTOR_BLOCK) - 1)).alias("block"))
    return (
        vectors.withColumn("asking", F.lit(None).cast("int")).unionByName(q)
        .select("dim", "slice", "block", "asking", "ids", "parts", "cutoffs")
        .repartition("dim", "slice", "block")
        .sortWithinPartitions("dim", "slice", "block", "asking")  # nulls first
    )


def entries(nodes_met: DataFrame, slices: int, k: int, by_cutoff: bool, kind: str) -> DataFrame:
    """query, id, slice, part: each node's k highest parts of a query, or all that reach the
    uniform threshold of the query's cutoff (all, without a cutoff)."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, parts = None, None, None
        for batch in rows:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                start, stop = cut(row["dim"], slices)[row["slice"]]
                key = row["dim"], row["slice"], row["block"]
                own = np.frombuffer(row["ids"], "<i8")
                own_parts = np.frombuffer(row["parts"], "<i8").reshape(len(own), stop - start)
                if row["asking"] is None:
                    held, ids, parts = key, own, own_parts
                    continue
                if key != held:  # a block of no vectors
                    continue
                q_ids = own
                found = products(own_parts, parts)
                if by_cutoff:
                    # Without a cutoff all parts are sent: none is below the smallest.
                    low = min(int(found.min(initial=0)), -(1 << 62))
                    least = [low if c is None else -(-int(c) // slices) for c in row["cutoffs"]]
                    wide = found.dtype == object or max(map(abs, least), default=0) >= 1 << 63
                    least = np.array(least, object if wide else np.int64)
                    hit, col = np.nonzero((found >= least[:, None]).astype(bool))
                else:
                    # parts equal to the k-th are cut at any id: the list only gives a bound
                    keep = min(k, len(ids))
                    col = _largest(found, keep).ravel()
                    hit = np.repeat(np.arange(len(q_ids)), keep)
                for a in range(0, len(hit), 50_000):
                    h, c = hit[a:a + 50_000], col[a:a + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q_ids[h]), pa.array(ids[c]),
                         pa.array(np.full(len(h), row["slice"], np.int32)),
                         numbers(found[h, c], kind)],
                        ["query", "id", "slice", "part"],
                    )

    return nodes_met.mapInArrow(batches, f"query bigint, id bigint, slice int, part {kind}")


def _largest(found: np.ndarray, keep: int) -> np.ndarray:
    """The places of the ``keep`` largest of each row."""
    if found.dtype == object:
        return np.array([sorted(range(len(row)), key=row.__getitem__)[-keep:] for row in found.tolist()])
    return np.argpartition(-found, keep - 1, axis=1)[:, :keep]


def resolved(pairs: DataFrame, vectors: DataFrame, bins: int, kind: str) -> DataFrame:
    """query, id and the exact score of each pair (query, id).

    Vectors lie in ``bins`` by a hash of their ids. A bin gets its vectors, then of each query that
    asks for some its vector, and the ids it asks for: no vector goes along with every pair.
    """
    own = vectors.select("id", "v")
    binned = pairs.select(F.pmod(F.xxhash64("id"), F.lit(bins)).alias("bin"), "query", "id")
    asking = binned.select("bin", "query").distinct().join(
        own.select(F.col("id").alias("query"), "v"), "query")
    none = F.lit(None)
    rows = (
        own.select(F.pmod(F.xxhash64("id"), F.lit(bins)).alias("bin"),
                   none.cast("bigint").alias("query"), "id", "v")
        .unionByName(asking.select("bin", "query", none.cast("bigint").alias("id"), "v"))
        .unionByName(binned.withColumn("v", none.cast("binary")))
        .repartition("bin").sortWithinPartitions("bin", "query", "id")  # nulls first
    )

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, known, vector = None, [], {}, None
        for batch in stream:
            bin_of = batch.column("bin").to_numpy()
            query, ids = (batch.column(c).fill_null(0).to_numpy() for c in ("query", "id"))
            of_query = batch.column("query").is_valid().to_numpy(zero_copy_only=False)
            v = batch.column("v")
            of_pair = v.is_null().to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(
                (np.diff(bin_of, prepend=bin_of[:1]) != 0) | (np.diff(query, prepend=query[:1]) != 0)
                | np.diff(of_query, prepend=of_query[:1]) | np.diff(of_pair, prepend=of_pair[:1])
            ).tolist()
            found = []
            for start, stop in zip([0, *starts], [*starts, batch.num_rows]):
                if start == stop:
                    continue
                if bin_of[start] != at:
                    at, held, known = bin_of[start], [], {}
                if not of_query[start]:
                    held += zip(ids[start:stop].tolist(), v[start:stop].to_pylist())
                elif not of_pair[start]:
                    if held:
                        known, held = _by_dim(held), []
                    vector = np.frombuffer(v[start].as_py(), "<i8")
                else:
                    there, whole = known[len(vector)]
                    wanted = whole[np.searchsorted(there, ids[start:stop])]
                    found.append((start, stop, rowwise(vector[None], wanted)))
            if found:
                score = np.concatenate([x for _, _, x in found])
                rows = np.concatenate([np.arange(a, b) for a, b, _ in found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query[rows]), pa.array(ids[rows]), numbers(score, kind)],
                    ["query", "id", "score"],
                )

    return rows.mapInArrow(batches, f"query bigint, id bigint, score {kind}")


def _by_dim(vectors: list[tuple[int, bytes]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids, ascending as they come, and components of the vectors of each dimension."""
    dims = np.array([len(v) // 8 for _, v in vectors])
    out = {}
    for dim in np.unique(dims).tolist():
        own = [vectors[i] for i in np.flatnonzero(dims == dim)]
        whole = np.frombuffer(b"".join(v for _, v in own), "<i8").reshape(len(own), dim)
        out[dim] = np.array([i for i, _ in own], np.int64), whole
    return out


def _ranked(rows: DataFrame, k: int, keys: list[str], order: list) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(
    queries: DataFrame, vectors: DataFrame, k: int, slices: int = SLICES, kind: str = WIDE
) -> DataFrame:
    """query, id, score (of type ``kind``), rank: the k highest scores of each query among
    ``vectors``.

    Both have id (unique), dim and v; ``queries`` is part of ``vectors``, and a query's own row
    counts like any other. Only vectors of a query's dimension compare. Ties go to the smaller
    id. Distinct dimensions, one or a few, are counted by the driver.
    """
    slices = max(1, slices)
    sizes = {r.dim: r["count"] for r in vectors.groupBy("dim").count().collect()}
    asked = {r.dim: r["count"] for r in queries.groupBy("dim").count().collect()}
    none = F.lit(None).cast(kind)
    v_nodes = written(nodes(blocked(vectors, sizes, VECTOR_BLOCK, none), slices), "vector-nodes")
    # 1: local lists, their exact scores, the cutoff
    q_nodes = nodes(blocked(queries, asked, QUERY_BLOCK, none), slices)
    lists = entries(met(q_nodes, v_nodes, sizes), slices, k, by_cutoff=False, kind=kind)
    listed = _ranked(lists, k, ["query", "slice"], [F.desc("part"), "id"])
    bins = max(1, sum(_blocks(dim, n, VECTOR_BLOCK) for dim, n in sizes.items()))
    listed = written(listed.select("query", "id").distinct(), "listed")
    sure = written(resolved(listed, vectors, bins, kind), "listed-scores")
    cutoffs = (
        _ranked(sure, k, ["query"], [F.desc("score"), "id"])
        .groupBy("query").agg(F.min("score").alias("cutoff"), F.count("*").alias("n"))
        .where(F.col("n") == k).select(F.col("query").alias("id"), "cutoff")
    )
    # 2: what reaches the uniform threshold
    q_nodes = nodes(
        blocked(queries.join(cutoffs, "id", "left"), asked, QUERY_BLOCK, F.col("cutoff")), slices,
    )
    sent = written(
        entries(met(q_nodes, v_nodes, sizes), slices, k, by_cutoff=True, kind=kind)
        .groupBy("query", "id").agg(F.sum("part").cast(kind).alias("score"), F.count("*").alias("parts")),
        "sent-entries",
    )
    # 3: whole sums are scores, the rest is resolved
    scores = (
        sent.where(F.col("parts") == slices).select("query", "id", "score")
        .unionByName(resolved(
            sent.where(F.col("parts") < slices).select("query", "id"), vectors, bins, kind))
    )
    return _ranked(scores, k, ["query"], [F.desc("score"), "id"])


def nearest(vectors: DataFrame, every: int, k: int, slices: int = SLICES) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id ``every`` divides, the k highest
    inner products with the other vectors, ties to the smaller id; all, if there are fewer. Which
    rows take part, and how repeated ids count, is said at ``quantized``. Rows are ranked by their
    exact scores; a score that does not fit a long is given as the nearest one that does."""
    rows = written(quantized(vectors), "quantized")
    most, dim = rows.agg(F.max("most"), F.max("dim")).first()
    kind = score_kind(most or 0, dim or 1)
    same = Window.partitionBy("v").orderBy("vec_id")
    members = written(
        rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1),
        "members",
    )
    distinct = members.where("place = 1").select(F.col("vec_id").alias("id"), "dim", "v")
    asking = written(
        rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")
        .join(distinct.select("id", "v"), "v").select("query_id", "id"),
        "asking",
    )
    queries = distinct.join(asking.select("id").distinct(), "id", "left_semi")
    found = written(search(queries, distinct, k + 1, slices, kind), "found")
    of_class = members.join(distinct.select("id", "v"), "v").select("id", "vec_id")
    rows_found = _ranked(
        found.drop("rank").join(of_class, "id"), k + 1, ["query"], [F.desc("score"), "vec_id"]
    ).drop("rank")
    own = asking.withColumnRenamed("id", "query").join(rows_found, "query").where(
        "query_id != vec_id"
    )
    nearest_long = F.greatest(
        F.lit(-MOST_LONG - 1).cast(WIDE), F.least(F.lit(MOST_LONG).cast(WIDE), "score")
    ) if kind == WIDE else F.col("score")
    return _ranked(own, k, ["query_id"], [F.desc("score"), "vec_id"]).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id",
        nearest_long.cast("bigint").alias("score"),
    )


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and list_count(embedding) = len(embedding) and len(embedding) > 0
    and len(list_filter(embedding, lambda x: not isfinite(x))) = 0
)
select query_id, rank::int as rank, vec_id, score from (
  select q.vec_id as query_id, v.vec_id, list_inner_product(q.v, v.v)::bigint as score,
    row_number() over (partition by q.vec_id order by list_inner_product(q.v, v.v) desc, v.vec_id)
      as rank
  from v q join v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0
) where rank <= 5
"""
