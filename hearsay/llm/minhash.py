"""Near-duplicate groups by MinHash signatures and a multi-index Hamming join.

1. A document's set of shingles gives SYMBOLS minima, of which BITS bits are kept: its signature.
   Documents with equal sets are one node.
2. Signatures are split into CHUNKS chunks. Two signatures that differ in at most DISTANCE symbols
   have, by the pigeonhole principle, a chunk with few errors: with D = e * chunks + a, one of the
   first a + 1 chunks has at most e errors or one of the others at most e - 1. Those errors are
   enumerated: every choice of e symbols left out of a chunk gives a key, and both have one key
   in common. So all pairs within the distance are found.
3. Nodes meet in the lists of their keys. First each node is compared with the one that is first on
   most of its lists. Lists whose nodes are held together by that say no more; in the others every
   node outside the largest part is compared with all nodes, cell by cell of a bounded size. What
   leaves a cell are the edges of a spanning forest, never all pairs.
4. That makes blocks: nodes that chains of signatures within the distance hold together. The full
   sets of a block meet, again cell by cell, and decide which nodes link.

Nothing is lost within the signature distance. What the signature itself can lose: of pairs that
just reach a similarity of 0.85 about one in 46,000 is further apart than 27 of 84 symbols, of pairs
at 0.9 one in 188 million (``missed``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.components import components
from hearsay.llm.frames import binaries, mixed, slices, written
from hearsay.llm.linededup import Bloom
from hearsay.llm.ngramjoin import FILTER_POWER, digest_of, holds, id_filter, shingle_set

CHUNKS = 14
CHUNK_SYMBOLS = 6
SYMBOLS = CHUNKS * CHUNK_SYMBOLS
BITS = 16
DISTANCE = 27
#: Nodes and shingles of each side of a cell, about.
CELL_NODES = 1024
CELL_SHINGLES = 400_000
#: Shingles that are hashed at once.
HASHED = 4096

_DRAW = np.random.default_rng(20_011)
_FACTORS = _DRAW.integers(0, 1 << 63, SYMBOLS, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SUMMANDS = _DRAW.integers(0, 1 << 63, SYMBOLS, np.int64).astype(np.uint64) << np.uint64(1)


def missed(similarity: float, distance: int = DISTANCE, symbols: int = SYMBOLS) -> float:
    """The probability that signatures of sets of this similarity are further apart than that."""
    differ = (1 - similarity) * (1 - 2.0 ** -BITS)
    return sum(math.comb(symbols, d) * differ ** d * (1 - differ) ** (symbols - d)
               for d in range(distance + 1, symbols + 1))


def signature(shingles: np.ndarray) -> np.ndarray:
    """SYMBOLS symbols of BITS bits: from the minimum of the set under each hash function."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), HASHED):
        part = shingles[start:start + HASHED, None]
        least = np.minimum(least, (part * _FACTORS + _SUMMANDS).min(axis=0))
    return (mixed(least) & np.uint64((1 << BITS) - 1)).astype(np.uint16)


def chunk_errors(distance: int, chunks: int) -> list[int]:
    """Errors to allow in each chunk, so that all pairs within the distance meet; -1: none needed."""
    errors, rest = divmod(distance, chunks)
    return [errors if chunk <= rest else errors - 1 for chunk in range(chunks)]


def chunk_keys(signatures: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """64-bit keys of each signature (a row): one for each chunk and choice of symbols left out."""
    n = len(signatures)
    places = np.arange(SYMBOLS, dtype=np.uint64) << np.uint64(BITS)
    terms = mixed(signatures.astype(np.uint64) + places[None, :] + np.uint64(1))
    terms = terms.reshape(n, CHUNKS, CHUNK_SYMBOLS)
    keys = []
    for chunk, errors in enumerate(chunk_errors(distance, CHUNKS)):
        if errors < 0:
            continue
        total = terms[:, chunk].sum(axis=1, dtype=np.uint64)
        for left_out in combinations(range(CHUNK_SYMBOLS), errors):
            key = total - terms[:, chunk, list(left_out)].sum(axis=1, dtype=np.uint64)
            keys.append(mixed(key + np.uint64(len(keys) + 1)))
    return np.stack(keys, axis=1)


def signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (size of the set), digest and signature of every row."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in slices(batch):
                n, digest, signs = [], [], []
                for text in part.column("text").to_pylist():
                    shingles = shingle_set(text, words)
                    n.append(len(shingles))
                    digest.append(digest_of(shingles))
                    signs.append(signature(shingles).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), binaries(digest),
                     binaries(signs)],
                    ["doc_id", "n", "digest", "signature"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        batches, "doc_id bigint, n bigint, digest binary, signature binary"
    )


def _signatures(column: pa.Array) -> np.ndarray:
    joined = b"".join(x.as_py() for x in column)
    return np.frombuffer(joined, np.uint16).reshape(len(column), SYMBOLS)


def keyed(nodes: DataFrame, distance: int) -> DataFrame:
    """key and node: every key of every node."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in slices(batch, 1024):
                keys = chunk_keys(_signatures(part.column("signature")), distance)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)),
                     pa.array(np.repeat(part.column("node").to_numpy(), keys.shape[1]))],
                    ["key", "node"],
                )

    return nodes.select("node", "signature").mapInArrow(batches, "key bigint, node bigint")


def listed(nodes: DataFrame, distance: int) -> DataFrame:
    """key, node and first: the lists with several nodes, each with its smallest node. Lists are
    counted before any is gathered, and a long one is rows of many tasks like any other."""
    first = written(
        keyed(nodes, distance).groupBy("key")
        .agg(F.min("node").alias("first"), F.max("node").alias("last"))
        .where("first < last").select("key", "first"),
        "lists",
    )
    return written(keyed(nodes, distance).join(first, "key"), "members")


def close_pairs(pairs: DataFrame, nodes: DataFrame, distance: int, percent: int) -> DataFrame:
    """Those of the pairs (x, y) whose signatures are within the distance and whose sizes allow
    for the similarity."""
    of = lambda side: nodes.select(
        F.col("node").alias(side), F.col("signature").alias(f"s{side}"), F.col("n").alias(f"n{side}"))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in slices(batch, 1024):
                differ = _signatures(part.column("sx")) != _signatures(part.column("sy"))
                yield part.filter(pa.array(differ.sum(axis=1) <= distance)).select(["x", "y"])

    return (
        pairs.join(of("x"), "x").join(of("y"), "y")
        .where(f"100 * least(nx, ny) >= {percent} * greatest(nx, ny)")
        .select("x", "y", "sx", "sy").mapInArrow(batches, "x bigint, y bigint")
    )


def likeliest(members: DataFrame) -> DataFrame:
    """x, y: each node y with the node x that is first on most of its lists."""
    return (
        members.where("node != first").groupBy("first", "node").agg(F.count("*").alias("lists"))
        .groupBy("node").agg(F.max(F.struct("lists", (-F.col("first")).alias("minus"))).alias("best"))
        .select((-F.col("best.minus")).alias("x"), F.col("node").alias("y"))
    )


class Forest:
    """Which of some nodes are held together so far, and the edges that did it."""

    def __init__(self, parts: list):
        first: dict = {}
        self.parent = [first.setdefault(part, i) for i, part in enumerate(parts)]
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def roots(self) -> np.ndarray:
        """The root of each node."""
        found = np.array(self.parent, np.int64)
        while (found[found] != found).any():
            found = found[found]
        self.parent = found.tolist()
        return found

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[b] = a
            self.edges.append((i, j))


class Cell:
    """Nodes that are compared with each other, or those of one side with those of another one."""

    def __init__(self):
        self.nodes: list[int] = []
        self.sides: list[int] = []
        self.parts: list[int] = []
        self.sizes: list[int] = []
        self.signatures: list[bytes] = []
        self.sets: list[np.ndarray] = []

    def edges(self, distance: int, percent: int) -> list[tuple[int, int]]:
        """A spanning forest of the nodes that are alike, over what their parts hold together.

        Nodes are alike if their signatures are within the distance and, where the cell has their
        sets, if these have the similarity. Side 0 is compared with side 1, side 2 with itself.
        """
        if not self.nodes:
            return []
        forest = Forest(self.parts)
        signs = np.frombuffer(b"".join(self.signatures), np.uint16).reshape(-1, SYMBOLS)
        sizes, sides = np.array(self.sizes), np.array(self.sides)
        for i in range(len(self.nodes)):
            if sides[i] == 1:
                continue
            roots = forest.roots()
            able = roots != roots[i]
            able &= 100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])
            if sides[i] == 2:
                able[:i] = False
            else:
                able &= sides == 1
            others = np.flatnonzero(able)
            if not len(others):
                continue
            near = others[(signs[others] != signs[i]).sum(axis=1) <= distance]
            if self.sets:
                near = near[[self.similar(i, j, percent) for j in near.tolist()]] if len(near) else near
            for j in near.tolist():
                forest.join(i, j)
        return [(self.nodes[i], self.nodes[j]) for i, j in forest.edges]

    def similar(self, i: int, j: int, percent: int) -> bool:
        small, large = sorted((self.sets[i], self.sets[j]), key=len)
        shared = int(holds(large, small).sum())
        return 100 * shared >= percent * (len(small) + len(large) - shared)


def cell_edges(rows: DataFrame, cell: list[str], distance: int, percent: int) -> DataFrame:
    """x, y: the edges of every cell. ``rows`` has the columns of ``cell``, node, side, part, n,
    signature and perhaps shingles. Cells are read as they stream by, one at a time. A node that
    comes twice counts once."""
    with_sets = "shingles" in rows.columns
    columns = ["node", "side", "part", "n", "signature", *["shingles"] * with_sets]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, seen = None, Cell(), set()
        for batch in stream:
            out = []
            for part in slices(batch):
                keys = zip(*(part.column(c).to_pylist() for c in cell))
                for own, row in zip(keys, zip(*(part.column(c).to_pylist() for c in columns))):
                    if own != key:
                        out += held.edges(distance, percent)
                        key, held, seen = own, Cell(), set()
                    if row[:2] in seen:
                        continue
                    seen.add(row[:2])
                    for values, value in zip(
                        (held.nodes, held.sides, held.parts, held.sizes, held.signatures), row
                    ):
                        values.append(value)
                    if with_sets:
                        held.sets.append(np.frombuffer(row[5], np.uint64))
            yield _pairs(out)
        yield _pairs(held.edges(distance, percent))

    return (
        rows.select(*cell, *columns).repartition(*cell).sortWithinPartitions(*cell, "side", "node")
        .mapInArrow(batches, "x bigint, y bigint")
    )


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["x", "y"]
    )


def open_lists(members: DataFrame, edges: DataFrame) -> DataFrame:
    """key, node, part, largest, total and others: the lists whose nodes are in several parts of the
    graph of the edges, each with its largest part, and how many nodes it has in all and outside
    of that part."""
    labels = components(edges)
    labelled = written(
        members.select("key", "node").join(labels, "node", "left")
        .select("key", "node", F.coalesce("component", "node").alias("part")),
        "labelled",
    )
    lists = (
        labelled.groupBy("key", "part").agg(F.count("*").alias("size"))
        .groupBy("key").agg(
            F.max(F.struct("size", "part")).alias("most"), F.sum("size").alias("total"),
            F.count("*").alias("parts"),
        )
        .where("parts > 1")
        .select("key", F.col("most.part").alias("largest"), "total",
                (F.col("total") - F.col("most.size")).alias("others"))
    )
    return labelled.join(lists, "key")


def list_cells(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The cells of the open lists: key, a, b, and their nodes. Side 0 is a group of the nodes
    outside the largest part, side 1 a group of all nodes."""
    groups = lambda size: F.ceil(F.col(size) / CELL_NODES).cast("int")
    group = lambda size, seed: F.pmod(F.xxhash64("node", F.lit(seed)), groups(size)).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), groups(size) - 1))
    asking = rows.where("part != largest").select(
        "key", group("others", 1).alias("a"), every("total").alias("b"), "node", "part",
        F.lit(0).alias("side"),
    )
    asked = rows.select(
        "key", every("others").alias("a"), group("total", 2).alias("b"), "node", "part",
        F.lit(1).alias("side"),
    )
    return asking.unionByName(asked).join(nodes.select("node", "n", "signature"), "node")


def block_cells(blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """The cells of the blocks: block, a and b, and the nodes of groups a and b with their sets."""
    sizes = blocks.groupBy("block").agg(
        F.greatest(F.ceil(F.sum("n") / CELL_SHINGLES), F.ceil(F.count("*") / CELL_NODES))
        .cast("int").alias("groups")
    )
    rows = (
        blocks.join(sizes, "block")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("groups")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        .select(
            "block", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
            "node", "n", "signature", F.col("node").alias("part"),
            F.expr("case when own = other then 2 when own < other then 0 else 1 end").alias("side"),
        )
    )
    return rows.join(sets, "node")


def node_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node and shingles (the packed sorted set) of the nodes in ``wanted`` (node, doc, digest).
    Only texts that a filter of their ids lets pass are shuffled."""
    packed = np.packbits(id_filter(wanted.select("doc")).bits)
    carried = docs.sparkSession.sparkContext.broadcast(packed)

    def passing(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(FILTER_POWER, np.unpackbits(carried.value).astype(bool))
        for batch in rows:
            yield batch.filter(pa.array(bloom.has(batch.column("doc").to_numpy().view(np.uint64))))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in slices(batch):
                sets = [shingle_set(t, words) for t in part.column("text").to_pylist()]
                own = [digest_of(s) == d for s, d in zip(sets, part.column("digest").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("node").filter(pa.array(own, pa.bool_())),
                     binaries([s.tobytes() for s, held in zip(sets, own) if held])],
                    ["node", "shingles"],
                )

    passed = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("bigint").alias("doc"), "text"
    ).mapInArrow(passing, "doc bigint, text string")
    return passed.join(wanted.select("node", "doc", "digest"), "doc").select(
        "node", "digest", "text"
    ).mapInArrow(batches, "node bigint, shingles binary")


def near_duplicates(
    docs: DataFrame, words: int = 3, percent: int = 85, distance: int = DISTANCE
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Documents link whose sets of ``words``-word shingles have a Jaccard similarity of ``percent``
    hundredths or more (and signatures within the distance); component_id is the smallest doc_id
    that links reach, itself included, and kept says that it is the row's own. Null and empty
    texts, and texts without words, have no shingles and link with nothing, not even each other.
    Rows with equal sets are one node; of rows that share a doc_id but not the set each is in the
    group of its own set. A row with a null doc_id takes no part: its component is null and it is
    kept. Shingles are compared by 64-bit hashes.
    """
    rows = written(signed(docs, words), "signatures")
    nodes = written(
        rows.where("n > 0 and doc_id is not null").groupBy("digest")
        .agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"),
             F.first("signature").alias("signature"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    members = listed(nodes, distance)
    edges = written(close_pairs(likeliest(members), nodes, distance, percent), "edges")
    cells = list_cells(written(open_lists(members, edges), "open-lists"), nodes)
    more = cell_edges(cells, ["key", "a", "b"], distance, percent)
    edges = written(edges.unionByName(more), "edges")
    blocks = written(
        components(edges).withColumnRenamed("component", "block").join(nodes, "node"), "blocks"
    )
    links = written(
        cell_edges(block_cells(blocks, node_sets(docs, blocks, words)), ["block", "a", "b"],
                   distance, percent),
        "links",
    )
    labelled = written(
        nodes.select("digest", "node", "doc").join(components(links), "node", "left")
        .select("digest", "doc", F.coalesce("component", "node").alias("component")),
        "labels",
    )
    first = labelled.groupBy("component").agg(F.min("doc").alias("component_id"))
    of_digest = written(labelled.join(first, "component").select("digest", "component_id"), "groups")
    component = (
        F.when(F.col("n") == 0, F.col("doc_id"))
        .when(F.col("doc_id").isNotNull(), F.col("component_id"))
    )
    return (
        rows.select("doc_id", "n", "digest").join(of_digest, "digest", "left")
        .withColumn("component_id", component)
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )
