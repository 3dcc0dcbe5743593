"""N-gram Jaccard join by T-occurrence search.

Two sets of n and m shingles are similar enough exactly if they share at least T of them, with T
following from n, m and the similarity. Searching a document's partners is therefore to find all
documents that are on T of the inverted lists of its shingles.

1. Documents with equal sets are one node.
2. The shingles have one global order: by hash, but the most frequent ones last. The first shingles
   of a set, one more than it may lack, are its prefix: documents that reach T have one in
   common there. Only prefixes are put into inverted lists. They are taken a little longer than
   that, as then a pair must share several before it is worth a look at the whole sets. Most
   shingles are in one prefix alone: 32 bits of each go to blocks of the hash space, which tell those
   that others may hold too, and only these become entries of lists.
3. Short lists give pairs of nodes, with the number of lists they share and how far in the order.
   Pairs that cannot reach T after that are out, unless a long list holds them together.
4. Pairs and long lists hold nodes together in blocks, and no link leaves a block. The whole sets of a
   block meet in one task, where DivideSkip searches them: the inverted lists of a node's
   shingles are merged but for the longest, and what is on enough of them is looked up in the
   longest by binary search. Who is in a group already needs no comparing: what counts is
   who can be reached.
5. Blocks beyond a fixed size are dealt to cells of a bounded size, neighbours on a long list close
   together. A node goes to the cells that hold candidates of it, and searches them; whole sets are
   never sent pair by pair. Long lists are not paired there; one of their nodes after another probes
   the whole list, until the others of the list are in one component or have probed themselves.

The order needs to be the same everywhere, but it need not be right about frequencies: they only
decide how long lists get. So a bounded number of the most frequent shingles is broadcast.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearsay.llm.components import components
from hearsay.llm.frames import binaries, mixed, slices, worker_cache, written
from hearsay.llm.linededup import Bloom

#: Frequent shingles that go last in the order at most, and how many of the documents counted
#: together (with different sets, about COUNTED shingles in all) make one a candidate for that.
FREQUENT = 200_000
BATCH_DOCS = 3
COUNTED = 1_500_000
#: Nodes on a list that is paired; longer lists are probed.
SHORT_LIST = 50
#: Nodes that probe a long list in the first round (three times as many in each further one), and
#: candidates and shingles of them that meet in one place, a cell, at most.
FIRST_PROBES = 1
CANDIDATES = 4096
CELL_SHINGLES = 1_000_000
#: Shingles of a block that one task searches at most.
BLOCK_SHINGLES = 2_000_000
#: What prefixes are longer by, as a share of the set.
LONGER = 0.05
#: Size of the filter of wanted ids (as a power of two, in bits), and parts it is made in.
FILTER_POWER = 23
FILTER_PARTS = 32
#: Shingles of prefixes that one block of the hash space counts, bits for each of them in the filter
#: of repeated ones, and bytes of that filter at most, which is broadcast.
BLOCK_HASHES = 1_000_000
REPEATED_BITS = 4
REPEATED_BYTES = 16 << 20
#: Words whose hashes a worker keeps.
MEMO_WORDS = 250_000
#: DivideSkip: weight of the merge against the binary searches.
MU = 2.0


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The set of 64-bit hashes of a text's shingles, sorted. A-Z are lower-cased and words end
    at ASCII white space. Fewer words are one shingle, no words none."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    cache = worker_cache("ngramjoin")
    memo = cache.get("word-hashes")
    if memo is None:
        memo = cache["word-hashes"] = _WordHashes()
    at = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    size = min(words, len(found))
    n = len(found) - size + 1
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + at[i:i + n]
    return np.unique(mixed(total))


def digest_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def frequent_shingles(docs: DataFrame, words: int, most: int) -> np.ndarray:
    """The most frequent shingles among those that many documents of one batch share; sorted,
    ``most`` at the most."""

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]),
                                  return_counts=True)
        held = counts >= BATCH_DOCS
        return pa.RecordBatch.from_arrays(
            [pa.array(found[held].view(np.int64)), pa.array(counts[held].astype(np.int64))],
            ["shingle", "docs"],
        )

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, size = {}, 0
        for batch in rows:
            for part in slices(batch):
                for text in part.column("text").to_pylist():
                    shingles = shingle_set(text, words)
                    key = digest_of(shingles)
                    if key not in sets:
                        sets[key] = shingles
                        size += len(shingles)
                if size >= COUNTED:
                    yield counted(list(sets.values()))
                    sets, size = {}, 0
        yield counted(list(sets.values()))

    top = (
        docs.select("text").mapInArrow(batches, "shingle bigint, docs bigint")
        .groupBy("shingle").agg(F.sum("docs").alias("docs"))
        .orderBy(F.desc("docs"), "shingle").limit(most).select("shingle").toPandas()
    )
    return np.sort(top["shingle"].to_numpy(np.int64).view(np.uint64))


def holds(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[at] == values


def prefixes(docs: DataFrame, words: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, n (size of the set), digest, prefix (packed hashes in the global order) and rare
    (how many of these are not frequent), one row per row."""
    carried = docs.sparkSession.sparkContext.broadcast(frequent)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in slices(batch):
                n, digest, prefix, rare = [], [], [], []
                for text in part.column("text").to_pylist():
                    shingles = shingle_set(text, words)
                    size = len(shingles)
                    length = size - -(-percent * size // 100) + 1 if size else 0
                    length = min(size, length + math.ceil(LONGER * size))
                    last = holds(carried.value, shingles)
                    first = shingles[~last][:length]
                    n.append(size)
                    digest.append(digest_of(shingles))
                    prefix.append(np.concatenate([first, shingles[last][:length - len(first)]])
                                  .tobytes())
                    rare.append(len(first))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), binaries(digest),
                     binaries(prefix), pa.array(rare, pa.int64())],
                    ["doc_id", "n", "digest", "prefix", "rare"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        batches, "doc_id bigint, n bigint, digest binary, prefix binary, rare bigint"
    )


class Repeated:
    """A filter of shingles, made of parts for blocks of the hash space. It has no false negatives;
    fuller filters cost entries of lists, not results."""

    def __init__(self, blocks: int, power: int, bits: bytes | None = None):
        self.blocks, self.power = blocks, power
        self.bits = np.frombuffer(bits or bytes(blocks << power >> 3), np.uint8)

    @classmethod
    def sized(cls, hashes: int) -> Repeated:
        blocks = max(1, -(-hashes // BLOCK_HASHES))
        bits = min(REPEATED_BITS * min(hashes, BLOCK_HASHES), REPEATED_BYTES * 8 // blocks)
        return cls(blocks, max(9, int(np.log2(max(1, bits)))))

    @staticmethod
    def parted(shingles: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """Block and 32 further bits of each."""
        x = mixed(shingles)
        return ((x >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64), x.astype(np.uint32)

    @staticmethod
    def places(marks: np.ndarray, power: int) -> list[np.ndarray]:
        mask = np.uint64((1 << power) - 1)
        first, step = (mixed(marks.astype(np.uint64) + np.uint64(i << 32)) for i in (1, 2))
        return [((first + np.uint64(i) * step) & mask).astype(np.int64) for i in range(3)]

    def has(self, shingles: np.ndarray) -> np.ndarray:
        block, marks = self.parted(shingles, self.blocks)
        found = np.ones(len(marks), bool)
        for place in self.places(marks, self.power):
            at = (block << self.power) + place
            found &= (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return found


def repeated_filter(signed: DataFrame) -> Repeated:
    """The shingles that the rare parts of several prefixes hold, and few others. 32 bits of each are
    sent, packed; what comes to the driver is of bounded size."""
    whole = Repeated.sized(signed.agg(F.coalesce(F.sum("rare"), F.lit(0))).first()[0])
    blocks, power = whole.blocks, whole.power

    def dealt(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            first = [np.frombuffer(x.as_py(), np.uint64)[:r] for x, r in
                     zip(batch.column("prefix"), batch.column("rare").to_pylist())]
            block, marks = Repeated.parted(
                np.concatenate([np.zeros(0, np.uint64), *first]), blocks)
            order = np.argsort(block, kind="stable")
            held, starts = np.unique(block[order], return_index=True)
            parts = np.split(marks[order], starts[1:]) if len(held) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(held), binaries([part.tobytes() for part in parts])], ["block", "marks"])

    def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(block: int, marks: list[bytes]) -> pa.RecordBatch:
            found, counts = np.unique(np.frombuffer(b"".join(marks), np.uint32), return_counts=True)
            bits = np.zeros(1 << power, bool)
            for place in Repeated.places(found[counts > 1], power):
                bits[place] = True
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), binaries([np.packbits(bits).tobytes()])],
                ["block", "bits"])

        own, marks = None, []
        for batch in rows:
            for block, found in zip(batch.column("block").to_pylist(), batch.column("marks").to_pylist()):
                if block != own:
                    if marks:
                        yield part(own, marks)
                    own, marks = block, []
                marks.append(found)
        if marks:
            yield part(own, marks)

    parts = (
        signed.select("prefix", "rare").mapInArrow(dealt, "block bigint, marks binary")
        .repartition("block").sortWithinPartitions("block")
        .mapInArrow(counted, "block bigint, bits binary").collect()
    )
    held = {row.block: bytes(row.bits) for row in parts}
    none = bytes(1 << power >> 3)
    return Repeated(blocks, power, b"".join(held.get(b, none) for b in range(blocks)))


def repeated_only(signed: DataFrame) -> DataFrame:
    """doc_id, n, digest, rare, and shingles and places (from 1) of what is frequent in the prefix or
    passes the filter of repeated shingles."""
    repeated = repeated_filter(signed)
    blocks, power = repeated.blocks, repeated.power
    carried = signed.sparkSession.sparkContext.broadcast(repeated.bits.tobytes())

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Repeated(blocks, power, carried.value)
        for batch in rows:
            for part in slices(batch):
                lists = [np.frombuffer(x.as_py(), np.uint64) for x in part.column("prefix")]
                sizes = [len(x) for x in lists]
                every = np.concatenate([np.zeros(0, np.uint64), *lists])
                place = np.concatenate([np.zeros(0, np.int32),
                                        *[np.arange(1, s + 1, dtype=np.int32) for s in sizes]])
                kept = known.has(every) | (place > np.repeat(part.column("rare").to_numpy(), sizes))
                shingles, places, start = [], [], 0
                for size in sizes:
                    own = kept[start:start + size]
                    shingles.append(every[start:start + size][own].tobytes())
                    places.append(place[start:start + size][own].tobytes())
                    start += size
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("doc_id", "n", "digest", "rare")]
                    + [binaries(shingles), binaries(places)],
                    ["doc_id", "n", "digest", "rare", "shingles", "places"],
                )

    return signed.select("doc_id", "n", "digest", "rare", "prefix").mapInArrow(
        batches, "doc_id bigint, n bigint, digest binary, rare bigint, shingles binary, places binary"
    )


def postings(nodes: DataFrame) -> DataFrame:
    """shingle, node, pos (from 1), rare (it is not one of the frequent shingles), n (size of the
    node's set) and last (how many rare shingles its prefix has)."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in slices(batch):
                lists = [np.frombuffer(x.as_py(), np.int64) for x in part.column("shingles")]
                sizes = [len(x) for x in lists]
                pos = np.frombuffer(b"".join(part.column("places").to_pylist()), np.int32)
                node, n, rare = (np.repeat(part.column(c).to_numpy(), sizes)
                                 for c in ("node", "n", "rare"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([np.zeros(0, np.int64), *lists])), pa.array(node),
                     pa.array(pos), pa.array(pos <= rare),
                     pa.array(n.astype(np.int32)), pa.array(rare.astype(np.int32))],
                    ["shingle", "node", "pos", "rare", "n", "last"],
                )

    return nodes.select("node", "shingles", "places", "rare", "n").mapInArrow(
        batches, "shingle bigint, node bigint, pos int, rare boolean, n int, last int"
    )


def candidate_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """x, y (x < y) that may reach T, from short lists.

    Up to the end of the shorter prefix, x has at least i and y at least j shingles, if those at i
    and j are the last they share, and one of them has all its prefix there. What they have there
    and do not share counts as difference. A pair that shares a long list too may be left out
    here, as long lists hold their nodes together anyway.
    """
    pairs = lists.selectExpr(
        "explode(flatten(transform(nodes, (a, at) -> transform(slice(nodes, at + 2, size(nodes)), "
        "b -> struct(a.node as x, b.node as y, a.pos as i, b.pos as j, a.n as xn, b.n as yn, "
        "a.last as xl, b.last as yl))))) as p"
    ).select("p.*").where(f"100 * least(xn, yn) >= {percent} * greatest(xn, yn)")
    first = [F.first(c).alias(c) for c in ("xn", "yn", "xl", "yl")]
    shared = pairs.groupBy("x", "y").agg(
        F.count("*").alias("shared"), F.max("i").alias("i"), F.max("j").alias("j"), *first
    )
    difference = F.expr("i + j + least(xl - i, yl - j) - 2 * shared")
    return shared.where(
        (100 + percent) * difference <= (100 - percent) * F.expr("xn + yn")
    ).select("x", "y")


class Index:
    """Inverted lists of shingles over a number of sets; entries of a list are in set order."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        owners = np.repeat(np.arange(len(sets)), self.sizes)
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        self.values, self.owners = values[order], owners[order]

    def search(self, query: np.ndarray, percent: int, among: np.ndarray | None = None) -> np.ndarray:
        """Positions of the sets (only of those marked in ``among``) that share at least T shingles
        with the query, by DivideSkip.

        The short lists are merged by counting their entries, which does in one vectorized step
        what a heap does entry by entry. What is on enough of them is looked up in the long
        lists by binary search.
        """
        n = len(query)
        goals = -(-percent * (n + self.sizes) // (100 + percent))
        allowed = 100 * np.minimum(n, self.sizes) >= percent * np.maximum(n, self.sizes)
        if among is not None:
            allowed &= among
        if not allowed.any():
            return np.zeros(0, np.int64)
        goal = int(goals[allowed].min())
        starts = np.searchsorted(self.values, query, "left")
        lengths = np.searchsorted(self.values, query, "right") - starts
        longest = max(2, int(lengths.max()))
        skipped = min(int(goal / (MU * math.log(longest) + 1)), goal - 1)
        order = np.argsort(lengths, kind="stable")
        short, long_lists = order[:n - skipped], order[n - skipped:]
        sizes = lengths[short]
        places = np.repeat(starts[short] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        counts = np.bincount(self.owners[places], minlength=len(self.sizes))
        candidates = np.flatnonzero(allowed & (counts >= goals - skipped))
        for i in long_lists[::-1].tolist():
            if len(candidates) and lengths[i]:
                counts[candidates] += holds(self.owners[starts[i]:starts[i] + lengths[i]], candidates)
        return candidates[counts[candidates] >= goals[candidates]]


def t_occurrence(query: np.ndarray, sets: list[np.ndarray], percent: int) -> list[int]:
    """Which of the sets share at least T shingles with the query."""
    return Index(sets).search(query, percent).tolist()


def block_links(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links from the smallest id of every group within a block to its other ids.

    Searches go on from what the one before has found, each among the sets that no group has yet.
    Sets of one id link like the id.
    """
    index = Index(sets)
    free = np.ones(len(sets), bool)
    out = []
    for root in np.argsort(np.array(ids), kind="stable").tolist():
        if not free[root]:
            continue
        free[root] = False
        waiting = [root]
        while waiting:
            found = index.search(sets[waiting.pop()], percent, free)
            free[found] = False
            waiting += found.tolist()
            out += [(ids[root], ids[i]) for i in found.tolist()]
    return out


def blocks_linked(sets: DataFrame, percent: int) -> DataFrame:
    """x, y: the links of every block, from node, block and shingles. A block is of bounded size
    and is searched as it streams by."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, members = None, [], []
        for batch in stream:
            out = []
            for part in slices(batch):
                for node, own, shingles in zip(*(part.column(c).to_pylist()
                                                 for c in ("node", "block", "shingles"))):
                    if own != block:
                        if ids:
                            out += block_links(ids, members, percent)
                        block, ids, members = own, [], []
                    ids.append(node)
                    members.append(np.frombuffer(shingles, np.uint64))
            yield _pairs(out)
        if ids:
            yield _pairs(block_links(ids, members, percent))

    return (
        sets.select("node", "block", "shingles").repartition("block")
        .sortWithinPartitions("block", "node").mapInArrow(batches, "x bigint, y bigint")
    )


def celled(larger: DataFrame, long_rows: DataFrame) -> DataFrame:
    """node and cell: nodes (with block and n) dealt to cells of a bounded size. Those that share their
    first long list follow each other."""
    first = long_rows.groupBy("node").agg(F.min("shingle").alias("first"))
    so_far = Window.partitionBy("block").orderBy("first", "node", "n").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    part = F.greatest(F.floor(F.sum("n").over(so_far) / CELL_SHINGLES),
                      F.floor(F.count("*").over(so_far) / CANDIDATES))
    return larger.join(first, "node", "left").select(
        "node", F.xxhash64("block", part).alias("cell")).distinct()


class Cell:
    """Members of a cell, which are searched once all are there. Groups of what links join up need
    no further comparing, so links are a forest, or little more, and never all pairs."""

    def __init__(self, percent: int):
        self.percent = percent
        self.ids, self.sets, self.groups, self.asking, self.index = [], [], [], [], None

    def take(self, node: int, group: int, shingles: np.ndarray, member: bool,
             asks: bool) -> list[tuple[int, int]]:
        """The links found so far. Members come first."""
        if not member:
            return self.among_members() + self.asked(node, group, shingles)
        if asks:
            self.asking.append(len(self.ids))
        self.ids.append(node)
        self.sets.append(shingles)
        self.groups.append(group)
        return []

    def among_members(self) -> list[tuple[int, int]]:
        if self.index or not self.ids:
            return []
        self.index, self.groups = Index(self.sets), np.array(self.groups)
        return [link for i in self.asking
                for link in self.asked(self.ids[i], int(self.groups[i]), self.sets[i])]

    def asked(self, node: int, group: int, shingles: np.ndarray) -> list[tuple[int, int]]:
        if not self.ids:
            return []
        links = []
        for i in self.index.search(shingles, self.percent, self.groups != group).tolist():
            if self.groups[i] != group:
                links.append((node, self.ids[i]))
                self.groups[self.groups == self.groups[i]] = group
        return links


def linked(asking: DataFrame, members: DataFrame, labels: DataFrame, sets: DataFrame,
           percent: int) -> DataFrame:
    """Links x, y whose whole sets reach T. Every node of ``asking`` (node, cell) searches those of
    ``members`` (node, cell) that are in the cell and, as ``labels`` say, not yet in one component
    with it. A set goes once to a cell, whatever it meets there. Links between nodes that other links of
    the cell already join are left out."""
    met = members.join(asking.select("cell").distinct(), "cell", "left_semi")
    rows = (
        asking.select("node", "cell", F.lit(True).alias("asks"), F.lit(False).alias("member"))
        .unionByName(met.select("node", "cell", F.lit(False).alias("asks"), F.lit(True).alias("member")))
        .groupBy("node", "cell").agg(F.max("asks").alias("asks"), F.max("member").alias("member"))
        .join(labels, "node", "left")
        .select("node", "cell", "asks", "member", F.coalesce("component", "node").alias("group"))
        .join(sets, "node")
        .withColumn("foreign", ~F.col("member"))
        .repartition("cell").sortWithinPartitions("cell", "foreign", "node")
    )

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell = None, Cell(percent)
        for batch in stream:
            out = []
            for part in slices(batch, 64):
                for own, node, group, shingles, member, asks in zip(
                    *(part.column(c).to_pylist()
                      for c in ("cell", "node", "group", "shingles", "member", "asks"))
                ):
                    if own != at:
                        out += cell.among_members()
                        at, cell = own, Cell(percent)
                    out += cell.take(node, group, np.frombuffer(shingles, np.uint64), member, asks)
            yield _pairs(out)
        yield _pairs(cell.among_members())

    return rows.select("cell", "node", "group", "shingles", "member", "asks").mapInArrow(
        batches, "x bigint, y bigint")


def pairs_linked(pairs: DataFrame, cells: DataFrame, labels: DataFrame, sets: DataFrame,
                 percent: int) -> DataFrame:
    """Links that hold together all pairs (x, y) whose whole sets reach T: x searches the cells of y."""
    placed = pairs.join(cells.withColumnRenamed("node", "y"), "y")
    return linked(
        placed.select(F.col("x").alias("node"), "cell").distinct(),
        placed.select(F.col("y").alias("node"), "cell").distinct(), labels, sets, percent,
    )


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["x", "y"]
    )


def id_filter(ids: DataFrame) -> Bloom:
    """A Bloom filter of the ids. It has a fixed size; each of FILTER_PARTS tasks sends one that
    the driver joins up. Once it is full it lets everything pass."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = Bloom(FILTER_POWER)
        for batch in rows:
            part.add(batch.column(0).to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([binaries([np.packbits(part.bits).tobytes()])], ["bits"])

    whole = Bloom(FILTER_POWER)
    for row in ids.repartition(FILTER_PARTS).mapInArrow(batches, "bits binary").collect():
        whole.bits |= np.unpackbits(np.frombuffer(row.bits, np.uint8)).astype(bool)
    return whole


def shingle_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node and shingles (the packed sorted set) of the given nodes. Only texts that the filter of
    their ids lets pass are shuffled; that they always are, however few nodes there are, keeps
    the two functions apart, so that a task needs one worker."""
    wanted = docs.sparkSession.sparkContext.broadcast(np.packbits(id_filter(nodes).bits))

    def passing(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(FILTER_POWER, np.unpackbits(wanted.value).astype(bool))
        for batch in rows:
            yield batch.filter(pa.array(bloom.has(batch.column("doc_id").to_numpy().view(np.uint64))))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"),
                     binaries([shingle_set(t, words).tobytes() for t in
                               part.column("text").to_pylist()])],
                    ["node", "shingles"],
                )

    passed = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text"
    ).mapInArrow(passing, "doc_id bigint, text string")
    return (
        passed.join(nodes.hint("merge"), passed["doc_id"] == nodes["node"], "left_semi")
        .mapInArrow(batches, "node bigint, shingles binary")
        .where(F.length("shingles") > 0)
    )


def probe_long_lists(rows: DataFrame, cells: DataFrame, sets: DataFrame, links: DataFrame,
                     percent: int) -> DataFrame:
    """All links so far and those that probing the long lists (shingle, node) adds.

    A round lets some nodes of each list, none of them in its largest component, probe the cells of
    all its other nodes, and takes them off the list. A list is done when its nodes are in one
    component, or all that are not in the largest have probed it.
    """
    probes = FIRST_PROBES
    while True:
        labels = components(links)
        labelled = rows.join(labels, "node", "left").withColumn(
            "component", F.coalesce("component", "node")
        )
        by_component = labelled.groupBy("shingle", "component").agg(F.count("*").alias("size"))
        largest = by_component.groupBy("shingle").agg(
            F.max(F.struct("size", "component")).alias("most"), F.count("*").alias("parts")
        ).where("parts > 1").select("shingle", F.col("most.component").alias("largest"))
        open_rows = written(labelled.join(largest, "shingle"), "long-lists")
        if open_rows.isEmpty():
            return links
        others = open_rows.where("component != largest")
        turn = Window.partitionBy("shingle").orderBy(F.xxhash64("node"), "node")
        hubs = written(
            others.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= probes)
            .select("shingle", "node", "component"),
            "probing",
        )
        placed = written(open_rows.select("shingle", "node", "component").join(cells, "node"), "placed")
        held = placed.groupBy("shingle", "cell").agg(
            F.min("component").alias("low"), F.max("component").alias("high"))
        asking = (
            hubs.join(held, "shingle").where("low != component or high != component")
            .select("node", "cell").distinct()
        )
        found = linked(written(asking, "asking"), placed.select("node", "cell").distinct(), labels,
                       sets, percent)
        links = written(links.unionByName(found), "links")
        rows = written(
            open_rows.select("shingle", "node").join(
                hubs.select("shingle", "node"), ["shingle", "node"], "left_anti"
            ),
            "long-lists",
        )
        probes *= 3


def candidate_blocks(pairs: DataFrame, long_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n, block and shingles (of the whole block): what candidate pairs and long lists hold
    together. No link leaves a block."""
    first = long_rows.groupBy("shingle").agg(F.min("node").alias("x"))
    held = long_rows.join(first, "shingle").select("x", F.col("node").alias("y")).where("x != y")
    together = components(pairs.unionByName(held.distinct()))
    whole = together.withColumnRenamed("component", "block").join(nodes.select("node", "n"), "node")
    sizes = whole.groupBy("block").agg(F.sum("n").alias("shingles"))
    return written(whole.join(sizes, "block").select("node", "n", "block", "shingles"), "blocks")


def larger_linked(docs: DataFrame, larger: DataFrame, pairs: DataFrame, long_rows: DataFrame,
                  words: int, percent: int) -> DataFrame:
    """The links of blocks that are too large for one task: candidates meet in cells."""
    sets = written(shingle_sets(docs, larger.select("node"), words), "sets")
    cells = written(celled(larger, long_rows), "cells")
    ids = larger.select(F.col("node").alias("x"))
    pairs = written(pairs.join(ids, "x", "left_semi"), "pairs")
    # A pair for each node first; most others are then in one component and need no search.
    lead = (
        pairs.groupBy("x").agg(F.min("y").alias("y"))
        .unionByName(pairs.groupBy("y").agg(F.min("x").alias("x")).select("x", "y")).distinct()
    )
    none = ids.select(F.col("x").alias("node"), F.col("x").alias("component")).limit(0)
    links = written(pairs_linked(written(lead, "lead"), cells, none, sets, percent), "links")
    known = written(components(links), "labels")
    kx, ky = (known.select(F.col("node").alias(s), F.col("component").alias(f"c{s}"))
              for s in ("x", "y"))
    rest = (
        pairs.join(lead, ["x", "y"], "left_anti").join(kx, "x", "left").join(ky, "y", "left")
        .where("cx is null or cy is null or cx != cy").select("x", "y")
    )
    more = pairs_linked(written(rest, "pairs"), cells, known, sets, percent)
    links = written(links.unionByName(more), "links")
    long_rows = long_rows.join(larger, "node", "left_semi").select("shingle", "node")
    return probe_long_lists(long_rows, cells, sets, links, percent)


def joined(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Documents link whose sets of ``words``-word shingles have a Jaccard similarity of ``percent``
    hundredths or more; component_id is the smallest doc_id that links reach, itself included. Null
    and empty texts, and texts without words, have no shingles and link with nothing, not even
    each other. Rows with equal sets are one node, so copies cost nothing further. Rows that
    share a doc_id but not the text are nodes by their sets. A row with a null doc_id takes no part
    and gets a null component. Shingles are compared by 64-bit hashes.
    """
    frequent = frequent_shingles(docs, words, FREQUENT)
    signed = written(prefixes(docs, words, percent, frequent), "signatures")
    signed_nodes = signed.where("n > 0 and doc_id is not null")
    node = [F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("rare").alias("rare")]
    nodes = written(signed_nodes.groupBy("digest").agg(*node), "nodes")

    held = written(
        repeated_only(signed_nodes).groupBy("digest")
        .agg(*node, F.first("shingles").alias("shingles"), F.first("places").alias("places")),
        "prefixes",
    )
    lists = written(
        postings(held).where("rare").repartition("shingle").groupBy("shingle")
        .agg(F.sort_array(F.collect_list(F.struct("node", "pos", "n", "last"))).alias("nodes"))
        .where("size(nodes) > 1"),
        "lists",
    )
    short = lists.where(F.size("nodes") <= SHORT_LIST)
    long_rare = lists.where(F.size("nodes") > SHORT_LIST).select(
        "shingle", F.explode("nodes.node").alias("node")
    )
    pairs = written(candidate_pairs(short, percent), "pairs")
    long_rows = written(
        long_rare.unionByName(
            postings(held).where("not rare").select("shingle", "node")
        ),
        "long-lists",
    )
    sized = candidate_blocks(pairs, long_rows, nodes)
    bounded = sized.where(F.col("shingles") <= BLOCK_SHINGLES).select("node", "block")
    links = written(
        blocks_linked(
            shingle_sets(docs, bounded.select("node"), words).join(bounded, "node"), percent
        ),
        "links",
    )
    larger = written(
        sized.where(F.col("shingles") > BLOCK_SHINGLES).select("node", "block", "n"), "larger")
    if not larger.isEmpty():
        more = larger_linked(docs, larger, pairs, long_rows, words, percent)
        links = written(links.unionByName(more), "links")
    labels = components(links)
    of_digest = nodes.join(labels, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("component_id")
    )
    return (
        signed.join(of_digest, "digest", "left")
        .select("doc_id", F.col("n").alias("n_shingles"),
                F.when(F.col("n") == 0, F.col("doc_id"))
                .when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    )
