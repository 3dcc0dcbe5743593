"""Line dedup with two Bloom filters.

1. Every document gives the 64-bit hashes of its line keys, joined up per batch of documents.
   The hashes (not the lines) go to blocks of the hash space. Each block runs its hashes through
   a filter of hashes seen once; what is there already enters the filter of hashes seen twice.
   A hash that two documents of a batch share enters both at once.
2. The twice-seen filters, folded to ``filter_bytes`` in all, are broadcast. Only lines that
   they suspect are shuffled, and the text of their keys decides: which keys are in two
   documents, and which is the smallest document.
3. Documents meet the keys they lose and drop them.

A filter has no false negatives, so no repeat is missed; a false positive costs the shuffle of a
line. If the filters of a larger corpus have to be folded until they are full, more lines are
shuffled and the result stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.frames import mixed, slices, unused, worker_cache, written

SPACE = b" \t\n\x0b\x0c\r"
#: Hashes of a block, bits for each of them, and bits that a hash sets.
BLOCK_HASHES = 1_000_000
BITS_PER_HASH = 16
PROBES = 3
#: Bytes of all twice-seen filters together: the most that is broadcast.
FILTER_BYTES = 32 << 20


class Bloom:
    """A Bloom filter of 2**power bits over 64-bit hashes."""

    def __init__(self, power: int, bits: np.ndarray | None = None):
        self.power = power
        self.bits = np.zeros(1 << power, bool) if bits is None else bits

    @classmethod
    def sized(cls, hashes: float) -> Bloom:
        return cls(max(9, int(np.ceil(np.log2(max(1.0, hashes * BITS_PER_HASH))))))

    def places(self, hashes: np.ndarray) -> list[np.ndarray]:
        first = mixed(hashes)
        step = mixed(hashes ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        mask = np.uint64((1 << self.power) - 1)
        return [(first + np.uint64(i) * step) & mask for i in range(PROBES)]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for place in self.places(hashes):
            found &= self.bits[place]
        return found

    def add(self, hashes: np.ndarray) -> None:
        for place in self.places(hashes):
            self.bits[place] = True

    def folded(self, most_bits: int) -> Bloom:
        """Half the size again and again: down to ``most_bits``, and on while few bits are set."""
        power, bits = self.power, self.bits
        while power > 9 and (1 << power > most_bits or bits.mean() < 0.05):
            power -= 1
            bits = bits[: 1 << power] | bits[1 << power:]
        return Bloom(power, bits)


def line_keys(text: str | None) -> list[bytes]:
    """The key of each line: ASCII white space stripped, A-Z lower-cased."""
    return [line.strip(SPACE).lower() for line in (text or "").encode().split(b"\n")]


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def _distinct_keys(text: str | None, least: int) -> set[bytes]:
    return {key for key in line_keys(text) if long_enough(key, least)}


def key_hashes(docs: DataFrame, least: int) -> DataFrame:
    """hash and ``twice`` (two rows of a batch hold it), one row per batch and hash."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("linededup")  # what another operator holds goes
        digest = xxhash.xxh64_intdigest
        for batch in rows:
            found = [digest(key) for part in slices(batch)
                     for text in part.column("text").to_pylist()
                     for key in _distinct_keys(text, least)]
            hashes, counts = np.unique(np.array(found, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array(counts > 1)], ["hash", "twice"]
            )

    return docs.select("text").mapInArrow(batches, "hash bigint, twice boolean")


def twice_filters(hashes: DataFrame, total: int, filter_bytes: int) -> tuple[int, DataFrame]:
    """The number of blocks, and the twice-seen filter of each: block, power, bits."""
    blocks = max(1, -(-total // BLOCK_HASHES))
    expected = total / blocks * 1.1
    most_bits = filter_bytes * 8 // blocks

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[int, tuple[Bloom, Bloom]] = {}
        for batch in rows:
            at = batch.column("block").to_numpy()
            hashes = batch.column("hash").to_numpy().view(np.uint64)
            twice = batch.column("twice").to_numpy(zero_copy_only=False)
            for block in np.unique(at).tolist():
                if block not in filters:
                    filters[block] = Bloom.sized(expected), Bloom.sized(expected)
                once_seen, twice_seen = filters[block]
                own, inverse, counts = np.unique(
                    hashes[at == block], return_inverse=True, return_counts=True
                )
                repeated = (counts > 1) | once_seen.has(own)
                repeated[inverse[twice[at == block]]] = True
                twice_seen.add(own[repeated])
                once_seen.add(own)
        for block, (_, twice_seen) in filters.items():
            small = twice_seen.folded(most_bits)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([small.power], pa.int32()),
                 pa.array([np.packbits(small.bits).tobytes()], pa.binary())],
                ["block", "power", "bits"],
            )

    dealt = hashes.withColumn("block", F.pmod("hash", F.lit(blocks))).repartition(blocks, "block")
    return blocks, dealt.mapInArrow(batches, "block bigint, power int, bits binary")


def suspected_lines(docs: DataFrame, blocks: int, filters: DataFrame, least: int) -> DataFrame:
    """doc_id and key of every line that the twice-seen filters suspect, once per document.
    What comes to the driver and is broadcast is at most the size the filters were folded to."""
    carried = docs.sparkSession.sparkContext.broadcast(
        {row.block: (row.power, bytes(row.bits)) for row in filters.collect()}
    )

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice_seen = {
            block: Bloom(power, np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool))
            for block, (power, bits) in carried.value.items()
        }
        digest = xxhash.xxh64_intdigest
        for batch in rows:
            for part in slices(batch):
                ids, keys = [], []
                for doc, text in zip(part.column("doc_id").to_pylist(),
                                     part.column("text").to_pylist()):
                    own = _distinct_keys(text, least)
                    ids += [doc] * len(own)
                    keys += own
                hashes = np.array([digest(key) for key in keys], np.uint64)
                at = hashes.view(np.int64) % blocks
                held = np.zeros(len(keys), bool)
                for block in np.unique(at).tolist():
                    if block in twice_seen:
                        held[at == block] = twice_seen[block].has(hashes[at == block])
                chosen = np.flatnonzero(held).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in chosen], pa.int64()),
                     pa.array([keys[i].decode() for i in chosen], pa.string())],
                    ["doc_id", "key"],
                )

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(
        batches, "doc_id bigint, key string"
    )


def dropped_keys(docs: DataFrame, least: int, filter_bytes: int) -> DataFrame:
    """doc_id and the keys whose lines it loses (array)."""
    hashes = written(key_hashes(docs, least), "line-hashes")
    blocks, filters = twice_filters(hashes, hashes.count(), filter_bytes)
    suspects = written(suspected_lines(docs, blocks, filters, least), "line-suspects")
    # Written, so that both sides of the join are dealt anew and a hot key can be split.
    repeated = written(
        suspects.groupBy("key")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("first < last")
        .select("key", "first"),
        "repeated-lines",
    )
    return (
        suspects.join(repeated, "key")
        .where("doc_id > first")
        .groupBy("doc_id")
        .agg(F.collect_set("key").alias("lost"))
    )


def dedup_lines(
    docs: DataFrame, least: int = 10, filter_bytes: int = FILTER_BYTES
) -> DataFrame:
    """All rows, without the lines whose key a smaller doc_id holds too.

    A key of at least ``least`` code points that is in two documents stays only in the smallest
    doc_id, there on all its lines. ``text`` is what is left, joined by line feeds; ``n_lines``
    (before) and ``n_dropped`` are added and replace columns of those names; other columns stay
    as they are. A null or empty text is one empty line and comes back empty. Rows that
    share a doc_id count as one document. Rows with a null doc_id take no part and keep their
    lines.
    """
    kept = docs.drop("n_lines", "n_dropped")
    gone_keys = unused(docs, "lost")
    lost = dropped_keys(docs, least, filter_bytes).withColumnRenamed("lost", gone_keys)
    schema = (
        kept.withColumn("n_lines", F.lit(0).cast("bigint"))
        .withColumn("n_dropped", F.lit(0).cast("bigint"))
        .schema
    )
    at = kept.columns.index("text")

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in slices(batch):
                texts, lines, drops = [], [], []
                for text, gone in zip(part.column("text").to_pylist(),
                                      part.column(gone_keys).to_pylist()):
                    every = (text or "").split("\n")
                    if gone:
                        gone = {key.encode() for key in gone}
                        stay = [line for line, key in zip(every, line_keys(text))
                                if key not in gone]
                    else:
                        stay = every
                    texts.append("\n".join(stay))
                    lines.append(len(every))
                    drops.append(len(every) - len(stay))
                columns = part.columns[:-1]
                columns[at] = pa.array(texts, pa.string())
                columns += [pa.array(lines, pa.int64()), pa.array(drops, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return kept.join(lost, "doc_id", "left").select(*kept.columns, gone_keys).mapInArrow(
        batches, schema
    )


def digests(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every row."""
    deduped = dedup_lines(docs.select("doc_id", "text"), least)
    return deduped.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256")
    )


SQL = """
with lines as (
  select doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents)
), repeated as (
  select key, min(doc_id) as first from lines where length(key) >= 10
  group by key having count(distinct doc_id) > 1
)
select doc_id, count(*)::bigint as n_lines,
  sum((first is not null and doc_id > first)::bigint)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (first is null or doc_id <= first), ''))
    as kept_sha256
from lines left join repeated using (key) group by doc_id
"""
