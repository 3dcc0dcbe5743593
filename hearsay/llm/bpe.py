"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a doubly linked list of byte sequences. Every adjacent pair whose bytes form
a vocabulary entry waits in the bucket of that entry's rank, under the position of its left
part. A two-level bitmap over the ranks says which buckets hold something; finding the
lowest rank takes two find-first-set steps, however long the pre-token is. Merging touches
two neighbours; their old entries stay behind and are skipped when they come up. A pre-token
of n bytes therefore takes O(n log n) steps at worst, where rescanning for the lowest pair
takes O(n^2).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.frames import slices, worker_cache

#: Pre-tokens in each of the two generations of a worker's memo, and the longest one kept.
MEMO_ENTRIES = 300_000
MEMO_CHARS = 48
#: Ranks of a word of the bitmap, as a power of two.
BITS = 8
WORD = 1 << BITS


class Codec:
    """Encodes and decodes with the ranks of a vocabulary; one per worker.

    ``ranks`` maps byte strings to ids and must hold all single bytes.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.low = [0] * ((max(ranks.values()) >> BITS) + 1)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token.

        ``low[i]`` has a bit for each of WORD ranks whose bucket holds something and ``top`` a bit
        for each word of ``low`` that is not zero. A bucket is one position, or a heap of them.
        The queue is written out here, as calls would cost more than its steps.
        """
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        rank_of = ranks.get
        low, buckets, top = self.low, {}, 0
        size = len(piece)
        end = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        waiting = [rank_of(piece[at:at + 2], -1) for at in range(size)]
        waiting[-1] = -1  # the last has no pair
        fresh = list(enumerate(waiting))
        while True:
            for at, rank in fresh:
                if rank < 0:
                    continue
                bucket = buckets.get(rank)
                if bucket is None:
                    buckets[rank] = at
                    word = rank >> BITS
                    if not low[word]:
                        top |= 1 << word
                    low[word] |= 1 << (rank & WORD - 1)
                elif bucket.__class__ is int:
                    buckets[rank] = [bucket, at] if bucket < at else [at, bucket]
                else:
                    heappush(bucket, at)
            # the lowest rank that is not stale, at its leftmost position
            while top:
                lowest = top & -top
                word = lowest.bit_length() - 1
                here = low[word]
                first = here & -here
                rank = (word << BITS) + first.bit_length() - 1
                bucket = buckets[rank]
                if bucket.__class__ is int:
                    at = bucket
                elif len(bucket) > 1:
                    at = heappop(bucket)
                    if waiting[at] == rank:
                        break
                    continue
                else:
                    at = bucket[0]
                del buckets[rank]
                low[word] = here ^ first
                if here == first:
                    top ^= lowest
                if waiting[at] == rank:
                    break
            else:
                break
            gone = end[at]
            stop = end[at] = end[gone]
            waiting[gone] = -1
            left = before[at]
            if stop < size:
                before[stop] = at
                right = waiting[at] = rank_of(piece[at:end[stop]], -1)
            else:
                right = waiting[at] = -1
            if left >= 0:
                rank = waiting[left] = rank_of(piece[left:stop], -1)
                fresh = ((at, right), (left, rank))
            else:
                fresh = ((at, right),)
        ids, at = [], 0
        while at < size:
            ids.append(ranks[piece[at:end[at]]])
            at = end[at]
        return ids

    def packed(self, piece: str) -> bytes:
        """Ids of a pre-token as little-endian 32-bit integers. What has not come up since the
        memo last filled is forgotten."""
        found = self.older.get(piece)
        if found is None:
            found = np.array(self.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_ENTRIES:
                self.older = self.memo.copy()
                self.memo.clear()
            self.memo[piece] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        get, packed = self.memo.get, self.packed
        return np.frombuffer(
            b"".join([get(piece) or packed(piece) for piece in self.split(text)]), "<u4"
        )

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """A rank file: base64 of a token and its rank on each line."""
    return {
        base64.b64decode(token): int(rank)
        for token, rank in (line.split() for line in content.splitlines() if line.strip())
    }


def codec_of(content: bytes, pattern: str) -> Codec:
    """The worker's codec for a rank file; built once."""
    key = hashlib.sha256(content + pattern.encode()).hexdigest()
    cache = worker_cache("bpe")
    if key not in cache:
        cache[key] = Codec(parse_ranks(content), pattern)
    return cache[key]


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """All rows with ``ids`` (array of int), replacing a column of that name.

    Each match of ``pattern`` is encoded separately, without special tokens; what the pattern
    does not match is left out. Null and empty texts give no ids. Texts are encoded whole,
    repeated rows each for themselves. The rank file (of fixed size) is read by the driver
    and broadcast.
    """
    content = _broadcast(docs, rank_file)
    kept = docs.drop("ids")
    schema = kept.withColumn("ids", F.array().cast("array<int>")).schema

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(content.value, pattern)
        for batch in rows:
            for part in slices(batch):
                found = [codec.encode(x or "") for x in part.column(text).to_pylist()]
                ends = np.cumsum([0, *map(len, found)])
                ids = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()),
                    pa.array(np.concatenate([np.zeros(0, "<u4"), *found]).astype(np.int32)),
                )
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*part.schema.names, "ids"])

    return kept.mapInArrow(batches, schema)


def decode(docs: DataFrame, rank_file: str, pattern: str, ids: str = "ids") -> DataFrame:
    """All rows with ``decoded`` (binary: the bytes of the ids; null ids give none), replacing
    a column of that name."""
    content = _broadcast(docs, rank_file)
    kept = docs.drop("decoded")
    schema = kept.withColumn("decoded", F.lit(b"")).schema

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(content.value, pattern)
        for batch in rows:
            for part in slices(batch):
                column = part.column(ids)
                found = [
                    b"" if not x.is_valid else codec.decode(x.values.to_numpy(zero_copy_only=False))
                    for x in column
                ]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(found, pa.binary())], [*part.schema.names, "decoded"]
                )

    return kept.mapInArrow(batches, schema)


def _broadcast(df: DataFrame, rank_file: str):
    with open(rank_file, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: ``encode``, then
    ``decode`` of its ids."""
    both = decode(encode(docs.select("doc_id", "text"), rank_file, pattern)
                  .select("doc_id", "ids"), rank_file, pattern)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids = [x.values.to_numpy(zero_copy_only=False) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in batch.column("decoded")]),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return both.mapInArrow(
        batches, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
