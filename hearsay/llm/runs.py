"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q that no neighbouring word extends. Those of at
least 4 q words are found from dyadic blocks: at level k blocks of 2**k words begin at every
2**(k-1)-th word and look for periods from 2**(k-1) + 1 to 2**k (level 1: for 1 and 2). A run of
such a period wholly holds a block with its next occurrence, and as the block is at least a period
long, that occurrence is one period further on.

1. A suffix array is made by prefix doubling. The suffixes that share their first 2**k words are
   one interval of it, so every block of level k knows the interval of its occurrences.
2. A wavelet tree over the suffix array answers range successor queries: the first occurrence after
   the block. Only one in the neighbouring window, at most 2**k words further, says something:
   its distance is the period of block and occurrence together.
3. The pieces that overlap by a period are one progression. What is long enough is extended
   word by word to both sides, which ends after less than half a block.

A batch of documents is one text here; a word of another document is another word. All steps
are array operations over a batch, except for the last one, which only sees runs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.frames import slices

#: A run has at least this many periods, and words.
EXPONENT = 4
LEAST_WORDS = 6
#: Words that are searched together, but for a longer document, which is searched alone.
BATCH_WORDS = 100_000

RUN = "struct<start:bigint,length:bigint,period:bigint>"


def split_words(text: str | None) -> list[bytes]:
    """Words end at ASCII white space only."""
    return (text or "").encode().split()


class Suffixes:
    """Suffixes of a text of several documents, sorted by their first words.

    ``array`` has the positions in order. ``interval`` gives where the suffixes stand that share
    their first 2**k words with the one at a position, at the level reached.
    """

    def __init__(self, letters: np.ndarray, ends: np.ndarray):
        self.ends = ends
        self.array = np.argsort(letters, kind="stable")
        self.width = 1
        self.rank = np.zeros(len(letters), np.int64)
        self.size = np.ones(len(letters), np.int64)
        self._classes(np.arange(len(letters)), letters[self.array])

    def _classes(self, slots: np.ndarray, keys: np.ndarray) -> None:
        """Equal neighbouring keys are one class, named by its first slot."""
        if not len(slots):
            return
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(new, len(keys)))
        at = self.array[slots]
        self.rank[at] = np.repeat(slots[new], sizes)
        self.size[at] = np.repeat(sizes, sizes)

    def double(self) -> None:
        """Sort by twice as many words. Suffixes that are alone are in their place already."""
        slots = np.flatnonzero(self.size[self.array] > 1)
        at = self.array[slots]
        further = at + self.width
        inside = further < self.ends[at]
        second = np.where(inside, self.rank[np.where(inside, further, 0)] + 1, 0)
        keys = self.rank[at] * (len(self.array) + 1) + second
        order = np.argsort(keys, kind="stable")
        self.array[slots] = at[order]
        self.width *= 2
        self._classes(slots, keys[order])

    def interval(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.rank[at], self.rank[at] + self.size[at]


class WaveletTree:
    """Numbers from 0 to n - 1, bit by bit from the highest, the zeros of a bit before its ones."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32))
            values = np.concatenate([values[~one], values[one]])

    def _down(self, zeros: np.ndarray, left: np.ndarray, right: np.ndarray):
        """Both bounds among the zeros, and among the ones."""
        left0, right0 = zeros[left], zeros[right]
        return left0, right0, zeros[-1] + left - left0, zeros[-1] + right - right0

    def less(self, left: np.ndarray, right: np.ndarray, than: np.ndarray) -> np.ndarray:
        """How many numbers in each range are smaller."""
        count = np.zeros(len(left), np.int64)
        for level, zeros in enumerate(self.zeros):
            left0, right0, left1, right1 = self._down(zeros, left, right)
            one = (than >> (self.bits - 1 - level)) & 1 == 1
            count += np.where(one, right0 - left0, 0)
            left, right = np.where(one, left1, left0), np.where(one, right1, right0)
        return count

    def smallest(self, left: np.ndarray, right: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The number that ``nth`` others of each range are smaller than."""
        value = np.zeros(len(left), np.int64)
        for zeros in self.zeros:
            left0, right0, left1, right1 = self._down(zeros, left, right)
            one = nth >= right0 - left0
            nth = np.where(one, nth - (right0 - left0), nth)
            value = 2 * value + one
            left, right = np.where(one, left1, left0), np.where(one, right1, right0)
        return value

    def successor(self, left: np.ndarray, right: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The smallest number of each range that is larger than ``after``, which is in the range;
        -1 if there is none."""
        rank = self.less(left, right, after) + 1
        found = np.flatnonzero(rank < right - left)
        out = np.full(len(left), -1, np.int64)
        out[found] = self.smallest(left[found], right[found], rank[found])
        return out


def next_occurrences(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """level, at and after: blocks and their next occurrence, if it is in the neighbouring window.

    ``starts`` and ``ends`` are those of the document of each position.
    """
    suffixes = Suffixes(letters, ends)
    longest = int((ends - starts).max(initial=0))
    asked = []
    repeated = None
    level = 1
    # A run of EXPONENT periods has a period above 2**(level - 1), and the period is in it as often.
    while EXPONENT * (2 ** (level - 1) + 1 if level > 1 else 1) <= longest:
        suffixes.double()
        if repeated is None:
            repeated = suffixes.size > 1
        step = 2 ** (level - 1)
        at = np.flatnonzero(suffixes.size > 1)
        if not len(at):
            break
        at = at[((at - starts[at]) % step == 0) & (at + 2 ** level < ends[at])]
        left, right = suffixes.interval(at)
        asked.append((np.full(len(at), level), at, left, right))
        level += 1
    if not asked:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    # The tree only needs the suffixes that share their first words with another one.
    slots = np.concatenate([[0], np.cumsum(repeated[suffixes.array])])
    numbers = np.cumsum(repeated) - 1
    tree = WaveletTree(numbers[suffixes.array[repeated[suffixes.array]]])
    positions = np.flatnonzero(repeated)
    levels, at, left, right = (np.concatenate(x) for x in zip(*asked))
    found = tree.successor(slots[left], slots[right], numbers[at])
    after = positions[found]
    distance = after - at
    near = (found >= 0) & (distance <= 2 ** levels) & ((levels == 1) | (distance > 2 ** (levels - 1)))
    return levels[near], at[near], after[near]


def equal_length(one: np.ndarray, other: np.ndarray) -> int:
    """How many first elements are equal; looks at ever longer stretches."""
    done, size = 0, 64
    n = min(len(one), len(other))
    while done < n:
        differ = one[done:done + size] != other[done:done + size][:n - done]
        if differ.any():
            return done + int(differ.argmax())
        done, size = min(n, done + size), 2 * size
    return n


def batch_runs(letters: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int, int]]:
    """document, start, length and period of all runs, sorted. Words of different documents have
    different letters, from 0 to less than the number of words."""
    last = np.cumsum(lengths)
    starts, ends = np.repeat(last - lengths, lengths), np.repeat(last, lengths)
    levels, at, after = next_occurrences(letters, starts, ends)
    if not len(at):
        return []
    period = after - at
    order = np.lexsort((at, period))
    levels, period, begin = levels[order], period[order], at[order]
    end = begin + 2 ** levels + period
    # Pieces of one period that overlap by a period belong together.
    far = np.int64(len(letters) + 1)
    reach = np.maximum.accumulate(end + period * far) - period * far
    new = np.concatenate([[True], (period[1:] != period[:-1]) | (begin[1:] > (reach - period)[:-1])])
    first = np.flatnonzero(new)
    period, begin, levels = period[first], begin[first], levels[first]
    end = reach[np.append(first[1:], len(reach)) - 1]
    # A run is less than half a block longer than its piece, at each end.
    least = np.maximum(LEAST_WORDS, EXPONENT * period)
    able = end - begin + 2 * (2 ** (levels - 1) - 1) >= least
    found = set()
    for b, e, q in zip(begin[able].tolist(), end[able].tolist(), period[able].tolist()):
        low, high = int(starts[b]), int(ends[b])
        e += equal_length(letters[e:high], letters[e - q:high - q])
        b -= equal_length(letters[low:b][::-1], letters[low + q:b + q][::-1])
        if e - b >= max(LEAST_WORDS, EXPONENT * q):
            doc = int(np.searchsorted(last, b, "right"))
            found.add((doc, b - low, e - b, q))
    return sorted(found, key=lambda r: (r[0], r[1], r[3]))


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each list of words, by start and period."""
    letters, base = [], 0
    for words in texts:
        known: dict[bytes, int] = {}
        letters += [known.setdefault(word, base + len(known)) for word in words]
        base += len(known)
    out = [[] for _ in texts]
    lengths = np.array([len(words) for words in texts], np.int64)
    for doc, start, length, period in batch_runs(np.array(letters, np.int64), lengths):
        out[doc].append((start, length, period))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """All columns, ``runs`` (start and length in words, period; by start and period) and
    ``collapsed``: the text's words, joined by a space, without those that a run holds after its
    first period.

    Runs have at least four periods and six words. A null, empty or blank text has no runs and
    collapses to an empty text. Each row is searched by itself, so nulls and repeats elsewhere
    change nothing. Columns called runs or collapsed are replaced; others stay.
    """
    kept = docs.drop("runs", "collapsed")
    schema = (
        kept.withColumn("runs", F.lit(None).cast(f"array<{RUN}>"))
        .withColumn("collapsed", F.lit(None).cast("string")).schema
    )
    at = kept.columns.index("text")

    def searched(part: pa.RecordBatch, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = runs_of(texts)
        lists = pa.array(
            [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in runs],
            pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()),
                                ("period", pa.int64())])),
        )
        collapsed = pa.array([collapse(w, r).decode() for w, r in zip(texts, runs)], pa.string())
        return pa.RecordBatch.from_arrays([*part.columns, lists, collapsed], schema.names)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in slices(batch):
                first, texts, size = 0, [], 0
                for i, value in enumerate(part.column(at)):
                    words = split_words(value.as_py())
                    if texts and size + len(words) > BATCH_WORDS:
                        yield searched(part.slice(first, i - first), texts)
                        first, texts, size = i, [], 0
                    texts.append(words)
                    size += len(words)
                if texts:
                    yield searched(part.slice(first), texts)

    return kept.mapInArrow(batches, schema)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text: some documents are made periodic from some word on.

    With h = crc32 of the decimal doc_id and g = h // 10, a document of n words and h % 10 = 0 has as
    its word i, from a = g % n on, the word a + (i - a) % p, where p = 1 + (n - a) // (3 + g % 8).
    Rows without a doc_id stay as they are.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                for at, doc in enumerate(part.column("doc_id").to_pylist()):
                    g, rest = divmod(zlib.crc32(str(doc).encode()), 10)
                    if doc is None or rest:
                        continue
                    words = split_words(texts[at])
                    if not words:
                        continue
                    a = g % len(words)
                    p = 1 + (len(words) - a) // (3 + g % 8)
                    repeated = words[:a] + [words[a + i % p] for i in range(len(words) - a)]
                    texts[at] = b" ".join(repeated).decode()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"]
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        batches, "doc_id bigint, text string"
    )


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the longest run (ties: smallest
    start, then period), and the digests of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(
        ",", r["start"], r["length"], r["period"]))
    found = periodic_runs(docs.select("doc_id", "text")).withColumn("longest", longest)
    start, length, period = -F.col("longest.start"), F.col("longest.length"), -F.col("longest.period")
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), start.alias("start"),
        length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256)
        .alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
