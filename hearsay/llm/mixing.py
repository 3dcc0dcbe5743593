"""Mixing sources to target weights by subset-sum budget fitting.

1. One pass counts words per document. Targets share a budget between the sources by weight;
   none exceeds ``most_copies`` times its source, and what is over is shared again.
2. A target is so many whole copies of its source and a rest. For the rest, documents are counted
   by exact length, and per source a plan says how many documents of each length to take: all
   lengths in proportion first, down to a remaining budget that is small, then a bounded knapsack
   over the lengths left, which finds the reachable sum next to that budget.
3. Of each length the plan's number of documents is selected in a seeded order. The order's hash
   is cut into buckets: buckets below the cut are taken whole, and only the bucket that holds the
   cut is sorted, so that a source or length with a third of all rows is never one sort.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.llm.frames import seeded, written

#: Words that the knapsack fits at most; beyond it lengths are taken in proportion.
KNAPSACK_WORDS = 200_000
#: Buckets of the seeded order within a source and length.
BUCKETS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str = "text") -> Column:
    """The number of words; null texts have none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float,
            most_copies: int) -> DataFrame:
    """source, source_size and target, from source and source_size (one row per source).

    Weights go round the sources by code point, null last. Handing what is over a ceiling on to
    the others, again and again, ends where every source has the smaller of its ceiling and
    weight times one common level. Sources reach their ceilings in the order of ceiling by weight,
    so running sums along that order give the level. Sources of size 0 get 0. These windows
    see one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ratio = Window.orderBy("full_at", "place")
    everything = Window.partitionBy()
    size = F.col("source_size").cast("double")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))),
                          (F.col("place") % len(weights) + 1).cast("int"))
    below = ratio.rowsBetween(Window.unboundedPreceding, -1)
    above = ratio.rowsBetween(0, Window.unboundedFollowing)
    ceiling = size * most_copies
    ranked = (
        sources.withColumn("place", F.row_number().over(order) - 1)
        .withColumn("weight", weight)
        .withColumn("ceiling", ceiling)
        .withColumn("full_at", F.col("ceiling") / F.col("weight"))
        .withColumn("budget", F.sum(size).over(everything) * share)
        # the level if this source and those after it stay below their ceilings
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("ceiling").over(below), F.lit(0.0)))
                    / F.sum("weight").over(above))
        .withColumn("first_free", F.min(F.when(F.col("level") <= F.col("full_at"),
                                               F.struct("full_at", "place", "level"))).over(everything))
    )
    target = F.when(F.col("first_free").isNull(), F.col("ceiling")).otherwise(
        F.least(F.col("ceiling"), F.col("weight") * F.col("first_free.level"))
    )
    return ranked.select("source", "source_size", target.alias("target"))


def fitted(lengths: np.ndarray, counts: np.ndarray, budget: float,
           knapsack_words: int = KNAPSACK_WORDS) -> np.ndarray:
    """How many documents of each length to take, so that their words come next to the budget.

    Lengths are taken in proportion to their counts, short of the budget by up to
    ``knapsack_words``; bounded knapsack over what is left then finds the reachable sum nearest
    to the remaining budget (the lower of two equally near). For each length in turn, the table
    holds the fewest documents of that length with which each sum is reached.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = float((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    share = max(0.0, (budget - knapsack_words / 2) / total)
    taken = np.floor(counts * share).astype(np.int64)
    rest = budget - float((lengths * taken).sum())
    if rest > knapsack_words:  # many rare lengths: floors fell far short
        for i in np.argsort(-lengths, kind="stable"):
            more = min(int(counts[i] - taken[i]), int((rest - knapsack_words / 2) // lengths[i]))
            if more > 0:
                taken[i] += more
                rest -= more * int(lengths[i])
            if rest <= knapsack_words:
                break
    left = counts - taken
    goal = int(round(rest))
    # a sum above the goal may be nearer than any below it
    width = 2 * goal + 1
    usable = [i for i in np.argsort(-lengths, kind="stable")
              if left[i] > 0 and 0 < lengths[i] < width]
    reached = np.zeros(width, bool)
    reached[0] = True
    steps: list[tuple[int, np.ndarray]] = []
    for i in usable:
        length, most = int(lengths[i]), int(min(left[i], (width - 1) // lengths[i]))
        rows = -(-width // length)
        grid = np.zeros(rows * length, bool)
        grid[:width] = reached
        grid = grid.reshape(rows, length)
        # steps since the last sum that was reached without this length
        row = np.arange(rows)[:, None]
        since = row - np.maximum.accumulate(np.where(grid, row, -rows - most - 1), axis=0)
        used = np.where(since <= most, since, -1).reshape(-1)[:width]
        fresh = (used > 0) & ~reached
        at = np.flatnonzero(fresh)
        steps.append((i, np.stack([at, used[at]])))
        reached = reached | fresh
        if reached[goal]:
            break
    sums = np.flatnonzero(reached)
    best = int(sums[np.argmin(np.abs(sums - rest))]) if len(sums) else 0
    for i, (at, used) in reversed(steps):
        place = np.searchsorted(at, best)
        if place < len(at) and at[place] == best:
            taken[i] += int(used[place])
            best -= int(used[place]) * int(lengths[i])
    return taken


def length_plan(lengths: DataFrame, knapsack_words: int) -> DataFrame:
    """source, size, n (documents to take once more) from source, rest, size, docs. A group
    is the distinct lengths of a source."""

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", ignore_index=True)
        group["n"] = fitted(group["size"].to_numpy(), group["docs"].to_numpy(),
                            float(group["rest"].iloc[0]), knapsack_words)
        return group[["source", "size", "n"]]

    return lengths.groupBy("source").applyInPandas(plan, "source string, size bigint, n bigint")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most_copies: int = 2,
    seed: int = 17,
    knapsack_words: int = KNAPSACK_WORDS,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per row of ``docs``.

    ``copies`` says how often the mix takes the document and ``taken`` how many words that are.
    Null texts and texts without words have size 0 and are never taken; a null source is a source
    of its own. Rows that share a doc_id are documents of their own, in an order that is the same
    for any layout as far as their sizes differ. An empty table gives no rows.
    """
    sized = written(
        docs.select("doc_id", "source", words().alias("size"))
        .withColumn("order", seeded("doc_id", seed))
        .withColumn("bucket", F.pmod("order", F.lit(BUCKETS)).cast("int")),
        "sizes",
    )
    counts = written(sized.groupBy("source", "size", "bucket").agg(F.count("*").alias("docs")),
                     "size-counts")
    by_length = counts.groupBy("source", "size").agg(F.sum("docs").alias("docs"))
    # Grouping keys compare nulls as equal, joins need <=> for that.
    goals = targets(
        by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size")),
        weights, share, most_copies,
    )
    goals = written(
        goals.withColumn("whole", F.when(F.col("source_size") > 0,
                                         F.floor(F.col("target") / F.col("source_size")))
                         .otherwise(0).cast("int"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")),
        "targets",
    )
    lengths = (
        by_length.alias("l").where("size > 0")
        .join(goals.alias("g"), F.expr("l.source <=> g.source"))
        .where("rest > 0")
        .select("l.source", "rest", "size", "docs")
    )
    plan = length_plan(lengths, knapsack_words).where("n > 0")
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    cuts = (
        counts.withColumn("before", F.coalesce(F.sum("docs").over(before), F.lit(0)))
        .alias("c")
        .join(plan.alias("p"), F.expr("c.source <=> p.source and c.size = p.size"))
        .where("before < n")
        .select("c.source", "c.size", "c.bucket", F.least("docs", F.expr("n - before")).alias("n"),
                "docs")
    )
    own = sized.alias("s").join(
        cuts.alias("c"),
        F.expr("s.source <=> c.source and s.size = c.size and s.bucket = c.bucket"), "left",
    ).select("s.*", "c.n", "c.docs")
    whole = own.where("n is null or n = docs").withColumn(
        "extra", F.col("n").isNotNull().cast("int")
    )
    ranked = Window.partitionBy("source", "size", "bucket").orderBy("order", "doc_id")
    cut = own.where("n < docs").withColumn(
        "extra", (F.row_number().over(ranked) <= F.col("n")).cast("int")
    )
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(0).cast("int")
    return (
        whole.unionByName(cut).alias("d")
        .join(goals.alias("g"), F.expr("d.source <=> g.source"))
        .select("doc_id", "d.source", "size", "source_size", "target", copies.alias("copies"))
        .withColumn("taken", F.col("size") * F.col("copies"))
    )
