"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.frames import written


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) for every node of a link (x, y).

    Each round every node takes the smallest node next to it, then that one's choice; the graph
    shrinks to one node for each choice, until no link is left. Rounds grow with the logarithm of
    the longest chain. Each is written to the shared folder.
    """
    rest = written(links.select("x", "y").where("x != y").distinct(), "links")
    labels = None
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("y").alias("x"), F.col("x").alias("y")))
        near = both.groupBy("x").agg(F.min("y").alias("y")).select(
            F.col("x").alias("node"), F.least("x", "y").alias("step")
        )
        near = written(near, "steps")
        far = near.select(F.col("node").alias("step"), F.col("step").alias("next"))
        chosen = written(near.join(far, "step").select("node", F.col("next").alias("to")), "choices")
        if labels is None:
            labels = chosen.select("node", F.col("to").alias("component"))
        else:
            moved = chosen.select(F.col("node").alias("component"), "to")
            labels = written(
                labels.join(moved, "component", "left")
                .select("node", F.coalesce("to", "component").alias("component")),
                "labels",
            )
        x = chosen.select(F.col("node").alias("x"), F.col("to").alias("tx"))
        y = chosen.select(F.col("node").alias("y"), F.col("to").alias("ty"))
        rest = written(
            rest.join(x, "x").join(y, "y").where("tx != ty")
            .select(F.col("tx").alias("x"), F.col("ty").alias("y")).distinct(),
            "links",
        )
    if labels is None:
        return links.select(F.col("x").alias("node"), F.col("x").alias("component")).limit(0)
    return labels
