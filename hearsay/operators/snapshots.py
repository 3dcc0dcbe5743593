"""Report tables of one run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hearsay.operators.kpis import content_split, daily_posts, post_kpis
from hearsay.operators.ranks import top_k
from hearsay.operators.words import scored_titles, top_keywords
from hearsay.operators.filters import posts_only


def _ranked(top: DataFrame, label: str, value: str) -> DataFrame:
    """Ranks of a top-k frame; its few rows are in one place already."""
    window = Window.orderBy(F.desc(value), F.asc(label))
    return top.select(
        F.row_number().over(window).alias("rank"),
        F.col(label).alias("label"),
        F.col(value).alias("value"),
    )


def snapshot_tables(
    facts: DataFrame, run_id: int, community: str | None = None, k: int = 10
) -> dict[str, DataFrame]:
    """Key figures, content split, top lists and time line, each tagged with the run."""
    sentiment = scored_titles(facts).agg(F.avg("sentiment")).scalar()
    kpis = post_kpis(facts).select(
        (F.col("total_posts") + F.col("total_comments")).alias("total_content"),
        "total_posts",
        F.coalesce(sentiment, F.lit(0.0)).alias("avg_sentiment"),
        "avg_score",
        "avg_comments",
    )
    tables = {
        "kpis": kpis,
        "content_split": content_split(facts).select("posts", "comments"),
        "top_keywords": _ranked(top_keywords(posts_only(facts), "title", k), "word", "count"),
        "timeline": daily_posts(facts),
    }
    if community:
        counts = facts.groupBy(community).agg(F.count(F.lit(1)).alias("count"))
        tables["top_communities"] = _ranked(top_k(counts, "count", k, community), community, "count")
    return {name: df.withColumn("run_id", F.lit(run_id)) for name, df in tables.items()}
