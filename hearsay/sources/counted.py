"""Counts taken while rows are written, without another pass over them."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from hearsay.sources.readers import CORRUPT, parse_lines


def counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """The rows, and an observation that has the counts once an action has run over them.

    Without ``counts`` all rows are counted, as ``scanned``. Asking the observation before that
    blocks. What an action stops early (a limit above) counts only in part.
    """
    seen = Observation()
    return df.observe(seen, *[
        column.alias(name) for name, column in (counts or {"scanned": F.count(F.lit(1))}).items()
    ]), seen


def observed(rows: DataFrame, seen: Observation) -> dict:
    """What was observed of ``rows``; nothing if the planner found them empty, and so had nothing to run."""
    try:
        return seen.get
    except Py4JJavaError:
        if not rows.isEmpty():
            raise
        return {}


def write_counted(df: DataFrame, path: str, mode: str = "append", **counts: Column) -> dict[str, int]:
    """Write a table and return what was counted on the way (all rows, as ``scanned``)."""
    rows, seen = counted(df, **counts)
    rows.write.mode(mode).parquet(path)
    found = observed(rows, seen)
    return {name: found.get(name) or 0 for name in counts or {"scanned": None}}


def write_parsed(
    lines: DataFrame, schema: str, path: str, raw: str = "value", mode: str = "append"
) -> dict[str, int]:
    """Parse JSON lines, write the rows that parse, and return how many lines were ``good``, ``bad``
    and ``scanned``: one pass, counted below the filter that drops the bad ones."""
    bad = F.col(CORRUPT).isNotNull()
    rows, seen = counted(
        parse_lines(lines, schema, raw), good=F.count_if(~bad), bad=F.count_if(bad),
        scanned=F.count(F.lit(1)),
    )
    rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT).write.mode(mode).parquet(path)
    found = observed(rows, seen)
    return {name: found.get(name) or 0 for name in ("good", "bad", "scanned")}
