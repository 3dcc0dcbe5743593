"""Counts of a stream's records, taken in its own pass and entered in the run ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from hearsay.sources.ledger import add_scanned

SCANNED = "scanned"


def observed(stream: DataFrame, name: str = SCANNED) -> DataFrame:
    """The stream, with its records counted under ``name`` in every micro-batch."""
    return stream.observe(name, F.count(F.lit(1)).alias("records"))


class LedgerListener(StreamingQueryListener):
    """Adds what a stream has scanned to a run of the ledger, one entry per micro-batch that is
    done. A batch that failed and is run again is reported, and counts, once."""

    def __init__(self, spark, ledger: str, run_id: int, source: str, name: str = SCANNED):
        self.spark, self.ledger, self.run_id = spark, ledger, run_id
        self.source, self.name = source, name
        self.entered: set[tuple[str, int]] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        metrics = event.progress.observedMetrics.get(self.name)
        batch = (str(event.progress.id), event.progress.batchId)
        if metrics is None or not metrics["records"] or batch in self.entered:
            return
        self.entered.add(batch)
        add_scanned(self.spark, self.ledger, self.run_id, self.source, metrics["records"])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
