"""Duplicate suppression by count: what a poller does with its last n ids.

A time watermark (``jobs.dedup_stream``) forgets an id after a while, however few records came in
between. A feed that is polled page by page rather repeats its last records, however long the
pause was: there the last n new ids of each source count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RECENT_IDS = 5000


def _processor(column: str, order: list[str], ts: str, n: int, idle_ms: int):
    """The stateful processor. It is made inside a function, so that it travels to the workers by
    value and the library need not be installed there."""
    from pyspark.sql.streaming import StatefulProcessor

    class RecentIds(StatefulProcessor):
        """State of a source: its last n new ids, oldest first, and a timer that drops them."""

        def init(self, handle) -> None:
            self.handle = handle
            self.ring = handle.getListState("ids", "id string")

        def handleInputRows(self, key, rows, timerValues):
            from collections import deque

            import pandas

            frame = pandas.concat(list(rows)).sort_values(order, kind="stable")
            ring = deque(row[0] for row in self.ring.get())
            seen = set(ring)
            kept = []
            for value in frame[column]:
                if value is not None and value == value:  # a missing id repeats nothing
                    name = str(value)
                    if name in seen:
                        kept.append(False)
                        continue
                    ring.append(name)
                    seen.add(name)
                    if len(ring) > n:
                        seen.remove(ring.popleft())
                kept.append(True)
            if ring:
                self.ring.put([(name,) for name in ring])
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            last = int(frame[ts].max().timestamp() * 1000)
            self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + idle_ms)
            yield frame[kept]

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.ring.clear()
            yield from ()

        def close(self) -> None:
            pass

    return RecentIds()


def recent_only(
    df: DataFrame, source: str, key: str, order: list[str], ts: str, n: int = RECENT_IDS,
    idle_days: float = 30.0, delay: str = "1 hour",
) -> DataFrame:
    """Drop records whose id is among the last ``n`` new ids of their source.

    Records of a micro-batch are taken in the order of ``order``; a dropped record does not renew
    its id, and a record without an id stays. ``source`` is one column that names the feed: its
    state is n ids, and a timer drops it when nothing came for ``idle_days`` of event time (plus
    the watermark's ``delay``). A task holds the records of one source in one micro-batch, which the
    source's files per trigger bound. Needs the RocksDB state store, which is set here for
    streams started from now on.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    processor = _processor(key, order, ts, n, int(idle_days * 86_400_000))
    rows = df.withWatermark(ts, delay)
    return rows.groupBy(F.col(source)).transformWithStateInPandas(
        processor, rows.schema, outputMode="Append", timeMode="EventTime"
    )
