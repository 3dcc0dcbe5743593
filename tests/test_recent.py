"""Duplicates among the last n ids of a source, against a deque."""

import random
from collections import defaultdict, deque
from datetime import datetime, timedelta

from hearsay.sources.readers import stream_events
from hearsay.streaming import jobs, sinks
from hearsay.streaming.recent import recent_only

SCHEMA = "feed STRING, id STRING, place BIGINT, at TIMESTAMP, payload STRING"
START = datetime(2025, 1, 1)


def expected(batches, n, idle=None):
    rings, out, last = defaultdict(deque), [], {}
    for batch in batches:
        for feed, name, place, at, payload in sorted(batch, key=lambda r: r[2]):
            ring = rings[feed]
            if idle and feed in last and at - last[feed] > idle:
                ring.clear()
            if name is None or name not in ring:
                out.append(place)
                if name is not None:
                    ring.append(name)
                    if len(ring) > n:
                        ring.popleft()
        for row in batch:
            last[row[0]] = max(row[3], last.get(row[0], row[3]))
    return sorted(out)


def polled(spark, folder, batches):
    """One file per batch, in order."""
    for number, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").json(f"{folder}")


def kept(spark, tmp_path, batches, runs=1, **options):
    folder, table, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    size = -(-len(batches) // runs)
    for start in range(0, len(batches), size):
        polled(spark, folder, batches[start:start + size])
        stream = stream_events(spark, folder, SCHEMA, max_files=1)
        once = recent_only(stream, "feed", "id", ["place"], "at", **options)
        jobs.keep_facts(once, table, checkpoint).awaitTermination()
    rows = sinks.read_appended(spark, table).collect()
    assert all(r["payload"] == f"text {r['place']}" for r in rows)
    return sorted(r["place"] for r in rows)


def test_last_ids_across_batches_and_restarts(spark, tmp_path):
    """Repeats within and outside of the last n, over micro-batches and a restart."""
    draw = random.Random(1)
    place, batches = 0, []
    for number in range(6):
        batch = []
        for _ in range(60):
            feed = draw.choice(["a", "a", "a", "b"])
            name = None if draw.random() < 0.05 else f"{draw.randrange(25)}"
            batch.append((feed, name, place, START + timedelta(minutes=place), f"text {place}"))
            place += 1
        draw.shuffle(batch)
        batches.append(batch)
    got = kept(spark, tmp_path, batches, runs=2, n=10)
    assert got == expected(batches, 10)
    assert 100 < len(got) < 300


def test_an_idle_source_is_forgotten(spark, tmp_path):
    """After the idle time (and the watermark's delay) a source's ids are new again."""
    day = timedelta(days=1)
    batches = [
        [("a", "x", 0, START, "text 0"), ("b", "x", 1, START, "text 1")],
        [("b", "y", 2, START + 5 * day, "text 2")],
        [("b", "y", 3, START + 5.1 * day, "text 3")],  # the watermark passes a's timer
        [("a", "x", 4, START + 5.2 * day, "text 4"), ("b", "y", 5, START + 5.2 * day, "text 5")],
    ]
    assert kept(spark, tmp_path, batches, idle_days=2.0, n=5) == [0, 1, 2, 4]
