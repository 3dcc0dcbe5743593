import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearsay.llm import components, ngramjoin
from hearsay.llm.frames import written
from hearsay.llm.queries import QUERIES


def brute(rows, words=5, percent=80):
    """rows: (doc_id, text). n_shingles and component_id of each, from all pairs."""
    sets = []
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        grams = {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
        sets.append((doc, grams))
    parent = {doc: doc for doc, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(set)
    for i, (doc, grams) in enumerate(sets):
        if doc is None:
            continue
        for j in {j for g in grams for j in index[g]}:
            other, held = sets[j]
            shared = len(grams & held)
            if 100 * shared >= percent * (len(grams) + len(held) - shared):
                a, b = find(doc), find(other)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        for g in grams:
            index[g].add(i)
    return sorted(((d, len(s), find(d) if d is not None else None) for d, s in sets), key=str)


def found(df, **options):
    return sorted(map(tuple, ngramjoin.joined(df, **options).collect()), key=str)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    got = found(odd_docs)
    expected = brute([(r[0], r[1]) for r in odd_rows])
    # A row without a doc_id, or without words, is in no group.
    assert [g for g in got if g[0] is not None] == [e for e in expected if e[0] is not None]
    assert [g[2] for g in got if g[0] is None] == [None]
    assert found(no_docs) == []


def noisy_copies(seed):
    """Groups of near copies at all distances from their original, a passage in many texts that
    are otherwise different, chains, and exact copies."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(8):
        base = [word() for _ in range(draw.randrange(6, 120))]
        for _ in range(draw.choice([1, 3, 12])):
            copy = list(base)
            for _ in range(draw.randrange(0, max(2, len(base) // 20))):
                copy[draw.randrange(len(copy))] = word()
            texts.append(copy)
    texts += [passage + [word() for _ in range(draw.randrange(3, 90))] for _ in range(25)]
    chain = [word() for _ in range(80)]
    for i in range(10):
        texts.append(chain[i:] + [word() for _ in range(i)])
    texts += [draw.choice(texts) for _ in range(10)] + [["a"], ["a"], ["b", "a"]]
    draw.shuffle(texts)
    return [(i * 3, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed, limits", [
    (1, {}), (2, {"SHORT_LIST": 3, "BATCH_DOCS": 4, "CANDIDATES": 3, "BLOCK_SHINGLES": 0}),
    (3, {"SHORT_LIST": 2, "BATCH_DOCS": 2, "FREQUENT": 40, "BLOCK_SHINGLES": 500}),
])
def test_against_brute_force(spark, monkeypatch, seed, limits):
    """The same groups, whether lists are paired or probed, whatever counts as frequent, and
    whether blocks are searched whole or piecewise."""
    for name, value in limits.items():
        monkeypatch.setattr(ngramjoin, name, value)
    rows = noisy_copies(seed)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert found(frame) == brute(rows)


def test_t_occurrence_matches_intersections():
    draw = np.random.default_rng(4)
    for _ in range(100):
        query = np.unique(draw.integers(0, 60, 40)).astype(np.uint64)
        sets = [np.unique(np.concatenate([query[draw.random(len(query)) < share],
                                          draw.integers(0, 60, 5).astype(np.uint64)]))
                for share in draw.random(12)]
        expected = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, query))
                    >= 80 * len(np.union1d(s, query))]
        assert ngramjoin.t_occurrence(query, sets, 80) == expected


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7), (500, 400), (500, 400)]
    frame = spark.createDataFrame(links, "x bigint, y bigint")
    labels = {r.node: r.component for r in components.components(frame).collect()}
    assert labels == {**dict.fromkeys(range(41), 0), 100: 100, 200: 100, 300: 100, 400: 400, 500: 400}
    assert components.components(frame.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op6_ngram_join"](spark, folder).collect()), key=str)
    assert got == brute(rows)


def test_one_worker_per_task(spark):
    """Rows are dealt between the two functions that make sets, however few the nodes are."""
    rows = [(i, f"some words of text number {i} and more of it") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    nodes = written(spark.createDataFrame([(3,), (5,)], "node bigint"), "t")
    sets = ngramjoin.shingle_sets(docs, nodes, 5)
    assert sorted(r.node for r in sets.collect()) == [3, 5]
    plan = sets._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    steps = [line for line in plan.split("\n") if "MapInArrow" in line or "Exchange hash" in line]
    first, last = (i for i, line in enumerate(steps) if "MapInArrow" in line)
    assert last - first > 1


def test_shared_shingles_alone_are_listed(spark):
    """A shingle that one prefix alone holds becomes no entry of a list; shared ones all do."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(200))) for i in range(20)]
    rows += [(50, rows[0][1] + " more"), (51, rows[1][1] + " more")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    signed = written(ngramjoin.prefixes(docs, 5, 80, np.zeros(0, np.uint64)), "t")
    lists = defaultdict(set)
    for r in signed.collect():
        for shingle in np.frombuffer(r.prefix, np.uint64).tolist():
            lists[shingle].add(r.doc_id)
    shared = {(s, doc) for s, docs in lists.items() if len(docs) > 1 for doc in docs}
    held = ngramjoin.repeated_only(signed).withColumnRenamed("doc_id", "node")
    listed = {(r.shingle % 2**64, r.node) for r in ngramjoin.postings(held).collect()}
    assert shared and shared <= listed
    assert len(listed) < len(shared) + sum(map(len, lists.values())) / 20


def test_a_set_goes_to_a_cell_once(spark):
    """A hundred nodes that all search each other send a hundred sets and link as a forest."""
    sets = [(i, np.arange(i % 2 * 1000, i % 2 * 1000 + 90 + i // 2 % 5, dtype=np.uint64).tobytes())
            for i in range(100)]
    frame = written(spark.createDataFrame(
        [(i, bytearray(s)) for i, s in sets], "node bigint, shingles binary"), "t")
    cells = written(frame.select("node", F.lit(7).cast("bigint").alias("cell")), "t")
    none = spark.createDataFrame([], "node bigint, component bigint")
    found = ngramjoin.linked(cells, cells, none, frame, 80)
    links = found.collect()
    assert len(links) == 98
    labels = {r.node: r.component for r in components.components(found).collect()}
    assert labels == {i: i % 2 for i in range(100)}
