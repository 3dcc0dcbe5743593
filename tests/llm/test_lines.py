import hashlib
import re

import numpy as np

from check_queries import canonical, connect
from hearsay.llm import linededup
from hearsay.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def brute(rows, least=10):
    """rows: (doc_id, text); the kept text of each."""
    def key(line):
        stripped = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
        return re.sub("[A-Z]", lambda m: m.group().lower(), stripped)

    first, holders = {}, {}
    for doc, text in rows:
        if doc is None:
            continue
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(doc)
    first = {k: min(v) for k, v in holders.items() if len(k) >= least and len(v) > 1}
    return [
        (doc, "\n".join(line for line in (text or "").split("\n")
                        if doc is None or first.get(key(line), doc) == doc))
        for doc, text in rows
    ]


def test_odd_rows(odd_docs, odd_rows, no_docs):
    rows = [(r[0], r[1]) for r in odd_rows]
    kept = linededup.dedup_lines(odd_docs)
    assert kept.columns == [*odd_docs.columns, "n_lines", "n_dropped"]
    by = lambda r: (r[0] is None, r[0] or 0, r[1])
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=by)
    assert found == sorted(brute(rows), key=by)
    assert linededup.dedup_lines(no_docs).count() == 0


def test_full_filters_give_the_same(odd_docs):
    """Filters folded until they suspect every line cost more, and change nothing."""
    small = linededup.dedup_lines(odd_docs, filter_bytes=64).select("doc_id", "text").collect()
    large = linededup.dedup_lines(odd_docs).select("doc_id", "text").collect()
    assert sorted(map(str, small)) == sorted(map(str, large))


def test_blocks_give_the_same(odd_docs, monkeypatch):
    large = linededup.digests(odd_docs).collect()
    monkeypatch.setattr(linededup, "BLOCK_HASHES", 500)
    assert sorted(map(str, linededup.digests(odd_docs).collect())) == sorted(map(str, large))


def test_bloom_has_no_false_negatives():
    hashes = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    bloom = linededup.Bloom.sized(len(hashes))
    bloom.add(hashes[:10_000])
    assert bloom.has(hashes[:10_000]).all()
    assert bloom.has(hashes[10_000:]).mean() < 0.02
    assert bloom.folded(1 << 12).has(hashes[:10_000]).all()


def test_query_matches_sql(spark):
    found = QUERIES["op3_line_dedup"](spark, FOLDER)
    assert canonical(found.toPandas()) == canonical(connect(FOLDER).sql(SQL["op3_line_dedup"]).df())
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    shas = {d: hashlib.sha256(t.encode()).hexdigest() for d, t in brute(texts)}
    assert {r.doc_id: r.kept_sha256 for r in found.collect()} == shas
