from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from __spark_entry__ import queries
from hearsay.llm import bpe, langid, mixing, ngramjoin
from hearsay.llm.frames import written
from hearsay.llm.queries import QUERIES, rank_file

FOLDER = "/root/testdata/sf0.001"
OPERATORS = {f"op{n}" for n in range(1, 14)}


def test_registered():
    assert {name.split("_")[0] for name in QUERIES} == OPERATORS
    assert queries()["pipeline"] is corpus_pipeline.run
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    known = written(stages["language_id"](spark, docs, FOLDER), "t")
    assert known.columns == columns and 0.95 * docs.count() <= known.count() <= docs.count()

    lines = written(stages["line_dedup"](spark, known, FOLDER), "t")
    assert lines.columns == columns and lines.count() == known.count()
    assert all(len(r.text) == r.n_chars for r in lines.collect())

    apart = written(stages["near_duplicates"](spark, lines, FOLDER), "t")
    groups = {r.component_id for r in ngramjoin.joined(lines).collect()}
    assert apart.columns == columns and {r.doc_id for r in apart.collect()} == groups
    assert apart.count() == len(groups)

    mix = written(stages["mix_sources"](spark, apart, FOLDER), "t")
    rows, key = corpus_pipeline.keyed(apart)
    taken = mixing.mix(rows.select(F.col(key).alias("doc_id"), "source", "text"))
    doc_of = {r[key]: r.doc_id for r in rows.collect()}
    copies = {doc_of[r.doc_id]: r.copies for r in taken.collect() if r.copies}
    assert mix.columns == columns and Counter(r.doc_id for r in mix.collect()) == copies

    last = stages["tokenize"](spark, mix, FOLDER).collect()
    path, pattern = rank_file()
    with open(path, "rb") as file:
        codec = bpe.codec_of(file.read(), pattern)
    texts = {r.doc_id: r.text for r in mix.collect()}
    assert len(last) == mix.count() and all(r.exact for r in last)
    assert all(r.ids == codec.encode(texts[r.doc_id]).tolist() for r in last)


def test_odd_rows(spark, odd_docs, no_docs):
    columns = odd_docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, odd_docs, FOLDER)
        assert found.columns == columns and found.count() > 0, name
        assert stage(spark, no_docs, FOLDER).count() == 0, name
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, odd_docs, FOLDER).where("exact").count() == odd_docs.count()
    assert stage(spark, no_docs, FOLDER).count() == 0
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, odd_docs, FOLDER).collect()}
    assert not kept & {3, 4, 5, 6} and langid.UNKNOWN == "und"


def test_clashing_names(spark, odd_docs):
    """Columns of any name come back as they were, whatever a stage needs for itself."""
    names = ["lost", "n_lines", "n_dropped", "score", "own_score", "_score", "lang_pred", "copies",
             "_copies", "_copy", "copy", "row", "row_key", "key_", "of", "id", "group", "node"]
    docs = odd_docs.withColumns({name: F.lit(name) for name in names}).withColumn(
        "a_map", F.create_map(F.lit("k"), F.lit(1)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, FOLDER)
        assert found.columns == docs.columns, name
        rows = found.collect()
        assert rows and all(r[n] == n for r in rows for n in names), name
        plain = stage(spark, odd_docs, FOLDER)
        assert len(rows) == plain.count(), name
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, docs, FOLDER).where("exact").count() == docs.count()


def test_rows_that_share_an_id(spark):
    """Each row is in the group of its own text; rows without an id take part; equal rows are one."""
    words = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"other{i}" for i in range(60))
    rows = [(1, words), (1, other), (2, words), (3, other + " end"), (None, words), (None, "alone " + other[:80]),
            (4, "short text"), (4, "short text"), (5, None), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()), key=str)
    assert kept == sorted([(1, words), (1, other), (None, "alone " + other[:80]), (4, "short text"),
                           (5, None), (6, None)], key=str)
    mixed = corpus_pipeline.mix_sources(spark, docs.where("doc_id is null or doc_id < 4"), FOLDER).collect()
    assert {r.doc_id for r in mixed} >= {1, None}


def test_one_worker_per_task(spark, odd_docs):
    """No task of the last stage encodes and decodes: each would need a worker with a codec."""
    last = dict(corpus_pipeline.STAGES)["tokenize"](spark, odd_docs, FOLDER)
    assert last._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert last.where("exact").count() == odd_docs.count()
