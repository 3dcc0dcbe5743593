"""Registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearsay.llm import (
    bpe,
    chat,
    codes,
    fertility,
    html,
    langid,
    linededup,
    minhash,
    mixing,
    ngramjoin,
    runs,
    topk,
    toxicity,
)
from hearsay.llm.frames import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


def rank_file() -> tuple[str, str]:
    """The public multilingual byte-level vocabulary and its splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query
def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path, pattern = rank_file()
    return bpe.digests(table(spark, folder, "documents"), path, pattern)


@query
def op2_chat(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(rows.unionByName(added))


@query
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return linededup.digests(table(spark, folder, "documents"))


SQL["op3_line_dedup"] = linededup.SQL


@query
def op4_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.nearest(table(spark, folder, "embeddings"), every=50, k=5)


SQL["op4_topk"] = topk.SQL


@query
def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


@query
def op6_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngramjoin.joined(table(spark, folder, "documents"))


@query
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identified(table(spark, folder, "documents"))


@query
def op9_fertility(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return fertility.judged(
        table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )


@query
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.rated(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op7_html(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op13_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.digests(runs.planted(table(spark, folder, "documents")))


@query
def op11_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


@query
def op12_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codes.digests(table(spark, folder, "embeddings"))


SQL["op12_codes"] = codes.SQL
