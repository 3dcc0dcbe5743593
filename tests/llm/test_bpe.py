import hashlib
import random

import pytest
import tiktoken

from hearsay.llm import bpe
from hearsay.llm.queries import QUERIES, rank_file

PATH, PATTERN = rank_file()


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as file:
        return bpe.codec_of(file.read(), PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_encodes_like_the_library(codec, library):
    draw = random.Random(7)
    parts = ["a", "ab", "th", "e", " ", "\n", "é", "ß", "日", "!!", "  ", "1", "'s", " ", "\x1c"]
    for _ in range(300):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(300)))
        ids = codec.encode(text)
        assert ids.tolist() == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("word", ["a" * 20_000, "ab" * 9_000, "日本" * 3_000])
def test_long_pre_tokens(codec, library, word):
    assert codec.encode(word).tolist() == library.encode_ordinary(word)


def test_rows(odd_docs, no_docs, library):
    rows = bpe.decode(bpe.encode(odd_docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert len(rows) == odd_docs.count()
    for row in rows:
        assert row.ids == library.encode_ordinary(row.text or "")
        assert bytes(row.decoded) == (row.text or "").encode()
    assert bpe.encode(no_docs, PATH, PATTERN).columns[-1] == "ids"
    assert bpe.digests(no_docs, PATH, PATTERN).count() == 0


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op1_byte_bpe"](spark, folder).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for row in rows:
        ids = library.encode_ordinary(texts[row.doc_id] or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(packed).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((texts[row.doc_id] or "").encode()).hexdigest()
