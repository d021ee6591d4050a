import hashlib
import random

import numpy as np
import pytest

from hirelake.llm import bpe

from .helpers import corpus, frame

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(*bpe._vocabulary())


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=codec.pattern.pattern, mergeable_ranks=codec.ranks, special_tokens={})


def texts(seed, n):
    rng = random.Random(seed)
    alphabet = list("aab eé  \n\t'ss1234.,!?<|>中文字é😀  ") + ["the", "'ll", "   ", "\r\n", "ing"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(n)]


def test_small_trees_equal_library(codec, reference):
    small = bpe.Codec(codec.ranks, codec.pattern.pattern, leaf_chars=5, leaf_bytes=2, leaf_ids=3)
    for text in [*texts(1, 600), "a" * 1000, " " * 500, "<|endoftext|>", "\n" * 77 + "x", "é" * 300]:
        ids = reference.encode_ordinary(text)
        assert list(small.encode(text)) == list(codec.encode(text)) == ids
        assert small.decode(ids) == text.encode()


def test_both_mergers_agree(codec):
    for text in texts(2, 200):
        data = text.encode()[:64]
        assert codec.merged_short(data) == codec.merged_long(data)


@pytest.mark.parametrize("block", [1_000_000, 700])
def test_documents(spark, reference, block):
    rows = corpus()
    out = bpe.encode_documents(frame(spark, rows), block_chars=block)
    found = sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["decoded"])) for r in out.collect()), key=str)
    assert found == sorted(((r[0], reference.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows), key=str)


def test_digests(spark):
    df = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    empty = hashlib.sha256(b"").hexdigest()
    assert bpe.encode_documents(df, outputs=bpe.DIGESTS).orderBy("doc_id").collect() == [(1, 0, empty, empty), (2, 0, empty, empty)]


def test_no_rows(spark):
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_text_of_millions_of_characters(spark, reference):
    """Blocks of one text are encoded by different tasks; some of them end within a run of letters."""
    text = "".join(texts(3, 6_000)) * 4 + "ab" * 400_000 + "".join(texts(4, 2_000))
    assert len(text) > 3_000_000
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in bpe.encode_documents(df, block_chars=300_000).collect()}
    assert np.frombuffer(found[1]["ids"], "<u4").tolist() == reference.encode_ordinary(text)
    assert bytes(found[1]["decoded"]) == text.encode() and bytes(found[2]["decoded"]) == b"short"


def test_what_is_remembered_is_bounded(codec, reference):
    small = bpe.Codec(codec.ranks, codec.pattern.pattern, cache_bytes=20_000)
    for text in texts(5, 400):
        assert list(small.encode(text)) == reference.encode_ordinary(text)
        assert len(small.known) < 120
    assert small.known.old and small.known.young
