"""Byte-level BPE against the tiktoken library."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from geosift.llm import byte_bpe as B

DOCS = "doc_id long, text string, ids string, n_tokens string, decoded string"


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(B.default_ranks(), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ours():
    return B.ByteBpe(B.read_ranks(B.default_ranks()), public_tokenizers.PATTERN)


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_every_character(theirs, ours):
    texts = [f"a{chr(c)}b {chr(c)} " for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(texts), 10_000):
        some = texts[a : a + 10_000]
        assert [ids(x) for x in ours.encode(some)] == theirs.encode_ordinary_batch(some)


def random_texts(n):
    rng = random.Random(4)
    parts = ["a", "  ", " ", "\n", "é", "'s", "the", "1", "中文", "́", "!", "\t", "\x1c", "\x85", "\xa0", "\0", "<|endoftext|>", "😀", "Übergröße"]
    return ["".join(rng.choice([*parts, "xyz"[: rng.randint(1, 3)]]) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_small_memory_and_pieces(theirs, ours, monkeypatch):
    texts = [*random_texts(2000), "a" * 5000, "ab " * 3000, " " * 4000]
    want = [theirs.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(B, "MEMORY", 3000)
    monkeypatch.setattr(B, "CHUNK", 97)
    assert [ids(x) for x in ours.encode(texts)] == want
    assert [ours.decode(x).decode() for x in ours.encode(texts)] == texts


def test_query_equals_the_library(spark, theirs, tmp_path):
    texts = [None, "", " ", *random_texts(300), "one\n\n two " * 20_000, "x" * 200_000]
    rows = [(None if i == 7 else i % 290, t, "a", "b", "c") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in B.op13_byte_bpe(spark, str(tmp_path)).collect()), key=str)
    want = []
    for (d, *_), t in zip(rows, texts, strict=True):
        tokens = theirs.encode_ordinary(t or "")
        want.append((d, len(tokens), hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_decode_keeps_rows_and_nulls(spark):
    rows = B.encode(spark.createDataFrame([(1, "Grüße!"), (2, None)], "doc_id long, text string"))
    out = B.decode(rows.withColumn("ids", F.when(F.col("doc_id") == 1, F.col("ids")))).orderBy("doc_id").collect()
    assert [(r.doc_id, r.decoded and bytes(r.decoded).decode()) for r in out] == [(1, "Grüße!"), (2, None)]
    assert B.encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_vocabularies_that_are_refused(tmp_path):
    with pytest.raises(ValueError, match="single bytes"):
        B.serialise_model([b"a", b"b"])
    (tmp_path / "ranks").write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError, match="ranks"):
        B.read_ranks(str(tmp_path / "ranks"))
