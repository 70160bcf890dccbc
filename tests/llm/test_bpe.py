"""Byte-level BPE against the tokenizers library, and exact round trips."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spanwise.llm import bpe, registry

PATH = public_tokenizers.path(registry.BYTE_VOCABULARY)
SCHEMA = "doc_id long, text string, token_ids string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return bpe.codec(f.read())


def expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_random_texts_equal_the_library(library, codec):
    rng = random.Random(1)
    pool = [*"ab'sre \n\té", "<|endoftext|>", "あ", "\x1c", "\xa0", "՘", "日本", "🙂", " the", "'ll", "123"]
    for _ in range(1500):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(codec.encode([text])[0], "<u4").tolist() == ids
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("length", [2, 60, 300, 4000])
def test_scan_and_heap_take_the_same_merges(library, codec, length):
    rng = random.Random(length)
    word = "".join(rng.choice("abcdethin") for _ in range(length))
    parts = codec.byte_id[np.frombuffer(word.encode(), np.uint8)]
    scanned = next(iter(codec.scan(parts[None, :].copy())))[1][0].tolist()
    assert codec.heap(parts.tolist()) == scanned == library.encode(word).ids


def test_query_on_edges(spark, library, tmp_path):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a<|endoftext|> b", None), (3, "a<|endoftext|> b", None), (None, "x " * 50_000, "")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in registry.op10_bpe(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((i, *expected(library, t or "")) for i, t, _ in rows), key=str)


def test_empty_table(spark):
    assert bpe.round_trip(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_decode_of_stored_ids(spark):
    df = spark.createDataFrame([(1, "día de sol"), (2, None)], "doc_id long, text string")
    ids = bpe.encode_documents(df, PATH, ["doc_id"])
    assert {tuple(r) for r in bpe.decode_documents(ids, PATH, ["doc_id"]).collect()} == {(1, "día de sol"), (2, "")}
