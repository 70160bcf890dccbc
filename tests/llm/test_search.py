"""Exact top-k against brute force, ties and odd vectors included."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.llm import registry, search

SCHEMA = "vec_id long, embedding array<float>, label int, score int"


def brute(rows, k=5):
    valid = []
    for n, (i, v, *_) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            valid.append((n, i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for n, i, q in valid:
        if i is None or i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for m, j, v in valid if m != n and len(v) == len(q))
        out += [(i, r + 1, None if gone else j, -s) for r, (s, gone, j) in enumerate(scored[:k])]
    return sorted(out, key=str)


def test_query_with_ties_and_invalid_vectors(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(19)], 0, 0) for i in range(300)]
    rows += [(1000 + i, rows[0][1], 0, 0) for i in range(40)]
    rows += [(50, rows[3][1], 1, 0), (None, rows[0][1], 1, 0), (150, None, 1, 0), (200, [None] * 19, 1, 0),
             (250, [float("nan")] + [0.0] * 18, 1, 0), (350, [float("inf")] * 19, 1, 0), (400, [0.5, 0.1], 1, 0), (401, [0.1, 0.2], 1, 0),
             (450, [], 1, 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in registry.op8_top_k(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_blocks_and_bounds(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(search, "TILE", 64)
    monkeypatch.setattr(search, "FIRST_TILE", 6)
    monkeypatch.setattr(search, "PAIRS", 50)
    for scale in (40, 10**7):
        v = rng.integers(-scale, scale, (700, 33))
        q = np.concatenate([v[:10], rng.integers(-scale, scale, (10, 33))])
        rows, ids = np.arange(700), rng.permutation(700)
        at, place, score = search.best(np.r_[np.arange(10), -np.arange(1, 11)], q, rows, ids, v, 4)
        for n in range(20):
            want = sorted((-int(q[n] @ v[j]), ids[j]) for j in range(700) if n >= 10 or j != n)[:4]
            assert [(-s, ids[p]) for a, p, s in zip(at, place, score) if a == n] == want


@pytest.mark.parametrize("queries, tile", [(3, 512), (100, 2)])
def test_many_groups_and_empty_table(spark, monkeypatch, queries, tile):
    monkeypatch.setattr(search, "CANDIDATES", 40)
    monkeypatch.setattr(search, "QUERIES", queries)
    monkeypatch.setattr(search, "QUERY_TILE", tile)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], 0, 0) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = search.top_k(search.whole_numbers(df), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)
    assert search.top_k(search.whole_numbers(df.limit(0)), F.col("vec_id") % 50 == 0).collect() == []
