"""N-gram scores against plain counting, and the automaton against its definition."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from spanwise.llm import ngram, registry

SCHEMA = "doc_id long, text string, training string, score double"


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def trains(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 != 2


def brute(rows):
    single, pairs = Counter(), Counter()
    for i, t, *_ in rows:
        if trains(i):
            single.update(w := tokens(t))
            pairs.update(zip([None, *w], w))
    n, shares = sum(single.values()), sum(single.values()) + len(single) + 1
    out = []
    for i, t, *_ in rows:
        w = tokens(t)
        base = score = 0.0
        for h, x in zip([None, *w], w):
            p1, c = (single[x] + 1) / shares, single[h]
            lam = c / (c + c ** ngram.FOLLOWERS) if c else 0.0
            base += log10(p1)
            score += log10((lam * pairs[h, x] / c if c else 0.0) + (1 - lam) * p1)
        out.append((i, not trains(i), len(w), sum(single[x] > 0 for x in w), n, base, score))
    return out


@pytest.mark.parametrize("bucket_bytes", [4 << 20, 2_000])
def test_query_equals_counting(spark, tmp_path, monkeypatch, bucket_bytes):
    monkeypatch.setattr(ngram, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(ngram, "RANGE_BYTES", bucket_bytes)
    rng = random.Random(5)
    words = ["the", "The", "of", "é", "É", "a,b", "x" * 70, "x" * 71, "longer", "\x1f", "\xa0"]
    rows = [(i, rng.choice([" ", "\n", "\t \x0b"]).join(rng.choices(words, k=rng.randint(0, 30))), "", 0.0) for i in range(150)]
    rows += [(200, None, None, None), (200, "", "", 0.0), (None, "the of never", "", 0.0), (201, " of" * 30_000, "", 0.0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in registry.op3_ngram(spark, str(tmp_path)).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-12, atol=1e-9)


def test_probabilities_after_a_word_sum_to_one(spark):
    rows = [(1, "a b a c a b", "", 0.0), (3, "b a", "", 0.0)]
    vocabulary = ["a", "b", "c", None, "unknown"]
    pairs = Counter(p for _, t, *_ in rows for p in zip([None, *tokens(t)], tokens(t)))
    single = Counter(w for _, t, *_ in rows for w in tokens(t))
    shares, c = sum(single.values()) + len(single) + 1, single[b"a"]
    lam = c / (c + c ** ngram.FOLLOWERS)
    words = [w.encode() if w else None for w in vocabulary]
    assert abs(sum(lam * pairs[b"a", w] / c + (1 - lam) * (single[w] + 1) / shares for w in words) - 1) < 1e-12


def test_counts_of_any_size_are_packed_whole():
    for counts in ([], [0, 1, 254, 255, 256, 2**40, 3], [255] * 5):
        packed = ngram._squeezed(np.array(counts, np.int64))
        assert ngram._stretched(packed, len(counts)).tolist() == counts


def test_failure_arcs_are_followed_to_the_state_that_reads():
    automaton = ngram.Automaton(3)
    automaton.fail, automaton.fail_weight = [0, 0, 1], [0.0, -1.0, -0.5]
    automaton.add_arcs(np.array([0, 0, 0, 1]), np.array([0, 1, 2, 1]), np.array([-2.0, -3.0, -4.0, -0.25]), np.array([1, 2, 0, 2]))
    assert automaton.traverse([0, 1, 2], 0) == -2.0 - 0.25 + (-0.5 - 1.0 - 4.0)
    assert automaton.traverse([], 2) == 0.0


def test_nothing_to_train_on_and_empty_table(spark, tmp_path):
    held = next(i for i in range(100) if not trains(i))
    spark.createDataFrame([(held, "a b", "", 0.0)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in registry.op3_ngram(spark, str(tmp_path)).collect()] == [(held, True, 3, 0, 0, 0.0, 0.0)]
    df = spark.createDataFrame([], SCHEMA)
    assert ngram.score_texts(df, df.doc_id.isNotNull()).collect() == []
