"""Language ID: Viterbi against all label sequences, spans of mixed texts, held-out accuracy, edges."""

from __future__ import annotations

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from spanwise.llm import language, registry

SCHEMA = "doc_id long, text string, lang string, score double"
SYLLABLES = {"xa": "th er on an re ou".split(), "xb": "sch ich ung ver keit".split(), "ru": "пр ов ст ни ко".split()}


def text_in(lang, rng, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(2, 4))) for _ in range(n))


def corpus(n=240):
    rng = random.Random(1)
    return [(i, text_in(lang := ("xa", "xb", "ru")[i % 3], rng, rng.randint(3, 60)), lang, 0.5) for i in range(n)]


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(3)
    counts = np.array([3, 0, 1, 5, 4])
    scores = rng.normal(size=(counts.sum(), 3)).astype(np.float32)
    got = language.viterbi(scores, counts, 1.3)
    for first, n in zip(np.cumsum(counts) - counts, counts):
        def total(labels):
            return sum(scores[first + i, s] for i, s in enumerate(labels)) - 1.3 * sum(a != b for a, b in zip(labels, labels[1:]))

        if n:
            best = max(itertools.product(range(3), repeat=int(n)), key=total)
            assert abs(total(best) - total(got[first:first + n])) < 1e-5


def test_spans_of_a_mixed_text(spark):
    rng = random.Random(4)
    parts = [("xa", text_in("xa", rng, 20)), ("xb", text_in("xb", rng, 12)), ("ru", text_in("ru", rng, 2))]
    text = "12 -- " + " ".join(t for _, t in parts)
    model = language.train(spark.createDataFrame(corpus(), SCHEMA))
    (row,) = language.identify(spark.createDataFrame([(1, text, None, 0.1)], SCHEMA), model, ["doc_id"]).collect()
    assert [s.lang for s in row.lang_spans] == ["xa", "xb", "ru"] and row.lang_pred == "xa" and 0 < row.score < 1
    assert [text[s.start:s.end] for s in row.lang_spans] == [t for _, t in parts]
    assert [s.letters for s in row.lang_spans] == [sum(c.isalpha() for c in t) for _, t in parts]


def test_query_on_edges_and_held_out_texts(spark, tmp_path):
    rows = corpus() + [(900, None, "xa", None), (901, "", "xa", 1.0), (902, "12 !?", None, 1.0), (None, "thero onan", "xb", 1.0),
                       (903, "schichung " * 20_000, None, 1.0), (903, "schichung", None, 1.0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op2_language(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by_id[902].score == 0
    assert by_id[None].lang_pred == "xa" and by_id[None].held_out
    assert {r.lang_pred for r in got if r.doc_id == 903} == {"xb"}
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert len(held) > 20 and all(r.lang_pred == rows[r.doc_id][2] for r in held)


def test_nothing_labelled_and_empty_table(spark):
    df = spark.createDataFrame([(1, "words here", None, 0.0)], SCHEMA)
    model = language.train(df)
    assert [(r.lang_pred, r.score, r.lang_spans) for r in language.identify(df, model, ["doc_id"]).collect()] == [("und", 0.0, [])]
    assert language.identify(df.where(F.lit(False)), model, []).collect() == []


def test_filter_keeps_columns_of_any_name(spark):
    model = language.train(spark.createDataFrame(corpus(), SCHEMA))
    rows = [(1, "theron anre", "xa", 0.25), (2, "123", None, None), (3, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_lang_pred", F.lit("mine"))
    assert [tuple(r) for r in language.recognised(df, model, 0.4).collect()] == [(*rows[0], "mine")]


def test_golden_accuracy_on_the_shared_documents(spark):
    sf = "/root/testdata/sf0.001"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in registry.op2_language(spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
