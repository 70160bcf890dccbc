"""The corpus pipeline: each stage on all that the one before kept, against plain Python."""

from __future__ import annotations

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from spanwise.llm import credentials, language, registry
from tests.llm.test_contamination import brute as contained
from tests.llm.test_credentials import base
from tests.llm.test_simhash import brute_classes, brute_print

SF = "/root/testdata/sf0.001"


def masked(text):
    """The text without its secrets; no value in the small table is widely copied."""
    out, at = "", 0
    for start, _, end in base(text):
        if start >= at:
            out += text[at:start] + credentials.MASK
        at = max(at, end)
    return out + text[at:]


def test_stages_equal_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    known = corpus_pipeline.recognise(spark, docs, SF)
    assert known.columns == columns
    rows = {r.doc_id: r for r in known.collect()}
    model = language.train(docs.where(~language.held_out(docs.doc_id, 4, 2)))
    scored = {r.doc_id: r for r in language.identify(docs, model, ["doc_id"]).collect()}
    assert rows.keys() == {i for i, r in scored.items() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_LANGUAGE}

    classes = brute_classes([(i, brute_print(r.text)) for i, r in rows.items()])
    rows = {i: r for i, r in rows.items() if classes[i] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, *_ in contained([(i, r.text) for i, r in rows.items()], items)}
    rows = {i: r for i, r in rows.items() if i not in leaks}
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    want = {i: library.encode(masked(r.text), add_special_tokens=False).ids for i, r in rows.items()}
    got = registry.queries()["pipeline"](spark, SF).collect()
    assert len(got) == len(want) and {r.doc_id: r.token_ids for r in got} == want
    assert leaks and all(r.n_tokens == len(r.token_ids) for r in got)


def test_every_stage_takes_odd_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, hash long"
    rows = [(1, "the of and to in that is was for it", "en", "s", 5, 0.0, 1), (1, "the of and to in that is was for it", "en", "s", 5, 0.0, 1),
            (2, None, None, None, None, None, None), (None, "words without any id in this row", None, "s", 1, 0.0, 1)]
    for some in (rows, []):
        df = spark.createDataFrame(some, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, SF)
            assert df.columns == [c.split()[0] for c in schema.split(", ")]
        left = corpus_pipeline.STAGES[-1][1](spark, df, SF).collect()
        assert sorted(str(r.doc_id) for r in left) == (["1", "None"] if some else [])
