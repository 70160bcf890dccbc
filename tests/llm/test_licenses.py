import random
import re

import pytest

from spanwise.llm import licenses, registry

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_base(words):
    return sorted((s, s + len(p.split()), label) for p, label in licenses.PHRASES.items()
                  for s in range(len(words)) if words[s:s + len(p.split())] == p.split())


def plain_statistics(words, sequences):
    """The longest run that ends at each word and occurs in a sequence, by looking."""
    runs = {tuple(s[a:b]) for s in sequences for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
    out = []
    for j in range(len(words)):
        n = max((n for n in range(1, j + 2) if tuple(words[j + 1 - n:j + 1]) in runs), default=0)
        if n:
            out.append((j, n))
    return out


def scan(text):
    return licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES).scan(text.encode())


def test_statistics_equal_search():
    rng = random.Random(5)
    for _ in range(200):
        sequences = [[rng.choice("abc").encode() for _ in range(rng.randint(1, 9))] for _ in range(3)]
        phrases = {" ".join(w.decode() for w in s): str(i) for i, s in enumerate(sequences[:1])}
        scanner = licenses.Scanner(phrases, [("x", " ".join(w.decode() for w in s)) for s in sequences[1:]])
        words = [rng.choice("abcd").encode() for _ in range(30)]
        assert [s[:2] for s in scanner.statistics(words)] == plain_statistics(words, sequences)
        phrase = sequences[0]
        want = [s for s in range(30) if words[s:s + len(phrase)] == phrase]
        assert [b[1] for b in scanner.scan(b" ".join(words))[1]] == want


def test_places_of_states():
    auto = licenses.Automaton([[b"a", b"b", b"a"], [b"b", b"a"]])
    assert auto.places[auto.whole[1]] == {(0, 3), (1, 2)}


@pytest.mark.parametrize("text, labels", [
    ("Released under the MIT License.", {"mit"}),
    ("x licensed under cc by-nc 4.0 y", {"cc-by-nc-4.0"}),
    ("MIT, not a License", set()),
    ("Permission is hereby granted, free of charge, to any user obtaining a copy of this software and associated documentation "
     "files (the Thing), to deal in the Software without restriction, including without limitation the rights to use, copy, "
     "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
     "Software is furnished to do so", {"mit"}),
    ("", set()),
])
def test_labels(text, labels):
    assert {s[0] for s in scan(text)[2]} == labels


def test_chain_spans_an_edit_and_repeats():
    text = "Licensed under the Apache License, Version 2.0. " * 3
    _, base, spans, best = scan(text)
    assert [(s[0], s[1], s[2], s[4]) for s in spans] == [("apache-2.0", 8 * i, 8 * i + 8, 1.0) for i in range(3)]
    assert best == 1.0 and [b[1] for b in base] == [3, 11, 19]
    notice = dict(licenses.TEMPLATES)["bsd"].replace("binary", "any other")
    (label, start, end, covered, share), = scan("so " + notice + " end")[2]
    assert (label, start, end) == ("bsd", 1, 1 + len(plain_words(notice))) and 0.9 < share < 1


def test_long_text_is_linear():
    words, base, spans, _ = scan("the license under the terms of the mit license of " * 40_000)
    assert words == 400_000 and len(base) == 40_000


def test_query_equals_plain_python(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in registry.op13_licenses(spark, SF).collect()}
    assert got.keys() == texts.keys()
    found = 0
    for i, text in texts.items():
        words, row = plain_words(text), got[i]
        base = plain_base(words)
        found += len(base)
        labels = {b[2] for b in base}
        assert (row.n_words, row.n_base) == (len(words), len(base))
        assert (row.first_word, row.last_word) == ((base[0][0], max(b[0] for b in base)) if base else (None, None))
        assert row.base_labels == ",".join(sorted(labels)) and labels <= set(row.labels.split(","))
        assert 0 <= row.score <= 1 and (row.score > 0 or not base)
    assert found


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, label string, base string, spans long"
    rows = [(1, None, "x", "y", 2), (1, None, "x", "y", 2), (None, "cc by", None, None, None), (3, "Ä mit MIT license", "", "", 1)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.labels, r.score)
                 for r in registry.op13_licenses(spark, str(tmp_path)).collect())
    assert got[1:3] == [(1, 0, 0, None, "", 0.0)] * 2
    assert got[0][:5] == (0, 2, 1, 0, "cc-by") and got[3][:5] == (3, 4, 1, 2, "mit")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert registry.op13_licenses(spark, f"{tmp_path}/none").count() == 0
