"""Containment of benchmark items against brute force."""

from __future__ import annotations

import random
import re

import duckdb

from spanwise.llm import contamination as ct
from spanwise.llm import oracles

DOCS, ITEMS = "doc_id long, text string, hash long, item_id long", "item_id long, text string, hash string"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def runs(words, width):
    return {" ".join(words[i:i + width]) for i in range(len(words) - width + 1)}


def brute(docs, items):
    """An item of fewer than five words is a shingle itself, which a document may hold anywhere."""
    texts, wanted = {}, {}
    for i, t, *_ in items:
        if words(t):
            wanted.setdefault(i, set()).update(runs(words(t), min(5, len(words(t)))))
    for i, t, *_ in docs:
        for width in range(1, 6):
            texts.setdefault(i, set()).update(runs(words(t), width))
    return {(d, i, len(g), len(g & s)) for d, s in texts.items() for i, g in wanted.items()
            if d is not None and i is not None and g and 5 * len(g & s) >= 4 * len(g)}


def test_equals_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 5, 6, 9, 12, 40, 90]))), "x") for i in range(60)]
    items += [(70, None, "x"), (71, "", "x"), (None, "a b c d e", "x"), (3, items[3][1], "x"), (72, items[5][1].upper() + "!", "x")]
    docs = []
    for n in range(150):
        text = rng.choices(words, k=rng.randint(0, 400))
        if n % 2:
            item = rng.choice(items)[1] or ""
            cut = item.split()
            for _ in range(rng.randint(0, 4)):  # near the limit, on both of its sides
                if cut:
                    cut[rng.randrange(len(cut))] = "other"
            text[rng.randint(0, len(text)):0] = cut
        docs.append((n, ", ".join(text), n, 1))
    docs += [(500, items[0][1], 0, 0), (None, items[20][1], 0, 0), (501, None, 0, 0), (502, "", 0, 0), (7, items[30][1], 0, 0),
             (503, "z " * 30_000 + items[33][1], 0, 0)]
    found = ct.contained_items(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in found} == want and len(found) == len(want) > 20


def test_filter_keeps_clean_documents_as_they_are(spark):
    docs = [(1, "one two three four five six", None, 3), (2, "clean words", 5, 4), (2, "clean words", 5, 4), (None, None, 1, 1)]
    df = spark.createDataFrame(docs, DOCS)
    items = spark.createDataFrame([(1, "two three four five six", "")], ITEMS)
    assert sorted(map(tuple, ct.without_contaminated(df, items).collect()), key=str) == sorted(docs[1:], key=str)
    assert ct.contained_items(df.limit(0), items).collect() == ct.contained_items(df, items.limit(0)).collect() == []


def test_short_items_inside_longer_texts(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma", ""), (2, "delta", ""), (3, "one two three four five six", "")], ITEMS)
    docs = [(1, "some words, Alpha beta gamma! and more words after it", 0, 0), (2, "alpha beta, then gamma", 0, 0), (3, "a delta", 0, 0),
            (4, "alpha beta gamma", 0, 0), (5, "deltas", 0, 0)]
    found = ct.contained_items(spark.createDataFrame(docs, DOCS), items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (3, 2), (4, 1)}


def test_sql_finds_short_items_too(spark, tmp_path):
    items = [(1, "alpha beta gamma", ""), (2, "one two three four five six", ""), (3, "solo", "")]
    docs = [(1, "x Alpha beta gamma y z", 0, 0), (2, "one two three four five six seven", 0, 0), (3, "so lo", 0, 0), (4, "a solo", 0, 0)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    got = {r[:4] for r in con.execute(oracles.CONTAMINATION).fetchall()}
    assert got == brute(docs, items) == {(1, 1, 1, 1), (2, 2, 2, 2), (4, 3, 1, 1)}
