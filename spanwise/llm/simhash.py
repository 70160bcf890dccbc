"""Near-duplicate documents by SimHash, linked through a grid of segment popcounts.

Fingerprint: XXH64 (seed 42) of every 3-word shingle of the lower-cased text, repeats included; a bit is
set if it is set in more than half of them. Texts of fewer words have one shingle, the whole sequence;
texts without words have fingerprint zero.

Links join fingerprints that differ in ``MAX_BITS`` bits at most. Each distinct fingerprint becomes the
vector of set bits in its 32 segments of two bits. The Manhattan distance of two vectors never exceeds the
Hamming distance, so fingerprints that link lie within two steps of each other on the grid of vectors, and
both reach a common cell with one step at most. Every fingerprint goes to its cells, and the fingerprints of a cell are compared
bit by bit. A cell with more than ``CROWD`` of them is not compared pair by pair: there two fingerprints link if and only if
one flip at most takes both to a common value, so its members are dealt anew by their 65 values, and a star of each value's
members holds every link's connection. Rows stay in proportion to distinct fingerprints.

Components come from hooking and pointer jumping over those stars, each round written to the shared folder.

Results: a null text has no words. Copies share a fingerprint and count once from there on. Rows without
doc_id get a component if others of it have an id, else null. Rows of one doc_id are one document for
linking, and each keeps its row. Other columns play no part; an empty table gives an empty one.
"""

from __future__ import annotations

from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanwise.llm.common import discard, map_texts, own_name, small, stored

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
CROWD = 64
COUNT_MASK = 0x5555555555555555


def shingle_hashes(text: bytes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of every shingle of a text in UTF-8, words by ASCII white space, A-Z in lower case."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    spans = map(slice, starts, ends[width - 1:]) if len(words) > width else [slice(None)]
    hashed = map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(SEED))
    return np.fromiter(hashed, np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The majority of each bit, as an unsigned number."""
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):  # long texts in steps
        octets = hashes[at:at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id and ``fp``, the fingerprint as a signed long."""

    def make():
        def step(batch):
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            values = np.array([fingerprint(shingle_hashes(t or b"")) for t in texts], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column(doc_id), pa.array(values.view(np.int64))], [doc_id, "fp"])

        return step

    kind = df.schema[doc_id].dataType.simpleString()
    return map_texts(df.select(doc_id, text), f"`{doc_id}` {kind}, fp long", make, text)


def _bit_flips(fp):
    """A value and the 64 values one flip away."""
    bits = F.sequence(F.lit(0), F.lit(63))
    flips = F.transform(bits, lambda i: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    return F.concat(F.array(fp), flips)


def _cells(fp):
    """The cell of a value's popcounts, two bits a segment, and all cells one step away along one segment."""
    mask = F.lit(COUNT_MASK).cast("long")
    low, high = fp.bitwiseAND(mask), F.shiftrightunsigned(fp, 1).bitwiseAND(mask)
    counts = low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))
    segments = F.sequence(F.lit(0), F.lit(62), F.lit(2))

    def count(i):
        return F.call_function("shiftrightunsigned", counts, i).bitwiseAND(F.lit(3).cast("long"))

    def flipped(i, bits):  # 0 <-> 1 differ in the lower bit of a segment, 1 <-> 2 in both
        return counts.bitwiseXOR(F.call_function("shiftleft", F.lit(bits).cast("long"), i))

    below = F.transform(F.filter(segments, lambda i: count(i) < 2), lambda i: flipped(i, 1))
    above = F.transform(F.filter(segments, lambda i: count(i) > 0), lambda i: flipped(i, 3))
    return F.concat(F.array(counts), below, above)


def grid_edges(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b), a > b, among ``node`` that connect just what links; nodes: ``fp``, ``node``, distinct fingerprints."""
    cells = nodes.select("fp", "node", F.explode(_cells(F.col("fp"))).alias("cell"))
    dealt = stored(cells.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("cell"))).where("members > 1"), "cells")
    member = F.struct("node", "fp")
    few = dealt.where(F.col("members") <= crowd).groupBy("cell").agg(F.collect_list(member).alias("of"))

    def links(x, i):
        later = F.filter(F.slice("of", i + 2, F.size("of")), lambda y: F.bit_count(x.fp.bitwiseXOR(y.fp)) <= MAX_BITS)
        return F.transform(later, lambda y: F.struct(F.greatest(x.node, y.node).alias("a"), F.least(x.node, y.node).alias("b")))

    compared = few.select(F.inline(F.flatten(F.transform("of", links)))).distinct()
    crowded = dealt.where(F.col("members") > crowd).select("fp", "node").distinct()
    return compared.union(star_edges(crowded))


def star_edges(nodes: DataFrame) -> DataFrame:
    """The same for fingerprints that crowd a cell, by the values one flip away."""
    values = nodes.select("node", F.explode(_bit_flips(F.col("fp"))).alias("value"))
    reach = Window.partitionBy("value")  # of 65 fingerprints at most
    return (values.withColumn("b", F.min("node").over(reach)).where("node > b")
            .select(F.col("node").alias("a"), "b").distinct())


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """The smallest node that each node of the edges can reach: ``node``, ``component``.

    A round gives every node the least label among its neighbours', then the label of that label. A node has
    no more neighbours than its cells and values hold, so the joins over edges have no hot key; those over labels are
    plain joins, whose large partitions Spark splits.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")), purpose)
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), purpose)
    tables = [labels]
    while True:
        near = (both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near")))
        hooked = stored(labels.join(near, labels.node == near.a)
                        .select("node", "component", F.least("component", "near").alias("hooked")), purpose)
        roots = hooked.select(F.col("node").alias("root"), F.col("hooked").alias("label"))
        jumped = stored(hooked.join(roots, hooked.hooked == roots.root, "left")
                        .select("node", "component", F.least("hooked", "label").alias("new")), purpose)
        done = jumped.where("new < component").isEmpty()
        discard(*tables, hooked)
        labels, tables = jumped.select("node", F.col("new").alias("component")), [jumped]
        if done:
            discard(both)
            return labels


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``fp`` and ``component_id``, the smallest id reachable over links, its own included."""
    prints = stored(fingerprints(df, doc_id, text).withColumnRenamed(doc_id, "doc_id"), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct")
    reached = components(grid_edges(distinct.where("node IS NOT NULL")))
    classes = distinct.join(reached, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def without_copies(docs: DataFrame) -> DataFrame:
    """One document of each component, that of the smallest doc_id, with all its columns.

    Rows of one doc_id are one document: it goes if any of them belongs to a smaller id, else the first by text stays.
    Rows without doc_id stay. Only documents whose id repeats are moved; the others meet a list of ids that is sent to
    all executors up to its checked size.
    """
    found = stored(near_duplicates(docs).where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("component_id").alias("component_id"), F.count("*").alias("rows")), "copies")
    gone = small(stored(found.where("component_id < doc_id").select("doc_id"), "gone"))
    again = small(stored(found.where("component_id = doc_id AND rows > 1").select("doc_id"), "repeated"))
    once = docs.join(gone, "doc_id", "left_anti").join(again, "doc_id", "left_anti").select(docs.columns)
    place = own_name("place", docs.columns)
    order = Window.partitionBy("doc_id").orderBy("text")
    first = (docs.join(again, "doc_id", "left_semi").withColumn(place, F.row_number().over(order))
             .where(F.col(place) == 1).select(docs.columns))
    return once.unionByName(first)


def hex_of(fp) -> F.Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
