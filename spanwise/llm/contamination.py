"""Benchmark passages inside long documents, by size-partitioned MinHash containment search.

Words are runs of letters and digits in lower case; shingles are five words, of an item of fewer words the whole sequence. A
document's shingles are all its runs of five words, and of as many words as any shorter item has. A document contains an item if
it holds at least ``CONTAINMENT`` of the item's distinct shingles.

Items are partitioned by the number of their shingles, in powers of two. A partition whose largest size is u
gives each item a MinHash sketch of its u - ceil(0.8 u) + 1 smallest shingle hashes. An item that a document
contains lacks fewer shingles there than its sketch has, so a document without any sketch value cannot contain
it: the search loses nothing, however long the document. What it finds is verified on the shingles themselves.

Sketches and item shingles are sent to all executors only up to a number of rows (``common.SENT_ROWS``), counted first; beyond,
the joins are ordinary ones. No text moves but that of documents found by the search.

Results: one row per document and contained item. Rows of one doc_id are one document. Rows with null doc_id,
null item_id, or without words take no part; repeated items (same id) unite. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import small, stored

SHINGLE_WORDS = 5
#: Containment as a fraction of whole numbers, so that the comparison is exact.
CONTAINMENT = (4, 5)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(tokens: Column, make, width: Column | int) -> Column:
    """What ``make`` gives of every run of ``width`` words; none of a shorter sequence."""
    n = F.size(tokens)
    places = F.when(n >= width, F.sequence(F.lit(1), n - width + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: make(F.slice(tokens, i, width)))


def _joined(run: Column) -> Column:
    return F.array_join(run, " ")


def item_runs(tokens: Column, make) -> Column:
    """The shingles of an item: a short one is a shingle itself."""
    return F.when(F.size(tokens) > 0, _runs(tokens, make, F.least(F.size(tokens), F.lit(SHINGLE_WORDS)))).otherwise(
        _runs(tokens, make, SHINGLE_WORDS))


def document_runs(tokens: Column, make, widths: list[int]) -> Column:
    """The shingles of a document, in all ``widths`` that items have."""
    return F.concat(*(_runs(tokens, make, w) for w in widths)) if widths else _runs(tokens, make, SHINGLE_WORDS)


def item_shingles(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct shingles of the items: ``item_id``, ``shingle``, ``hash``, ``width`` in words, and ``n_shingles`` of the item."""
    each = (items.where(F.col(item_id).isNotNull())
            .select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("tokens"))
            .select("item_id", F.explode(F.arrays_zip(
                item_runs(F.col("tokens"), _joined).alias("shingle"), item_runs(F.col("tokens"), F.xxhash64).alias("hash"))).alias("s"),
                F.least(F.size("tokens"), F.lit(SHINGLE_WORDS)).alias("width"))
            .select("item_id", "s.shingle", "s.hash", "width").distinct())
    sizes = each.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    return each.join(sizes, "item_id")


def widths_of(shingles: DataFrame) -> list[int]:
    """The numbers of words in the items' shingles: five at most."""
    return sorted(r["width"] for r in shingles.select("width").distinct().collect())


def sketches(shingles: DataFrame) -> DataFrame:
    """The smallest hashes of each item, as many as its size partition needs: ``item_id``, ``hash``."""
    part, whole = CONTAINMENT
    largest = F.expr("shiftleft(1L, cast(floor(log2(n_shingles)) AS int) + 1) - 1")
    needed = largest - F.expr(f"(({part} * (shiftleft(1L, cast(floor(log2(n_shingles)) AS int) + 1) - 1)) + {whole - 1}) div {whole}") + 1
    grouped = shingles.groupBy("item_id", "n_shingles").agg(F.sort_array(F.collect_set("hash")).alias("hashes"))
    return grouped.select("item_id", F.explode(F.slice("hashes", F.lit(1), needed.cast("int"))).alias("hash"))


def candidates(docs: DataFrame, sketch: DataFrame, widths: list[int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs (doc_id, item_id) of which the document holds a value of the item's sketch."""
    hashed = (docs.where(F.col(doc_id).isNotNull())
              .select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("tokens"))
              .select("doc_id", F.explode(document_runs(F.col("tokens"), F.xxhash64, widths)).alias("hash")))
    return hashed.join(sketch, "hash").select("doc_id", "item_id").distinct()


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and item that it contains: ``doc_id``, ``item_id``, ``n_shingles`` of the item,
    ``n_shared`` of them in the document, and ``containment``, their ratio."""
    part, whole = CONTAINMENT
    shingles = stored(item_shingles(items), "item-shingles")
    sketch = small(stored(sketches(shingles), "item-sketches"))
    widths = widths_of(shingles)
    found = stored(candidates(docs, sketch, widths, doc_id, text), "candidates")
    chosen = stored(found.select("doc_id").distinct(), "candidate-documents")
    texts = (docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("tokens"))
             .join(small(chosen), "doc_id", "left_semi")
             .select("doc_id", F.explode(F.array_distinct(document_runs(F.col("tokens"), _joined, widths))).alias("shingle")))
    shared = (texts.join(small(shingles), "shingle").select("doc_id", "item_id", "n_shingles", "shingle").distinct()
              .groupBy("doc_id", "item_id", "n_shingles").agg(F.count("*").alias("n_shared")))
    return (shared.join(found, ["doc_id", "item_id"], "left_semi")
            .where(F.col("n_shared") * whole >= F.col("n_shingles") * part)
            .select("doc_id", "item_id", "n_shingles", "n_shared",
                    (F.col("n_shared") / F.col("n_shingles")).alias("containment")))


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that contain no item, with all their columns; those without doc_id stay."""
    found = stored(contained_items(docs, items).select("doc_id").distinct(), "contaminated")
    return docs.join(small(found), "doc_id", "left_anti").select(docs.columns)
