"""Secrets in texts, told apart by who else holds them.

Patterns find candidate spans, in code points of the whole text. Each candidate's value, as a digest, is then counted
over the corpus: by repositories (documents) and by owners (sources). A value that ``WIDE_OWNERS`` owners or more hold, or several
owners in ``WIDE_REPOSITORIES`` repositories or more, is a widely copied example. One that fewer hold is owner-specific; it looks live
if it has variety enough and no placeholder's words. Values never leave the first scan, only digests do.

Positions come from built-in functions alone: the text is split at a pattern, and running sums over the lengths of the pieces
and of the matches between them give every start and end. The sums run over rows, one for each match, so a text with very many
matches costs in proportion to them; texts stay where they are. Masked texts are joined from their clear pieces.

The method adds spans of kind ``key``: credentials that announce their issuer by a fixed prefix.

Results: a null text is empty and has no spans. Rows are kept as they come, repeated or without id (a row without
owner counts for an unnamed owner). Other columns play no part, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.llm.common import own_name, stored

WIDE_OWNERS = 5
#: Repositories from which on two owners are enough.
SEVERAL_OWNERS, WIDE_REPOSITORIES = 2, 100
#: Masks of a text up to which its clear pieces are cut from the text itself; beyond, from its characters.
FEW_MASKS = 32
LEAST_DISTINCT = 6
PLACEHOLDER = "example|sample|changeme|dummy|placeholder|your|xxxx|redacted"
MASK = "[SECRET]"

# Kinds in their order, with pattern, the group that is the secret, and its least length.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("key", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}|xox[abprs]-[A-Za-z0-9-]{20,}"
            r"|(?:sk|rk)_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35,})", 0, 16),
)
BASE = 3  # the first so many kinds


def _found(text: str, number: int) -> Column:
    """The matches of one kind and the groups in them that are the secret."""
    _, pattern, group, _ = KINDS[number]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.struct(whole.alias("whole"), (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole).alias("values"))


def _hits(found: Column, text: str, number: int) -> Column:
    """The matches in order, each with the length of the text before it since the last; no work where there are none.

    A match whose secret is too short has no digest.
    """
    _, pattern, _, least = KINDS[number]
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    zipped = F.slice(F.arrays_zip(gaps.alias("gap"), found["whole"].alias("whole"), found["values"].alias("value")),
                     F.lit(1), F.size(found["whole"]))

    def hit(z, i):
        live = ((F.size(F.array_distinct(F.split(z["value"], ""))) >= LEAST_DISTINCT) & ~F.lower(z["value"]).rlike(PLACEHOLDER))
        return F.struct(F.lit(number).alias("kind"), i.alias("place"), z["gap"].alias("gap"), F.length(z["whole"]).alias("size"),
                        F.when(F.length(z["value"]) >= least, F.sha2(z["value"], 256)).alias("digest"), live.alias("live"))

    none = F.array().cast("array<struct<kind:int,place:int,gap:int,size:int,digest:string,live:boolean>>")
    return F.when(F.size(found["whole"]) > 0, F.transform(zipped, hit)).otherwise(none)


def ownership(held: DataFrame) -> DataFrame:
    """Per digest: ``n_repositories`` and ``n_owners`` that hold it. held: digest, repository, owner."""
    by_owner = (held.distinct().groupBy("digest", "owner").agg(F.count("*").alias("n")))
    return by_owner.groupBy("digest").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def scan(df: DataFrame, doc_id: str = "doc_id", owner: str = "source", text: str = "text") -> DataFrame:
    """One row per document, stored: ``row``, ``doc_id``, ``owner``, ``text_key`` and ``hits``, without its text."""
    picked = df.select(F.col(doc_id).alias("doc_id"), F.col(owner).alias("owner"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                       F.xxhash64(text).alias("text_key"))
    found = picked.withColumns({f"found_{n}": _found("text", n) for n in range(len(KINDS))})
    hits = F.concat(*(_hits(F.col(f"found_{n}"), "text", n) for n in range(len(KINDS))))
    return stored(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "text_key", hits.alias("hits")),
                  "secret-hits")


def placed(scanned: DataFrame) -> DataFrame:
    """The spans of ``scan``, a row each: ``row``, ``doc_id``, ``owner``, ``text_key``, ``start``, ``end``, ``kind``, ``digest``, ``live``."""
    hits = scanned.where(F.size("hits") > 0).select("row", "doc_id", "owner", "text_key", F.inline("hits"))
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("place"))
    ended = hits.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.col("size"))
    return stored(ended.where("digest IS NOT NULL").drop("place", "gap", "size"), "secret-spans")


def judged(spans: DataFrame, wide_owners: int = WIDE_OWNERS) -> DataFrame:
    """Every span of ``placed`` with its corpus counts and verdict: copied, live or sample."""
    # A repository is a document; one without id stands for itself.
    held = spans.select("digest", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), "row")).alias("repository"),
                        F.coalesce("owner", F.lit("")).alias("owner"))
    copied = (F.col("n_owners") >= wide_owners) | (
        (F.col("n_owners") >= min(SEVERAL_OWNERS, wide_owners)) & (F.col("n_repositories") >= WIDE_REPOSITORIES))
    verdict = F.when(copied, "copied").when(F.col("live"), "live").otherwise("sample")
    return spans.join(ownership(held), "digest").withColumn("verdict", verdict)


def secret_report(df: DataFrame, doc_id: str = "doc_id", owner: str = "source", text: str = "text",
                  wide_owners: int = WIDE_OWNERS) -> DataFrame:
    """Per row of ``df``: ``doc_id``, ``spans`` (start, kind number, end), and ``n_live``, ``n_copied``, ``n_sample``."""
    scanned = scan(df, doc_id, owner, text)
    verdicts = ("live", "copied", "sample")
    held = judged(placed(scanned), wide_owners).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"),
        *(F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in verdicts))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return scanned.select("row", "doc_id").join(held, "row", "left").select(
        "doc_id", F.coalesce("spans", none).alias("spans"),
        *(F.coalesce(f"n_{v}", F.lit(0).cast("long")).alias(f"n_{v}") for v in verdicts))


def span_text(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] < BASE)


def kind_count(spans: Column, number: int) -> Column:
    """How many spans are of one kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def _masked(text: Column, masks: Column) -> Column:
    """The text with the mask in place of each of ``masks`` (start, end), which come in order and do not overlap."""
    n = F.size(masks)
    # Where each clear piece begins: at the start and after each mask; it ends before the next mask or with the text.
    begins, ends = F.concat(F.array(F.lit(0)), masks["end"]), F.concat(masks["start"], F.array(F.length(text)))
    pieces = F.arrays_zip(begins.alias("begin"), ends.alias("end"))

    def joined(piece):
        return F.array_join(F.transform(pieces, lambda p: piece(p["begin"], p["end"] - p["begin"])), MASK)

    # Finding a place in a text reads all before it, in an array it does not. Bound as a variable, the array is made once.
    many = F.transform(F.array(F.split(text, "")), lambda letters: joined(
        lambda at, size: F.array_join(F.slice(letters, at + 1, size), "")))
    return F.when(n <= FEW_MASKS, joined(lambda at, size: F.substring(text, at + 1, size))).otherwise(F.get(many, F.lit(0)))


def masks(spans: DataFrame) -> DataFrame:
    """Per ``doc_id`` and ``text_key`` its ``masks`` (start, end) in order: runs of overlapping spans are one."""
    place = Window.partitionBy("doc_id", "text_key").orderBy("start", "end")
    before = F.max("end").over(place.rowsBetween(Window.unboundedPreceding, -1))
    runs = (spans.select("doc_id", "text_key", "start", "end").distinct()
            .withColumn("fresh", F.coalesce(F.col("start") >= before, F.lit(True)).cast("int"))
            .withColumn("run", F.sum("fresh").over(place)))
    each = runs.groupBy("doc_id", "text_key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return each.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("masks"))


def redacted(docs: DataFrame, wide_owners: int = WIDE_OWNERS) -> DataFrame:
    """The documents, columns as they are, with every secret masked that is no widely copied example.

    ``n_chars`` follows the text. Only documents that a pattern matches are moved; which spans are masked depends on doc_id
    and text alone, so copies come out alike.
    """
    found = masks(judged(placed(scan(docs)), wide_owners).where("verdict <> 'copied'"))
    doc, key, of = (own_name(n, docs.columns) for n in ("doc", "text_key", "masks"))
    found = found.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.col("masks").alias(of))
    matched = F.coalesce(reduce(or_, [F.col("text").rlike(pattern) for _, pattern, _, _ in KINDS]), F.lit(False))
    hit = docs.where(matched)
    hit = hit.join(found, hit["doc_id"].eqNullSafe(F.col(doc)) & (F.xxhash64(hit["text"]) == F.col(key)), "left")
    changed = F.col(of).isNotNull()
    text = F.when(changed, _masked(F.col("text"), F.col(of))).otherwise(F.col("text"))
    chars = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return docs.where(~matched).unionByName(hit.withColumn("text", text).withColumn("n_chars", chars).select(docs.columns))
