"""Prefix trie of conversations: union-find over the edges between sorted neighbours, deepest first.

Every turn is a digest of 16 bytes of its role and text, a conversation is their row of bytes, and conversations that share their first
turns share the front of that row. ``prefix_trie`` deals the conversations in the order of (row of bytes, conv_id) over ranges, so any
group of equal or similar ones is spread by itself. The edge between two neighbours is as deep as their common prefix. In
each range the edges join components by union-find in descending depth. A component is a run of neighbours and stands for the
deepest node that all of them share; an edge that joins two of them at a lesser depth makes the branching node there and closes those that lie
deeper. All figures of a node are sums over its run: conversations, leaves and tokens come one edge at a time.

Nodes that reach the first or last conversation of a range may go on in the next one. They stay open: a range is contracted to
its open components (one for every depth at which its first and last conversation branch off) and the edges between them. Forests of
``FAN`` ranges are put side by side, with an edge across each boundary, and joined in the same way, round by round, until
one is left. Nodes without a branching of their own lie on the way between two others and are written out at the end.

Results: a null turn comes first, a null role or text is empty; rows of one turn number are ordered by their digests, and repeated rows are
turns of their own. Rows without conv_id belong to no conversation. A text of any length is one digest; a conversation's digests, 16 bytes
a turn, are one value. An empty table gives an empty trie, without a root. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable
from functools import reduce
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import pieces, small, stored

WIDTH = 16
#: Bytes of digests in a range; forests that are joined at a time; ids of one text of ends.
RANGE_BYTES, FAN, IDS = 8 << 20, 64, 50_000
SHARED, EVERY = 9, 5
NOTHING = hashlib.sha256(b"").hexdigest()


def sequences(df: DataFrame) -> DataFrame:
    """Per conversation ``conv_id``, ``digests`` (hex) of its turns in order and ``sizes``, the UTF-8 bytes of their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    turns = df.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size")).alias("said"))
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    return ordered.select("conv_id", F.col("said.digest").alias("digests"), F.col("said.size").alias("sizes"))


def rebuilt(seqs: DataFrame) -> DataFrame:
    """Each conversation begins with the first turns of one in ``EVERY``: as many as a checksum of its id says, in place of its own."""
    seqs = stored(seqs, "sequences")
    taken = (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int")
    heads = seqs.where(F.col("conv_id") % EVERY == 0).select(
        F.col("conv_id").alias("head_id"), *(F.slice(c, 1, SHARED - 1).alias(f"head_{c}") for c in ("digests", "sizes")))
    joined = seqs.withColumn("head_id", F.col("conv_id") - F.col("conv_id") % EVERY).join(heads, "head_id", "left")

    def made(column: str, kind: str):
        head = F.coalesce(F.slice(f"head_{column}", F.lit(1), taken), F.array().cast(f"array<{kind}>"))
        own = F.slice(column, taken + 1, F.greatest(F.size(column), F.lit(1)))
        return F.concat(head, own).alias(column)

    return joined.select("conv_id", made("digests", "string"), made("sizes", "bigint"))


class Path:
    """A conversation's digests and, for each depth, the bytes of all texts down to it."""

    __slots__ = ("key", "down")

    def __init__(self, key: bytes, sizes: Iterable[int]) -> None:
        self.key, self.down = key, np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64), dtype=np.int64)])

    def __len__(self) -> int:
        return len(self.key) // WIDTH

    def above(self, low: int, high: int) -> list[int]:
        """Bytes of the texts above each depth from ``low`` to ``high``."""
        return [0, *self.down[:high].tolist()] if low == 0 else self.down[low - 1:high].tolist()


class Edge:
    """Between two neighbours: their common depth, the bytes down to it, whether the left one ends a branch."""

    __slots__ = ("depth", "down", "leaf")

    def __init__(self, left: Path, right: Path) -> None:
        self.depth = shared_depth(left.key, right.key)
        self.down, self.leaf = int(left.down[self.depth]), self.depth < len(left)


def shared_depth(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return (n - (differ.bit_length() + 7) // 8) // WIDTH


class Component:
    """A run of neighbours: the node at ``depth`` on ``path`` that all of them share.

    ``joints`` are the edges of just that depth, ``ends`` the conversations that end there (they come first in the run),
    ``below`` the closed nodes that wait to learn their parent; ``name`` is set once closed nodes know it by name.
    """

    __slots__ = ("path", "depth", "low", "count", "leaves", "saved", "joints", "ends", "ids", "below", "name", "open")

    def __init__(self, path: Path, depth: int, low: int) -> None:
        self.path, self.depth, self.low = path, depth, low
        self.count, self.leaves, self.saved, self.joints, self.ends = 1, 0, 0, 0, 0
        self.ids: list[int] = []
        self.below: list[dict] = []
        self.name: bytes | None = None
        self.open = False

    @classmethod
    def single(cls, path: Path, conv_id: int) -> Component:
        made = cls(path, len(path), conv_id)
        made.ends, made.ids = 1, [conv_id]
        return made


class Forest:
    """Components in order with the edges between them, joined as far as what lies beyond both sides cannot matter."""

    def __init__(self, parts: list[Component], edges: list[Edge], first: Path, last: Path) -> None:
        self.parts, self.edges, self.first, self.last = parts, edges, first, last
        self.closed: list[dict] = []

    def contract(self, whole: bool = False) -> Forest:
        """Union-find over the edges, deepest first. ``whole``: nothing lies beyond, all nodes are closed."""
        parts, edges = self.parts, self.edges
        for part in parts:
            part.open = False
        parts[0].open = parts[-1].open = not whole
        at = list(range(len(parts)))

        def find(i: int) -> int:
            while at[i] != i:
                at[i] = at[at[i]]
                i = at[i]
            return i

        kept = []
        deepest = sorted(range(len(edges)), key=lambda e: -edges[e].depth)
        for depth, same in groupby(deepest, key=lambda e: edges[e].depth):
            reaching = []
            for e in same:
                x, y = find(e), find(e + 1)
                if parts[x].open or parts[y].open:
                    reaching.append(e)
                else:
                    at[y] = x
                    parts[x] = self._join(parts[x], parts[y], edges[e])
            for e in reaching:
                kept.append(e)
                for i, other in ((find(e), find(e + 1)), (find(e + 1), find(e))):
                    if not parts[i].open and parts[other].open:
                        parts[i] = self._raised(parts[i], depth, parts[other].path)
            for e in reaching:
                parts[find(e)].open = parts[find(e + 1)].open = True
        if whole:
            self.closed.append(self._close(parts[find(0)], 0))
            self.parts = self.edges = []
            return self
        self.parts = [parts[i] for i in sorted({find(i) for i in range(len(parts))})]
        self.edges = [edges[e] for e in sorted(kept)]
        self._christen()
        return self

    def _join(self, x: Component, y: Component, edge: Edge) -> Component:
        z = Component(x.path, edge.depth, min(x.low, y.low))
        z.count, z.leaves = x.count + y.count, x.leaves + y.leaves + edge.leaf
        z.saved, z.joints = x.saved + y.saved + edge.down, 1
        for part in (x, y):
            self._take(z, part)
        return z

    def _raised(self, part: Component, depth: int, path: Path) -> Component:
        """A component as part of the node at ``depth`` on ``path``, where an open one meets it."""
        z = Component(path, depth, part.low)
        z.count, z.leaves, z.saved = part.count, part.leaves, part.saved
        self._take(z, part)
        return z

    def _take(self, z: Component, part: Component) -> None:
        if part.depth > z.depth:
            z.below.append(self._close(part, z.depth + 1))
            return
        z.joints += part.joints
        z.ends += part.ends
        z.ids, z.name = z.ids + part.ids if part.ids else z.ids, z.name or part.name
        longer, other = sorted((z.below, part.below), key=len, reverse=True)
        longer.extend(other)
        z.below = longer

    def _close(self, part: Component, low_depth: int) -> dict:
        """The node's record, which waits for its parent; those below it are done."""
        for record in part.below:
            record["parent_low"] = part.low
        self.closed.extend(part.below)
        ends = hashlib.sha256(",".join(map(str, part.ids)).encode()).hexdigest() if part.ids and not part.name else None
        return {
            "low": part.low, "lo": low_depth, "hi": part.depth, "n": part.count, "leaves": part.leaves + 1, "saved": part.saved,
            "children": part.joints - part.ends + 1, "n_ends": part.ends, "ends_sha": ends, "name": part.name,
            "above": part.path.above(low_depth, part.depth) if part.count > 1 else None,
            "parent_low": None, "parent_name": None}

    def _christen(self) -> None:
        """Open components get the digest of their prefix as a name, by which closed nodes and ends find them later."""
        for path in {id(p.path): p.path for p in self.parts}.values():
            digest, done = hashlib.md5(usedforsecurity=False), 0
            for part in sorted((p for p in self.parts if p.path is path), key=lambda p: p.depth):
                digest.update(path.key[done:part.depth * WIDTH])
                done = part.depth * WIDTH
                part.name = digest.digest()
        for part in self.parts:
            for record in part.below:
                record["parent_name"] = part.name
            self.closed.extend(part.below)
            part.below = []

    def ends(self):
        """(name, first id, ids as text) of the conversations that end at open nodes; they leave the forest."""
        for part in self.parts:
            for i in range(0, len(part.ids), IDS):
                yield part.name, part.ids[i], ",".join(map(str, part.ids[i:i + IDS]))
            part.ids = []


def side_by_side(forests: list[Forest]) -> Forest:
    """Neighbouring forests as one, with an edge across each boundary."""
    edges = [[Edge(a.last, b.first)] for a, b in zip(forests, forests[1:])]
    between = chain.from_iterable(chain(f.edges, e) for f, e in zip(forests, [*edges, []]))
    return Forest([p for f in forests for p in f.parts], list(between), forests[0].first, forests[-1].last)


_OUT = pa.schema([
    ("kind", pa.string()), ("low", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("n", pa.int64()), ("leaves", pa.int64()),
    ("saved", pa.int64()), ("children", pa.int64()), ("n_ends", pa.int64()), ("ends_sha", pa.string()), ("name", pa.binary()),
    ("above", pa.list_(pa.int64())), ("parent_low", pa.int64()), ("parent_name", pa.binary()), ("part", pa.int64()),
    ("body", pa.binary())])
_SCHEMA = ("kind string, low long, lo long, hi long, n long, leaves long, saved long, children long, n_ends long, ends_sha string, "
           "name binary, above array<long>, parent_low long, parent_name binary, part long, body binary")


def _written(forest: Forest, part: int):
    """Arrow batches of a contracted forest: closed nodes, ends of open ones, and what is left of it."""
    rows = [{"kind": "ends", "name": name, "low": first, "body": ids.encode()} for name, first, ids in forest.ends()]
    for i in range(0, len(forest.closed), 5000):
        yield pa.RecordBatch.from_pylist([{"kind": "node"} | r for r in forest.closed[i:i + 5000]], _OUT)
    forest.closed = []
    if forest.parts:
        rows.append({"kind": "forest", "part": part, "body": pickle.dumps(forest)})
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _OUT)


def _grow(batches):
    """The forest of one range, whose conversations come in order."""
    ids, paths, part = [], [], None
    for batch in batches:
        if batch.num_rows:
            part = batch.column("part")[0].as_py()
        ids += batch.column("conv_id").to_pylist()
        paths += [Path(k, s) for k, s in zip(batch.column("key").to_pylist(), batch.column("sizes").to_pylist())]
    if paths:
        edges = [Edge(a, b) for a, b in zip(paths, paths[1:])]
        forest = Forest([Component.single(p, i) for p, i in zip(paths, ids)], edges, paths[0], paths[-1])
        yield from _written(forest.contract(), part)


def _merge(whole: bool):
    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        forest = side_by_side([pickle.loads(b) for b in table.column("body").to_pylist()])
        batches = _written(forest.contract(whole), table.column("part")[0].as_py() // FAN)
        return pa.Table.from_batches(list(batches), _OUT)

    return merge


def _digest_ends(batches):
    """SHA-256 of the ids of each name, which come in order in one or more texts: one running digest at a time."""
    name, digest = None, None

    def done():
        return pa.RecordBatch.from_arrays(
            [pa.array([name], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["name", "sha"])

    for batch in batches:
        for key, body in zip(batch.column("name").to_pylist(), batch.column("body").to_pylist()):
            if key == name:
                digest.update(b",")
            else:
                if digest:
                    yield done()
                name, digest = key, hashlib.sha256()
            digest.update(body)
    if digest:
        yield done()


def prefix_trie(seqs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per distinct prefix of the sequences: ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (what sharing saves in its subtree) and ``ends_sha256`` of the ids that end there."""
    spark = seqs.sparkSession
    keyed = stored(seqs.select(
        "conv_id", F.unhex(F.array_join("digests", "")).alias("key"), "sizes"), "trie-keys")
    total = keyed.select(F.sum(F.octet_length("key") + WIDTH)).first()[0] or 0
    n = pieces(total, range_bytes, spark.sparkContext.defaultParallelism)
    ranges = (keyed.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
              .withColumn("part", F.spark_partition_id().cast("long")))
    level = stored(ranges.mapInArrow(_grow, _SCHEMA), "trie-ranges")
    levels = [level]
    n = (level.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        whole = n <= FAN
        forests = level.where("kind = 'forest'").select("part", "body")
        grouped = forests.groupBy(F.floor(F.col("part") / FAN).alias("block")).applyInArrow(_merge(whole), _SCHEMA)
        level = stored(grouped, "trie-round")
        levels.append(level)
        n = pieces(n, FAN)
        if whole:
            break
    rows = reduce(DataFrame.unionByName, levels)
    return _written_out(rows, levels[0])


def _written_out(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    nodes = rows.where("kind = 'node'").drop("kind", "part", "body")
    # What stayed open somewhere is known by name: a few nodes for each range.
    named = stored(nodes.where("name IS NOT NULL").select("name", F.col("low").alias("named_low")), "trie-names")
    ends = ranges.where("kind = 'ends'").select("name", "low", "body")
    digests = stored(ends.repartition("name").sortWithinPartitions("name", "low").mapInArrow(
        _digest_ends, "name binary, sha string"), "trie-ends")
    waiting = nodes.where("parent_name IS NOT NULL").join(
        small(named.withColumnRenamed("name", "parent_name")), "parent_name", "left")
    settled = nodes.where("parent_name IS NULL").withColumn("named_low", F.lit(None).cast("long"))
    found = waiting.unionByName(settled).withColumn("parent_low", F.coalesce("parent_low", "named_low"))
    unnamed = found.where("name IS NULL").withColumn("sha", F.col("ends_sha"))
    found = found.where("name IS NOT NULL").join(small(digests), "name", "left").unionByName(unnamed)
    each = found.select("*", F.posexplode(F.sequence("lo", "hi")).alias("step", "depth"))
    last, first = F.col("depth") == F.col("hi"), F.col("depth") == F.col("lo")
    return each.select(
        F.col("low").alias("conv_id"), "depth",
        F.when(first, F.col("parent_low")).otherwise(F.col("low")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.when(F.col("n") > 1, F.col("saved") - (F.col("n") - 1) * F.get("above", F.col("step"))).otherwise(F.lit(0)).cast(
            "long").alias("saved_tokens"),
        F.when(last & (F.col("n_ends") > 0), F.col("sha")).otherwise(F.lit(NOTHING)).alias("ends_sha256"))
