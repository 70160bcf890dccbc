"""Exact top-k by integer inner product, with bounds from segment statistics at several resolutions.

Components become whole numbers, floor(256 x). For queries q and candidates v cut into segments of equal length l,
with means m and deviations s in each, the squared distance is at least the sum over segments of
l ((mq - mv)^2 + (sq - sv)^2). Scores follow from distances, q.v = (|q|^2 + |v|^2 - d^2) / 2, so a lower bound of a distance
is an upper bound of a score. Bounds go from one segment to finer ones; a candidate leaves as soon as its bound is
below the k-th best exact score that its query has so far. Survivors get exact integer scores. Equal bounds
stay, so ties are complete.

Vectors are dealt by a hash into blocks of candidates and of queries, each pair of blocks is one group: block nested,
with bounded groups whatever repeats. A block of queries is as large as a task can hold, so that candidates are copied as seldom as
can be; within a task, queries are taken ``QUERY_TILE`` at a time. Every group keeps k per query; the groups' bests are merged by key.

Results: vectors that are null or hold null or non-finite components take no part; vectors of different lengths are not
compared. A query's own row is no candidate; other rows of its id are, and repeated ids each count. Rows without id are
candidates with a null id that loses ties; they are no queries. A k above the number of candidates gives all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanwise.llm.common import pieces, stored

SCALE = 256
SEGMENTS = (1, 4, 16)
CANDIDATES = 8_192
QUERIES = 8_192
TILE, FIRST_TILE, QUERY_TILE = 1_024, 64, 512
PAIRS = 50_000
LAST = np.iinfo(np.int64).max


def whole_numbers(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Valid vectors with whole components: ``row``, ``vec_id``, ``dim``, ``v`` (array of long)."""
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (df.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"),
                      F.col(vector).cast("array<double>").alias("v"))
            .where(F.col("v").isNotNull() & finite)
            .select("row", "vec_id", F.size("v").alias("dim"),
                    F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v")))


def _statistics(v: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means and deviations of segments, each times the root of its length, and the rest that no segment holds."""
    length = v.shape[1] // segments
    held = v[:, :length * segments].reshape(len(v), segments, length)
    return held.mean(2) * length ** 0.5, held.std(2) * length ** 0.5, v[:, length * segments:]


def _bound(q: tuple, v: tuple) -> np.ndarray:
    """Upper bounds of the scores: by segment, means multiply, and deviations as if wholly in step."""
    return q[0] @ v[0].T + q[1] @ v[1].T + q[2] @ v[2].T


def _scores(q: np.ndarray, v: np.ndarray, a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of the rows a of q with the rows b of v: one product of matrices where most pairs are wanted."""
    if exact and 8 * len(a) > len(q) * len(v):
        return (q.astype(np.float64) @ v.astype(np.float64).T)[a, b].astype(np.int64)
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), PAIRS):
        some = slice(at, at + PAIRS)
        out[some] = np.einsum("ij,ij->i", q[a[some]], v[b[some]])
    return out


def best(q_rows, q, v_rows, v_ids, v, k: int):
    """The k best of each query among the candidates: query places, candidate places, scores."""
    dim = q.shape[1]
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(dim, 1)
    exact = largest < 2**52  # then doubles hold every sum
    order = np.argsort(v_ids, kind="stable")  # so that of equal scores the first has the smaller id
    levels = [s for s in SEGMENTS if s <= dim]
    q_stats = [_statistics(q.astype(np.float64), s) for s in levels]
    slack = 1e-9 * (1 + largest)  # of rounding in the bounds
    top_scores = np.full((len(q), k), np.iinfo(np.int64).min, np.int64)
    top_places = np.full((len(q), k), -1, np.int64)
    # A first small tile gives every query a floor to measure the bounds of the others against.
    for first in [0, *range(FIRST_TILE, len(order), TILE)]:
        places = order[first:first + (TILE if first else FIRST_TILE)]
        tile = v[places]
        enough = top_places[:, -1] >= 0
        floor = np.where(enough, top_scores[:, -1].astype(np.float64), -np.inf)
        alive = q_rows[:, None] != v_rows[places][None, :]
        for level, stats in zip(levels, q_stats):
            some = np.flatnonzero(alive.any(1))
            if not len(some):
                break
            bound = _bound(tuple(x[some] for x in stats), _statistics(tile.astype(np.float64), level))
            alive[some] &= bound + slack >= floor[some, None]
        a, b = np.nonzero(alive)
        if not len(a):
            continue
        scores = _scores(q, tile, a, b, exact)
        keep = scores > np.where(enough, top_scores[:, -1], np.iinfo(np.int64).min)[a]
        keep |= ~enough[a]
        a, scores, found = a[keep], scores[keep], places[b[keep]]
        if not len(a):
            continue
        changed = np.unique(a)
        all_a = np.concatenate([np.repeat(changed, k), a])
        all_s = np.concatenate([top_scores[changed].ravel(), scores])
        all_p = np.concatenate([top_places[changed].ravel(), found])
        rank = np.full(len(v), LAST)
        rank[order] = np.arange(len(order))
        ties = np.where(all_p >= 0, rank[all_p], LAST)
        by = np.lexsort((ties, -all_s, all_p < 0, all_a))
        all_a, all_s, all_p = all_a[by], all_s[by], all_p[by]
        starts = np.searchsorted(all_a, changed)
        picks = starts[:, None] + np.arange(k)[None, :]
        top_scores[changed], top_places[changed] = all_s[picks], all_p[picks]
    at, rank = np.nonzero(top_places >= 0)
    return at, top_places[at, rank], top_scores[at, rank]


def _matrix(table: pa.Table) -> np.ndarray:
    lists = table.column("v").combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1) if table.num_rows else np.empty((0, 0), np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """For every row of ``whole_numbers`` that is a query: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``."""
    vectors = stored(vectors, "vectors")
    queries = vectors.where(is_query & F.col("vec_id").isNotNull())
    n, n_queries = vectors.count(), queries.count()
    blocks, query_blocks = pieces(n, CANDIDATES), pieces(n_queries, QUERIES)

    def dealt(df, count):
        return F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")

    def every(count):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = queries.withColumn("query_block", dealt(queries, query_blocks)).withColumn("block", every(blocks))
    right = vectors.withColumn("block", dealt(vectors, blocks)).withColumn("query_block", every(query_blocks))
    key = ["dim", "query_block", "block"]
    names = ["query_row", "query_id", "vec_id", "score"]

    def search(q: pa.Table, v: pa.Table) -> pa.Table:
        q_ids = q.column("vec_id").to_numpy()
        v_ids = np.array([LAST if i is None else i for i in v.column("vec_id").to_pylist()], np.int64)
        q_rows, v_rows = q.column("row").to_numpy(), v.column("row").to_numpy()
        found = []
        if q.num_rows and v.num_rows:
            queries, candidates = _matrix(q), _matrix(v)
            for first in range(0, len(queries), QUERY_TILE):
                some = slice(first, first + QUERY_TILE)
                at, place, score = best(q_rows[some], queries[some], v_rows, v_ids, candidates, k)
                found.append((at + first, place, score))
        at, place, score = (np.concatenate([np.empty(0, np.int64), *of]) for of in (zip(*found) if found else ((), (), ())))
        ids = v.column("vec_id").combine_chunks().take(pa.array(place))
        return pa.Table.from_arrays([pa.array(q_rows[at]), pa.array(q_ids[at]), ids, pa.array(np.asarray(score, np.int64))], names)

    schema = "query_row long, query_id long, vec_id long, score long"
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, schema)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
