"""Nearest neighbours by cosine: a vantage-point tree in each shard.

Rows are dealt to shards of about SHARD rows by a hash of their id. A shard's tree lies
in its rows' order: a node's first row is its vantage point, the nearer half of its rows
follows, then the farther half, and beside the vantage point stand the least and greatest
distance of each half. Distances are chords between unit vectors, which obey the triangle
inequality and order pairs as cosines do. A search goes down with all queries of a block
at once, nearer side first, and skips a half whose nearest possible distance exceeds
`factor` times the distance of the worst neighbour so far: factor 1 is exact, a smaller
one skips more. Every shard sees every query block, and the best of each shard meet per
query.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components,
and rows without id, take no part; vectors of another length are no candidates; a row is
not its own candidate, but others with its id are, and each row of a repeated query id is a
query of its own; ties go to the smaller id; an empty table, or one without queries, gives
no rows; other columns aren't read and may have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, ship

SHARD = 8192
LEAF = 256
#: Queries searched at a time in a shard.
BLOCK = 2048
#: Below 1 a search skips more and may miss neighbours; the README has recalls.
FACTOR = 1.0
NEIGHBOURS = 5
#: Rounding allowed in distances.
SLACK = 1e-9


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(key).alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    raw = column.flatten().to_numpy(zero_copy_only=False)
    out = raw.reshape(n, -1).astype(np.float64)
    top = np.abs(out).max(axis=1)
    far = (top > 1e100) | (top < 1e-100)
    if far.any():  # by a power of two, which changes no cosine
        out[far] = np.ldexp(out[far], -np.frexp(top[far])[1][:, None])
    return out


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each pair's cosine in double precision, computed alike wherever the pair stands."""
    norms = lambda m: np.sqrt(np.einsum("nd,nd->n", m, m))
    return np.einsum("qd,nd->qn", a, b) / (norms(a)[:, None] * norms(b)[None, :])


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def _halves(start: int, end: int) -> int:
    return start + 1 + (end - start - 1) // 2


def tree_order(vectors: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """The rows' order in the tree, and for each place the bounds (near least, near most, far least, far most), NaN at leaves."""
    order, bounds = np.arange(len(vectors)), np.full((len(vectors), 4), np.nan)
    todo = [(0, len(vectors))]
    while todo:
        start, end = todo.pop()
        if end - start <= leaf:
            continue
        rest = order[start + 1 : end]
        d = chord(cosines(vectors[order[start]][None], vectors[rest])[0])
        by = np.argsort(d, kind="stable")
        order[start + 1 : end], d = rest[by], d[by]
        mid = _halves(start, end)
        cut = mid - start - 1
        bounds[start] = d[0], d[cut - 1], d[cut], d[-1]
        todo += [(start + 1, mid), (mid, end)]
    return order, bounds


class Search:
    """Queries against one shard's tree."""

    def __init__(self, ids, uids, vectors, bounds, query_uids, queries, k: int, factor: float, leaf: int = LEAF):
        self.ids, self.uids, self.vectors, self.bounds, self.leaf = ids, uids, vectors, bounds, leaf
        self.query_uids, self.queries, self.factor = query_uids, queries, factor
        self.score = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.visit(0, len(ids), np.arange(len(queries)))

    def offer(self, start: int, end: int, active: np.ndarray) -> np.ndarray:
        c = cosines(self.queries[active], self.vectors[start:end])
        mine = np.where(self.uids[None, start:end] == self.query_uids[active][:, None], -np.inf, c)
        better = mine.max(axis=1) >= self.score[active, -1]
        rows = active[better]
        if len(rows):
            score = np.concatenate((self.score[rows], mine[better]), axis=1)
            found = np.concatenate((self.found[rows], np.broadcast_to(self.ids[start:end], (len(rows), end - start))), axis=1)
            found = np.where(score == -np.inf, np.iinfo(np.int64).max, found)
            best = np.lexsort((found, -score), axis=1)[:, : self.score.shape[1]]
            self.score[rows] = np.take_along_axis(score, best, axis=1)
            self.found[rows] = np.take_along_axis(found, best, axis=1)
        return c

    def reach(self, active: np.ndarray) -> np.ndarray:
        worst = self.score[active, -1]
        return np.where(worst == -np.inf, np.inf, self.factor * chord(np.where(worst == -np.inf, 0, worst)) + SLACK)

    def visit(self, start: int, end: int, active: np.ndarray) -> None:
        if end - start <= self.leaf or not len(active):
            if len(active) and end > start:
                self.offer(start, end, active)
            return
        d = chord(self.offer(start, start + 1, active)[:, 0])
        mid = _halves(start, end)
        near_low, near_high, far_low, far_high = self.bounds[start]
        near, far = np.maximum(d - near_high, near_low - d), np.maximum(d - far_high, far_low - d)
        first = near <= far
        for own, low, span in ((first, near, (start + 1, mid)), (~first, far, (mid, end)), (first, far, (mid, end)), (~first, near, (start + 1, mid))):
            rows, least = active[own], low[own]
            self.visit(*span, rows[least <= self.reach(rows)])


def _build(keys: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    group = group.sort_by("vec_id")
    order, bounds = tree_order(_matrix(group.column("v")))
    group = group.take(pa.array(order)).append_column("at", pa.array(np.arange(len(order))))
    return group.append_column("bounds", pa.array(list(bounds), pa.list_(pa.float64())))


def build_index(rows: DataFrame, shards: int) -> DataFrame:
    """(dim, shard, vec_id, v, at, bounds, uid): every row of rows (vec_id, v) at its place in its shard's tree; written."""
    ship(rows.sparkSession)
    dealt = rows.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "v")
    schema = "dim int, shard int, vec_id long, v array<double>, at long, bounds array<double>"
    return saved(dealt.groupBy("dim", "shard").applyInArrow(_build, schema).withColumn("uid", F.monotonically_increasing_id()), "vptree")


def _search(k: int, factor: float):
    def run(queries: pa.Table, index: pa.Table) -> pa.Table:
        schema = pa.schema([("query_uid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not index.num_rows or not queries.num_rows:
            return schema.empty_table()
        index = index.sort_by("at")
        bounds = np.array(index.column("bounds").to_pylist(), dtype=np.float64)
        ids, uids = queries.column("vec_id").to_numpy(), queries.column("uid").to_numpy()
        s = Search(index.column("vec_id").to_numpy(), index.column("uid").to_numpy(), _matrix(index.column("v")), bounds, uids, _matrix(queries.column("v")), k, factor)
        hit = s.score > -np.inf
        n = hit.sum(axis=1)
        return pa.Table.from_arrays([pa.array(np.repeat(uids, n)), pa.array(np.repeat(ids, n)), pa.array(s.found[hit]), pa.array(s.score[hit])], schema=schema)

    return run


def search(index: DataFrame, shards: int, queries: DataFrame, k: int = NEIGHBOURS, factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries (uid, vec_id, v); uid tells the index's row that a query is."""
    ship(index.sparkSession)
    blocks = max(1, math.ceil(queries.count() / BLOCK))
    asked = queries.select(
        F.size("v").alias("dim"),
        F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        "uid",
        "vec_id",
        "v",
    )
    trees = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else index.withColumn("block", F.lit(0))
    on = ["dim", "shard", "block"]
    best = asked.groupBy(*on).cogroup(trees.groupBy(*on)).applyInArrow(_search(k, factor), "query_uid long, query_id long, vec_id long, score double")
    ranked = best.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_uid ORDER BY score DESC, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, every: int, k: int = NEIGHBOURS, factor: float = FACTOR, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """The k nearest rows of each row whose id is divisible by `every`."""
    ready = usable(rows, key, vector)
    shards = max(1, math.ceil(ready.count() / shard))
    index = build_index(ready, shards)
    queries = index.where(F.col("vec_id") % every == 0).select("uid", "vec_id", "v")
    return search(index, shards, queries, k, factor)


def op8_vptree(spark, sf_dir) -> DataFrame:
    from .common import table

    return nearest(table(spark, sf_dir, "embeddings"), 50).select("query_id", "rank", "vec_id", "score")
