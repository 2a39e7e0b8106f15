"""Approximate nearest neighbours by stable projections and a kd-tree (operator 9).

Vectors are projected to a few dimensions with a 2-stable (Gaussian) matrix, so
squared projected distance over squared distance follows a chi-square law.  A
kd-tree orders the projected points.  For a query, leaves come in order of
projected distance and their points are verified on the original vectors; the
search ends when the chi-square test says that a nearer neighbour would, with
probability ``SURE``, have been met already.

Scale: every row is indexed.  Rows are dealt by hash into blocks of about
``BLOCK_ROWS``, each with a tree of its own; queries travel in packs of about
``PACK`` to each block, and a partition streams them past one tree at a time,
so a task holds one block and one pack.  Work is the stated query set against
all rows, in blocks.  Each block returns at most ``k`` rows for a query, which
a group limit reduces before they meet.

Defined cases: a vector that is null, zero, or holds a null or non-finite
component takes no part; only vectors of a query's length are its candidates;
each repeated row is a candidate; of several rows with a query's id one (the
smallest vector) asks; rows with a query's own id are no candidates of it;
null ids take no part; ties in distance go to the smaller id; an empty table
gives an empty result; other columns are not looked at.  A block holds its
vectors once as numbers of 8 bytes: very long vectors want smaller blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotlog.llm._common import table

DIMS = 10
SURE = 0.97
LEAF = 64
BLOCK_ROWS = 8192
PACK = 512


def chi_square_quantile(dof: int, p: float) -> float:
    """``x`` with chi-square CDF ``p``; ``dof`` even."""
    def cdf(x: float) -> float:
        term = total = 1.0
        for i in range(1, dof // 2):
            term *= x / 2 / i
            total += term
        return 1 - np.exp(-x / 2) * total

    low, high = 0.0, 10.0 * dof + 100
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


class Block:
    """A kd-tree over projected points, with the original vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, dims: int = DIMS, leaf: int = LEAF, seed: int = 3):
        self.matrix = np.random.default_rng(seed).standard_normal((vectors.shape[1], dims))
        points = vectors @ self.matrix
        order: list[np.ndarray] = []
        todo = [np.arange(len(ids))]
        while todo:  # ties are dealt to both halves, so equal points end in small leaves too
            part = todo.pop()
            if len(part) <= leaf:
                order.append(part)
                continue
            own = points[part]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            half = np.argpartition(own[:, axis], len(part) // 2)
            todo += [part[half[: len(part) // 2]], part[half[len(part) // 2 :]]]
        at = np.concatenate(order)
        self.ids, self.vectors, self.points = ids[at], vectors[at], points[at]
        self.bounds = np.cumsum([0, *map(len, order)])
        self.low = np.minimum.reduceat(self.points, self.bounds[:-1], axis=0)
        self.high = np.maximum.reduceat(self.points, self.bounds[:-1], axis=0)

    def search(self, own: int, vector: np.ndarray, k: int, stop: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the ``k`` nearest found, nearest first."""
        point = vector @ self.matrix
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        near = (gap * gap).sum(axis=1)
        ids, dist = np.zeros(0, np.int64), np.zeros(0)
        limit = np.inf
        for leaf in np.argsort(near, kind="stable"):
            if near[leaf] > limit * (1 + 1e-9) + 1e-12:
                break
            a, b = self.bounds[leaf], self.bounds[leaf + 1]
            away = self.points[a:b] - point
            pick = np.flatnonzero((((away * away).sum(axis=1)) <= limit * (1 + 1e-9) + 1e-12) & (self.ids[a:b] != own)) + a
            if not len(pick):
                continue
            diff = self.vectors[pick] - vector
            ids = np.concatenate([ids, self.ids[pick]])
            dist = np.concatenate([dist, np.sqrt((diff * diff).sum(axis=1))])
            if len(ids) > k:
                best = np.lexsort((ids, dist))[:k]
                ids, dist = ids[best], dist[best]
            if len(ids) == k:
                limit = stop * dist.max() ** 2
        best = np.lexsort((ids, dist))
        return ids[best], dist[best]


def usable(vector: Column) -> Column:
    """Whether a vector can take part."""
    d = vector.cast("array<double>")
    odd = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~odd & F.exists(d, lambda x: x != 0), F.lit(False))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding", sure: float = SURE) -> DataFrame:
    """``query_id, rank, id, score`` of each query's ``k`` nearest rows found."""
    data = rows.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    asked = queries.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-data.count() // BLOCK_ROWS))
    packs = max(1, -(-asked.count() // PACK))
    none = F.lit(None).cast("array<struct<id:bigint,v:array<double>>>")
    # the running number keeps rows that repeat one id from landing in one block
    dealt = data.select(F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).alias("block"), F.lit(0).alias("kind"), "id", "v", none.alias("q"))
    packed = asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(packs)).alias("pack")).agg(F.collect_list(F.struct("id", "v")).alias("q"))
    sent = packed.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(1).alias("kind"), F.col("pack").alias("id"), F.lit(None).cast("array<double>").alias("v"), "q")
    stop = chi_square_quantile(DIMS, sure)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, vecs, trees = None, [], [], None
        for batch in batches:
            for b, kind, i, v, q in zip(*[batch.column(c).to_pylist() for c in ("block", "kind", "id")], *[batch.column(c) for c in ("v", "q")], strict=True):
                if b != block:
                    block, ids, vecs, trees = b, [], [], None
                if kind == 0:
                    ids.append(i)
                    vecs.append(v.values.to_numpy(zero_copy_only=False))
                    continue
                if trees is None:
                    sizes = {}
                    for at, x in enumerate(vecs):
                        sizes.setdefault(len(x), []).append(at)
                    trees = {n: Block(np.array([ids[x] for x in at], np.int64), np.stack([vecs[x] for x in at])) for n, at in sizes.items()}
                    ids, vecs = [], []
                out: list[tuple] = []
                for item in q.values:
                    own, vec = item["id"].as_py(), item["v"].values.to_numpy(zero_copy_only=False)
                    if len(vec) in trees:
                        found, dist = trees[len(vec)].search(own, vec, k, stop)
                        out += [(own, a, c) for a, c in zip(found.tolist(), dist.tolist(), strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "id", "score"])

    # by range: each block is a task of its own, where hashes of a few block numbers would meet
    found = dealt.unionByName(sent).repartitionByRange(blocks, "block").sortWithinPartitions("block", "kind", "id").mapInArrow(run, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id), "score")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest rows of every vector whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % 100 == 0))
