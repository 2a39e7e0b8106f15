"""Connected components of a table of links, without collecting them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotlog.llm._common import mapped, written


#: Links that one task contracts at most (two longs each); more go by rounds.
SMALL_LINKS = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links as links to the smallest node that they reach there."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(x, r) for x in parent if (r := root(x)) != x]
    for i in range(0, len(pairs), 50_000):
        part = pairs[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of every linked node; the component is its smallest id.

    ``links`` has two columns of longs.  Partitions are contracted where they
    lie.  If no more than ``SMALL_LINKS`` are left, counted first, one task
    contracts them; otherwise large-star and small-star steps alternate until
    nothing changes: a number of rounds that grows with the logarithm of the
    longest chain.  Each round is written to the shared folder; only a row of
    sums reaches the driver.
    """
    a, b = links.columns
    edges = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = written(mapped(edges, _contract, "u long, v long").distinct(), "links")
    if edges.count() <= SMALL_LINKS:
        stars = mapped(edges.repartition(1), _contract, "u long, v long").withColumnsRenamed({"u": "id", "v": "component"})
        return stars.union(stars.select(F.col("component").alias("id"), "component").distinct())

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first())

    before = mark(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        after = mark(edges)
        if after == before:
            break
        before = after
    stars = edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("id"), "component").distinct())
