"""Traversal of the graph that link events form.

``links`` has ``src_ref, edge_type, dst_ref, version, created_at_nanos,
lifecycle``, one row per version, as a DataFrame or as an ``EdgeIndex``, which
keeps it stored in order of either end.  A hop first keeps the versions that
touch the frontier, by literals in the scan while the frontier is small, by a
broadcast where it was counted, by an exchange beyond; only of those is the
active version of each triple picked.  References are part of a triple, so that
changes nothing and no hop aggregates the whole graph.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotlog.operators.eventlog import latest
from knotlog.sources.scratch import scratch_path, written

TRIPLE = ["src_ref", "edge_type", "dst_ref"]
DEFAULT_DEPTH = 5
VISITED_CAP = 10_000
#: Frontier rows that are broadcast at most, and that the driver holds at most.
BROADCAST_ROWS, LITERALS = 200_000, 300


@dataclass
class EdgeIndex:
    """All link versions twice: in order of the source and in order of the target."""

    forward: DataFrame
    reverse: DataFrame

    @property
    def sparkSession(self) -> SparkSession:  # noqa: N802  as a DataFrame has it
        return self.forward.sparkSession

    @classmethod
    def build(cls, links: DataFrame, path: str | None = None) -> EdgeIndex:
        """Stores ``links`` in a new folder (of the scratch space if none is named)."""
        spark, path = links.sparkSession, path or scratch_path(links.sparkSession, "edges")
        held = written(links, "links")
        for name, side, other in (("forward", "src_ref", "dst_ref"), ("reverse", "dst_ref", "src_ref")):
            # sorted files: literals of a frontier skip what cannot hold them; by the other end too, so a hub is many ranges
            held.orderBy(side, "edge_type", other).write.parquet(f"{path}/{name}")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> EdgeIndex:
        """The index of a folder."""
        return cls(spark.read.parquet(f"{path}/forward"), spark.read.parquet(f"{path}/reverse"))

    @staticmethod
    def of(links: DataFrame | EdgeIndex) -> EdgeIndex:
        """``links`` itself, or a DataFrame for both ends."""
        return links if isinstance(links, EdgeIndex) else EdgeIndex(links, links)

    def touching(self, way: str, near: DataFrame, rows: int, refs: list[str] | None) -> DataFrame:
        """Versions whose near end (``f``: source, ``r``: target) is an ``a`` of ``near``."""
        side, links = ("src_ref", self.forward) if way == "f" else ("dst_ref", self.reverse)
        if refs is not None:
            return links.where(F.col(side).isin(refs))
        own = near.select(F.col("a").alias(side)).distinct()
        ends = own.agg(F.min(side), F.max(side)).first()
        links = links.where(F.col(side).between(*ends))  # other kinds of references go before any exchange
        return links.join(F.broadcast(own) if rows <= BROADCAST_ROWS else own, side, "left_semi")


def active_links(links: DataFrame, as_of_nanos: int | None = None, edge_types: list[str] | None = None) -> DataFrame:
    """The active version of each triple; superseded ones are hidden, historical ones not.

    With a time, the highest version not newer than it is the active one.
    """
    if edge_types:  # part of the key, so it may go first
        links = links.where(F.col("edge_type").isin(edge_types))
    if as_of_nanos is not None:
        links = links.where(F.col("created_at_nanos") <= as_of_nanos)
    return latest(links, TRIPLE).where("lifecycle IS NULL OR lifecycle <> 'superseded'")


def _ways(direction: str) -> list[str]:
    ways = {"forward": ["f"], "reverse": ["r"], "both": ["f", "r"]}
    if direction not in ways:
        raise ValueError(f"direction {direction!r}")
    return ways[direction]


def _held(df: DataFrame, label: str) -> tuple[DataFrame, int, list[str] | None]:
    """A frontier that is not computed again, its rows, and its references if they are few.

    Up to ``LITERALS`` rows stay with the driver, more go to the shared folder.
    """
    some = df.limit(LITERALS + 1).collect()
    if len(some) <= LITERALS:
        return df.sparkSession.createDataFrame(some, df.schema), len(some), sorted({r["ref"] for r in some if r["ref"] is not None})
    kept = written(df, label)
    return kept, kept.count(), None


def _hop(index: EdgeIndex, ways: list[str], frontier: DataFrame, rows: int, refs: list[str] | None, as_of_nanos: int | None, edge_types: list[str] | None) -> DataFrame:
    """``frontier`` (``start, way, ref, rank``) joined with its active edges: ``start, way, ref, rank, edge_type``."""
    out = None
    for way in ways:
        near = frontier.where(F.col("way") == way).select("start", "way", F.col("ref").alias("a"), "rank")
        active = active_links(index.touching(way, near, rows, refs), as_of_nanos, edge_types)
        here, there = ("src_ref", "dst_ref") if way == "f" else ("dst_ref", "src_ref")
        found = active.join(F.broadcast(near) if rows <= BROADCAST_ROWS else near, F.col(here) == F.col("a")).select("start", "way", F.col(there).alias("ref"), "rank", "edge_type")
        out = found if out is None else out.unionByName(found)
    return out


def neighbors(links: DataFrame | EdgeIndex, start: DataFrame, direction: str = "forward", edge_types: list[str] | None = None, as_of_nanos: int | None = None) -> DataFrame:
    """``start, ref``: distinct one-hop neighbours of each ``ref`` of ``start``."""
    ways = _ways(direction)
    first = start.select(F.col("ref").alias("start"), F.explode(F.array(*[F.lit(w) for w in ways])).alias("way"), "ref", F.lit(0).cast("long").alias("rank")).distinct()
    frontier, rows, refs = _held(first, "starts")
    return _hop(EdgeIndex.of(links), ways, frontier, rows, refs, as_of_nanos, edge_types).select("start", "ref").distinct()


def reachable(
    links: DataFrame | EdgeIndex,
    start: DataFrame,
    depth: int = DEFAULT_DEPTH,
    direction: str = "forward",
    edge_types: list[str] | None = None,
    as_of_nanos: int | None = None,
    cap: int | None = VISITED_CAP,
) -> DataFrame:
    """``start, ref, depth, capped``: what each start reaches within ``depth`` hops.

    ``both`` is what is reached forward and what is reached in reverse; a way
    never mixes directions.  A start is not reached by itself.  With a ``cap``,
    references are visited breadth first, those of one reference in order of
    edge type and name; a start (counted once for each way) that would visit
    more than ``cap`` stops there, with what it visited, and is marked.  Each
    level is held or written to the shared folder; only counts and small
    frontiers reach the driver.
    """
    depth, ways, index = depth or DEFAULT_DEPTH, _ways(direction), EdgeIndex.of(links)
    first = start.select(F.col("ref").alias("start"), F.posexplode(F.array(*[F.lit(w) for w in ways])).alias("rank", "way"), "ref").distinct()
    first = first.select("start", "way", "ref", F.col("rank").cast("long").alias("rank"), F.lit(False).alias("extra"), F.lit(0).cast("long").alias("depth"))
    frontier, rows, refs = _held(first, "level0")
    levels = [frontier]
    for level in range(1, depth + 1):
        found = _hop(index, ways, frontier, rows, refs, as_of_nanos, edge_types).groupBy("start", "way", "ref").agg(F.min(F.struct("rank", "edge_type")).alias("via"))
        known = levels[0].select("start", "way", "ref")
        for x in levels[1:]:
            known = known.unionByName(x.select("start", "way", "ref"))
        found = found.join(known, ["start", "way", "ref"], "left_anti")
        if cap is None:
            found = found.select("start", "way", "ref", F.lit(0).cast("long").alias("rank"), F.lit(False).alias("extra"))
        else:
            order = Window.partitionBy("start").orderBy("via.rank", "via.edge_type", "ref")
            visited = known.groupBy("start").agg(F.count("*").alias("visited"))
            ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= cap + 1).join(visited, "start")
            room = F.lit(cap) - F.col("visited")
            found = ranked.where(F.col("rank") <= room + 1).select("start", "way", "ref", "rank", (F.col("rank") > room).alias("extra"))
        frontier, rows, refs = _held(found.withColumn("depth", F.lit(level).cast("long")), f"level{level}")
        levels.append(frontier)
        if not rows or level == depth:
            break
        if cap is not None:  # who is over the cap goes no further
            frontier = frontier.join(frontier.where("extra").select("start"), "start", "left_anti")
    reached = levels[0].where("false")
    for x in levels[1:]:
        reached = reached.unionByName(x)
    over = reached.groupBy("start").agg(F.max("extra").alias("capped"))
    out = reached.where("NOT extra AND ref <> start").groupBy("start", "ref").agg(F.min("depth").alias("depth"))
    if cap is None:
        return out.withColumn("capped", F.lit(False))
    return out.join(over, "start").select("start", "ref", "depth", "capped")


def impact_radius(links: DataFrame | EdgeIndex, start: DataFrame, depth: int = DEFAULT_DEPTH, **more) -> DataFrame:
    """What reaches each start: the reverse closure."""
    return reachable(links, start, depth, "reverse", **more)
