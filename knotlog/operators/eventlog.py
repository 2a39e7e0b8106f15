"""The append-only event log: versions, time travel, history.

Chains are keyed by ``(kind, id)`` and have dense versions from 1.  Everything
that picks one version of each chain is an aggregate with partial results, or a
join on the full key, so one chain with a third of all rows is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotlog.functions.text import escape_id, version_key
from knotlog.schema import PREFIX
from knotlog.sources.scratch import written

CHAIN = ["kind", "id"]
#: Pointers that one task joins, about.
POINTERS_OF_TASK = 500_000


def prefix_of(kind: Column) -> Column:
    """Key prefix of a kind."""
    out = None
    for name, p in PREFIX.items():
        out = F.when(kind == name, F.lit(p)) if out is None else out.when(kind == name, F.lit(p))
    return out


def append(log: DataFrame | None, new: DataFrame, order: list[Column]) -> DataFrame:
    """``new`` with ``version``, ``supersedes`` and defaults, as rows to append.

    ``new`` has the log's columns but those two; a null lifecycle is ``active``.
    Versions go on from the log's highest of each chain, in ``order``.
    """
    w = Window.partitionBy(*CHAIN).orderBy(*order)
    out = new.withColumn("_n", F.row_number().over(w))
    if log is not None:
        top = log.groupBy(*CHAIN).agg(F.max("version").alias("_top"))
        out = out.join(top, CHAIN, "left")
    else:
        out = out.withColumn("_top", F.lit(None).cast("long"))
    version = (F.coalesce("_top", F.lit(0)) + F.col("_n")).cast("long")
    key = version_key(prefix_of(F.col("kind")), F.col("id"), version - 1)
    return out.withColumns({"lifecycle": F.coalesce("lifecycle", F.lit("active")), "version": version, "supersedes": F.when(version > 1, key)}).drop("_n", "_top")


def append_links(log: DataFrame | None, new: DataFrame, order: list[Column]) -> DataFrame:
    """Links to append (``src_ref, edge_type, dst_ref`` and log columns); a missing part drops the row."""
    whole = new.where("src_ref IS NOT NULL AND edge_type IS NOT NULL AND dst_ref IS NOT NULL")
    id = F.concat_ws(":", escape_id(F.col("src_ref")), escape_id(F.col("edge_type")), escape_id(F.col("dst_ref")))
    shaped = whole.withColumns({"kind": F.lit("link"), "id": id, "link": F.struct("src_ref", "edge_type", "dst_ref")}).drop("src_ref", "edge_type", "dst_ref")
    return append(log, shaped, order)


def append_absent(log: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` whose chain is not in the log (idempotent back-fills)."""
    return new.join(log.select(*CHAIN).distinct(), CHAIN, "left_anti")


def latest(log: DataFrame, keys: list[str] | None = None, version: str = "version") -> DataFrame:
    """Highest version of each chain, whatever its lifecycle."""
    keys = keys or CHAIN
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_x")).select(*keys, "_x.*").select(*log.columns)


def as_of(log: DataFrame, nanos: int, keys: list[str] | None = None, at: str = "created_at_nanos") -> DataFrame:
    """The version of each chain before its first one newer than a time.

    Unlike ``latest`` after a filter, this stops at the first newer version,
    which differs where times are not in order of versions.
    """
    keys = keys or CHAIN
    stop = log.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col(at) > nanos, F.col("version"))) - 1, F.max("version")).alias("version"))
    return log.join(stop.where("version >= 1"), [*keys, "version"]).select(*log.columns)


def as_of_highest(log: DataFrame, nanos: int, keys: list[str] | None = None, at: str = "created_at_nanos") -> DataFrame:
    """The highest version of each chain that is not newer than a time."""
    return latest(log.where(F.col(at) <= nanos), keys)


def history(log: DataFrame, kind: str, id: str) -> DataFrame:
    """All versions of one chain, oldest first."""
    return log.where((F.col("kind") == kind) & (F.col("id") == id)).orderBy("version")


def of_kind(log: DataFrame, kind: str) -> DataFrame:
    """Latest version of every event of a kind, in order of the escaped id."""
    return latest(log.where(F.col("kind") == kind)).orderBy(escape_id(F.col("id")))


def supersedes_chain(log: DataFrame, kind: str, id: str, hops: int = 100) -> DataFrame:
    """Versions reached from the latest by its pointers, with ``hop`` from 0.

    A well-formed chain's pointers lead down one version at a time, so the walk
    is a filter on versions; a row whose pointer is not its predecessor's key is
    marked ``dangling``.
    """
    own = log.where((F.col("kind") == kind) & (F.col("id") == id))
    top = F.max("version").over(Window.partitionBy(*CHAIN))
    expected = F.when(F.col("version") > 1, version_key(prefix_of(F.col("kind")), F.col("id"), F.col("version") - 1))
    out = own.withColumn("hop", (top - F.col("version")).cast("long")).where(F.col("hop") <= hops)
    return out.withColumn("dangling", ~F.col("supersedes").eqNullSafe(expected)).orderBy("hop")


def resolve_supersedes(log: DataFrame, hops: int = 1_000) -> DataFrame:
    """``key, kind, id, version, root, hop, state``: where each version's chain of pointers ends, all chains at once.

    ``key`` is a version's storage key.  ``state`` is ``ok`` (``root`` has no
    pointer), ``dangling`` (a pointer leads to no version; ``root`` is the last
    one reached), ``cycle``, or ``too long`` (over ``hops``; these two have no
    root).  Pointers are doubled in each round, so the rounds grow with the
    logarithm of the longest chain; each is an exchange on keys and is written
    to the shared folder.
    """
    keyed = log.select(version_key(prefix_of(F.col("kind")), F.col("id"), F.col("version")).alias("key"), "kind", "id", "version", F.col("supersedes").alias("to"))
    keyed = written(keyed, "pointers")
    n, span = keyed.count(), 1
    # keys are long and alike: files of them say little of the memory they take, so tasks are dealt by rows, and merged
    parts = max(log.sparkSession.sparkContext.defaultParallelism, n // POINTERS_OF_TASK + 1)
    joined = lambda left, right, on, how="inner": left.repartition(parts, on).join(right.repartition(parts, on).hint("merge"), on, how)
    known = keyed.select(F.col("key").alias("to"), F.lit(True).alias("there"))
    # a pointer into nothing ends its chain where it stands
    walk = joined(keyed.where("to IS NOT NULL").select("key", "to"), known, "to", "left").select("key", F.when(F.col("there"), F.col("to")).alias("to"), F.col("there").isNull().alias("lost"))
    walk = walk.unionByName(keyed.where("to IS NULL").select("key", "to", F.lit(False).alias("lost")))
    walk = walk.select("key", "to", F.coalesce("to", "key").alias("root"), F.when(F.col("to").isNotNull(), 1).otherwise(0).cast("long").alias("hop"), "lost")
    walk = written(walk, "walk")
    while span <= min(hops, n) and not walk.where("to IS NOT NULL").isEmpty():
        # ``to`` is ``span`` pointers ahead, or nothing once the end is reached
        step = walk.select(F.col("key").alias("to"), F.col("to").alias("next"), F.col("root").alias("end"), F.col("hop").alias("more"), F.col("lost").alias("lost_there"))
        ahead = joined(walk.where("to IS NOT NULL").select("key", "to", "hop"), step, "to").select("key", F.col("next").alias("to"), F.col("end").alias("root"), (F.col("hop") + F.col("more")).alias("hop"), F.col("lost_there").alias("lost"))
        walk = written(ahead.unionByName(walk.where("to IS NULL")), "walk")
        span *= 2
    open_end = F.col("to").isNotNull()
    # a walk of more pointers than there are versions has met one twice
    state = F.when(open_end & (F.col("hop") >= n), "cycle").when(open_end | (F.col("hop") > hops), "too long").when(F.col("lost"), "dangling").otherwise("ok")
    out = walk.withColumn("state", state).select("key", F.when(F.col("state").isin("ok", "dangling"), F.col("root")).alias("root"), "hop", "state")
    return joined(keyed.drop("to"), out, "key")


def reverse_links(log: DataFrame, dst_ref: str, edge_type: str | None = None) -> DataFrame:
    """Latest links into a reference, in order of their escaped source."""
    own = log.where((F.col("kind") == "link") & (F.col("link.dst_ref") == dst_ref))
    if edge_type:
        own = own.where(F.col("link.edge_type") == edge_type)
    return latest(own).orderBy(escape_id(F.col("link.src_ref")))


def drop_chains(log: DataFrame, chains: DataFrame) -> DataFrame:
    """The log without the given ``kind, id`` chains: rows of the next snapshot."""
    return log.join(chains.select(*CHAIN).distinct(), CHAIN, "left_anti")


def drop_links_touching(log: DataFrame, refs: DataFrame) -> DataFrame:
    """The log without links from or to any of the given ``ref`` values."""
    gone = refs.select(F.col("ref").alias("_ref")).distinct()
    out = log.join(gone, F.col("link.src_ref") == F.col("_ref"), "left_anti")
    return out.join(gone, F.col("link.dst_ref") == F.col("_ref"), "left_anti")


def excerpt(kind: Column, entity: Column, decision: Column, link: Column, observation: Column, outcome: Column, most: int = 80) -> Column:
    """One line about an event, cut to a number of characters."""
    text = (
        F.when(kind == "entity", F.concat_ws(" ", entity["type"], entity["path"]))
        .when(kind == "decision", decision["title"])
        .when(kind == "link", F.concat(link["src_ref"], F.lit(" --"), link["edge_type"], F.lit("--> "), link["dst_ref"]))
        .when(kind == "observation", F.concat_ws(" ", observation["action"], observation["subject"]))
        .when(kind == "outcome", F.concat_ws(" ", outcome["type"], outcome["subject"]))
    )
    return F.substring(text, 1, most)
