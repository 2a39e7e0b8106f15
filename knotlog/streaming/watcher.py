"""What changed under a folder since the last scan: new, changed and deleted files."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotlog.sources.files import contents, listing
from knotlog.sources.scratch import written
from knotlog.sources.store import Store

#: Seconds that files must have been quiet before a scan counts.
DEBOUNCE = 0.5
_SCAN = "id string, bytes long, modified timestamp, hash string"


@dataclass(frozen=True)
class Look:
    """What differs under a folder from what a store remembers of it.

    ``read`` has ``path, bytes, modified, old_hash, hash, is_new`` of the files
    that were read, ``gone`` has ``path, old_hash`` of those that are missing.
    """

    read: DataFrame
    gone: DataFrame
    first: bool
    quiet: bool

    def changes(self) -> DataFrame:
        """``path, old_hash, new_hash, change`` of new, changed and missing files."""
        kind = F.when(F.col("is_new"), "new").otherwise("changed").alias("change")
        changed = self.read.where(F.col("is_new") | (F.col("hash") != F.col("old_hash"))).select("path", "old_hash", F.col("hash").alias("new_hash"), kind)
        return changed.unionByName(self.gone.select("path", "old_hash", F.lit(None).cast("string").alias("new_hash"), F.lit("missing").alias("change")))

    def commit(self) -> dict[str, dict[str, DataFrame]]:
        """Arguments of a store's commit that make it remember."""
        seen = self.read.select(F.col("path").alias("id"), "bytes", "modified", "hash")
        if self.first:
            return {"append": {"scan": seen}}
        return {"put": {"scan": seen}, "delete": {"scan": self.gone.select(F.col("path").alias("id"))}}


def look(store: Store, root: str, exclude: list[str] | None = None, also: dict[str, Column] | None = None) -> Look:
    """Compares a folder with the store's last scan of it.

    Only files whose length or time of change differ from what the store has are
    read and hashed, once; ``also`` names columns made of ``path`` and ``content``
    that ``read`` shall have.  Nothing is written to the store.
    """
    spark, also = store.spark, also or {}
    here = listing(spark, root, exclude)
    first = "scan" not in store.tables()
    known = store.table("scan") if not first else spark.createDataFrame([], _SCAN)
    same = (F.col("k.bytes") == F.col("h.bytes")) & (F.col("k.modified") == F.col("h.modified"))
    both = written(here.alias("h").join(known.alias("k"), F.col("h.path") == F.col("k.id"), "full").where(F.col("k.id").isNull() | F.col("h.path").isNull() | ~same).select("h.path", "h.bytes", "h.modified", F.col("k.id").alias("known"), F.col("k.hash").alias("old_hash")), "differ")
    counts = both.agg(F.count("path").alias("here"), F.count(F.when(F.col("path").isNull(), 1)).alias("gone")).first()
    differ = both.where("path IS NOT NULL").select("path", "bytes", "modified", "old_hash", F.col("known").isNull().alias("is_new"))
    if counts["here"]:
        read = written(differ.join(contents(spark, root, differ).select("path", "hash", *[c.alias(n) for n, c in also.items()]), "path"), "hashed")
    else:
        read = differ.withColumns({"hash": F.lit(None).cast("string"), **{n: F.lit(None) for n in also}})
    gone = both.where("path IS NULL").select(F.col("known").alias("path"), "old_hash")
    return Look(read, gone, first, not first and not counts["here"] and not counts["gone"])


def scan_changes(store: Store, root: str, exclude: list[str] | None = None) -> DataFrame:
    """``path, old_hash, new_hash, change`` since the last call, which the store remembers.

    ``change`` is ``new``, ``changed`` or ``missing``; the first call finds
    every file new.  A file that was touched and is the same is no change.  What
    is remembered is put by path: its other files stay.
    """
    found = look(store, root, exclude)
    if not found.quiet:
        store.commit(**found.commit())
    return found.changes()


def follow(store: Store, root: str, on_changes: Callable[[DataFrame], None], interval: float = 5.0, rounds: int | None = None, exclude: list[str] | None = None, wait: Callable[[float], None] = time.sleep) -> int:
    """Scans again and again, one scan at a time, and hands on what changed; the number of hand-overs.

    A scan that finds changes is followed by another after ``DEBOUNCE`` seconds
    until one is quiet, so a burst of writes is followed through before the
    next ``interval``.
    """
    handed, n = 0, 0
    while rounds is None or n < rounds:
        n += 1
        changes = scan_changes(store, root, exclude)
        if changes.isEmpty():
            wait(interval)
            continue
        on_changes(changes)
        handed += 1
        wait(DEBOUNCE)
    return handed
