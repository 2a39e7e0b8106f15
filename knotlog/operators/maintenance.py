"""Scans that go on from a snapshot, back-fills, migrations, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Microseconds that a back-fill is estimated to need for a record.
MICROS_A_RECORD = 10


def diff(existing: DataFrame, seen: DataFrame) -> DataFrame:
    """``path, old_hash, new_hash, change`` (new, changed, unchanged, missing) by path."""
    a = existing.select("path", F.col("hash").alias("old_hash"), F.lit(1).alias("_old"))
    b = seen.select("path", F.col("hash").alias("new_hash"), F.lit(1).alias("_new"))
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "missing").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "unchanged").otherwise("changed")
    return a.join(b, "path", "full").select("path", "old_hash", "new_hash", change.alias("change"))


def mark_deleted(existing: DataFrame, seen: DataFrame, now: Column) -> DataFrame:
    """Existing nodes; those not seen get the status ``deleted`` and a new time."""
    known = seen.select("file_path").distinct().withColumn("_seen", F.lit(True))
    out = existing.join(known, "file_path", "left")
    gone = F.col("_seen").isNull() & ~F.col("status").eqNullSafe("deleted")
    return out.withColumns({"status": F.when(gone, F.lit("deleted")).otherwise(F.col("status")), "updated_at": F.when(gone, now).otherwise(F.col("updated_at"))}).drop("_seen")


def live(nodes: DataFrame) -> DataFrame:
    """Nodes that are not deleted."""
    return nodes.where("coalesce(status, '') <> 'deleted'")


def new_versions(latest: DataFrame, seen: DataFrame) -> DataFrame:
    """Seen rows (``id, hash``) whose latest version has another hash, or none."""
    known = latest.select("id", F.col("hash").alias("_hash"))
    return seen.join(known, "id", "left").where(~F.col("hash").eqNullSafe(F.col("_hash")) | F.col("_hash").isNull()).drop("_hash")


def backfill(rows: DataFrame, field: str, default, kind: str) -> DataFrame:
    """``rows`` with a field, the default where it is missing; twice is as once."""
    value = F.coalesce(F.col(field).cast(kind), F.lit(default).cast(kind)) if field in rows.columns else F.lit(default).cast(kind)
    return rows.withColumn(field, value)


def alter_impact(rows: DataFrame) -> DataFrame:
    """One row: records that a back-fill would touch and its estimated time."""
    n = F.count("*")
    return rows.agg(n.alias("records"), (n * MICROS_A_RECORD).alias("micros"))


def nodes_to_entities(nodes: DataFrame) -> DataFrame:
    """Nodes as entity events without versions."""
    entity = F.struct(F.col("type"), F.col("file_path").alias("path"), F.col("name"), F.col("content_hash").alias("hash"))
    return nodes.select(F.lit("entity").alias("kind"), F.col("file_path").alias("id"), F.col("created_at"), entity.alias("entity"), F.when(F.col("status") == "deleted", "historical").otherwise("active").alias("lifecycle"))


def relations_to_links(relations: DataFrame) -> DataFrame:
    """Relations as links; a relation without a type is ``related``."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    ref = lambda c: F.concat(F.lit("e:"), F.regexp_replace(c, "^kn:", ""))
    return relations.where("coalesce(source_node_id, '') <> '' AND coalesce(target_node_id, '') <> ''").select(ref("source_node_id").alias("src_ref"), F.coalesce(some("type"), F.lit("related")).alias("edge_type"), ref("target_node_id").alias("dst_ref"), "created_at")


def notes_to_decisions(notes: DataFrame) -> DataFrame:
    """Notes as decision events: their first line is the title."""
    from knotlog.functions.text import title_of

    decision = F.struct(title_of(F.col("content")).alias("title"), F.col("content").alias("body"), F.lit("may").alias("severity"), F.lit("global").alias("scope"), F.lit("note").alias("source"))
    return notes.select(F.lit("decision").alias("kind"), F.concat(F.lit("note:"), "id").alias("id"), "created_at", decision.alias("decision"), F.lit("active").alias("lifecycle"))


def expired_sessions(sessions: DataFrame, before: Column) -> DataFrame:
    """Sessions older than a time."""
    return sessions.where(F.col("created_at") < before)


def prune(sessions: DataFrame, calls: DataFrame, served: DataFrame, before: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions, calls and served rows that a retention limit leaves."""
    gone = expired_sessions(sessions, before).select("session")
    old_calls = calls.join(gone, "session", "left_semi").select("call")
    return sessions.join(gone, "session", "left_anti"), calls.join(gone, "session", "left_anti"), served.join(old_calls, "call", "left_anti")


def put(rows: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with ``new`` put in place of rows with the same key."""
    return rows.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def remove(rows: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` without the given keys."""
    return rows.join(keys.select(key).distinct(), key, "left_anti")
