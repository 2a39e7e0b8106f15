"""One object for everything a caller asks of a store."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotlog.functions.scoring import PROFILES, Profile
from knotlog.operators import eventlog, federation, graph, maintenance, reports, retrieval, search
from knotlog.plans import dsl
from knotlog.schema import EVENT_LOG, INDEXED
from knotlog.sources import files
from knotlog.sources.scratch import written
from knotlog.sources.store import Store
from knotlog.streaming import watcher


def federated(spark: SparkSession, roots: dict[str, str], text: str, limit: int = 0, at_once: int = 8, seconds: float | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """A query over the stores of several repositories (name to root), side by side, and what went wrong with which."""
    ask = {name: lambda root=root: Engine(spark, root).query(text) for name, root in roots.items()}
    return federation.query_repos(ask, limit, at_once, seconds)


class Engine:
    """Queries, searches, walks, context and reports over one store.

    A store's tables are the collections (``nodes``, ``relations``, ...) and
    ``log``, the event log.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    # --- reading

    def log(self) -> DataFrame:
        """The event log."""
        return self.store.table("log")

    def links(self) -> DataFrame:
        """All versions of the log's links, flat."""
        return self.log().where("kind = 'link'").select("link.*", "version", "created_at_nanos", "lifecycle")

    def query(self, text: str) -> DataFrame:
        """A query of the language."""
        q = dsl.parse(text)
        if q.traverse:
            return dsl.compile_query(q, None, self.links(), self.store.registry())
        return dsl.over_store(q, self.store)[0]

    def explain(self, text: str) -> str:
        """What a query would do."""
        q = dsl.parse(text)
        registry = self.store.registry()
        dsl.check(q, registry)
        stored = not q.traverse and q.collection in self.store.tables()
        return dsl.explain(q, self.store.seek(q.collection, dsl.wanted(q, registry))[1] if stored else None)

    def recall(self, text: str, limit: int = 10) -> DataFrame:
        """Nodes found by a text, over all their fields, best first."""
        nodes = self.store.table("nodes")
        docs = nodes.select("id", F.to_json(F.struct(*nodes.columns)).alias("text"))
        return search.search(docs, text, limit, id="id")

    def graph(self, ref: str, depth: int = graph.DEFAULT_DEPTH, direction: str = "forward", edge: str = "", as_of: str = "") -> DataFrame:
        """References reached from one, sorted."""
        start = self.spark.createDataFrame([(ref,)], "ref string")
        found = graph.reachable(self.links(), start, depth, direction, [edge] if edge else None, dsl.time_nanos(as_of) if as_of else None)
        return found.orderBy("ref")

    def history(self, kind: str, id: str) -> DataFrame:
        """Versions of an event with one line about each."""
        line = eventlog.excerpt(*[F.col(c) for c in ("kind", "entity", "decision", "link", "observation", "outcome")])
        return eventlog.history(self.log(), kind, id).withColumn("line", line)

    def context(self, paths: list[str], workflow: str = "explore", budget: int = 0, served: list[str] | None = None, now: datetime | None = None, profile: Profile | None = None) -> DataFrame:
        """Sections for files within a budget."""
        if workflow not in PROFILES:
            workflow = "explore"
        request = retrieval.Request(paths, now or datetime.now(UTC), workflow, budget, served or [], profile)
        return retrieval.assemble(self.spark, self.log(), self.links(), request)

    def decisions(self) -> DataFrame:
        """Latest version of every decision, flat."""
        return eventlog.latest(self.log().where("kind = 'decision'")).select("id", "lifecycle", "created_at", "decision.*")

    def topology(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Entry points, core modules, hotspots."""
        entities = eventlog.latest(self.log().where("kind = 'entity'")).select(F.concat(F.lit("e:"), "id").alias("ref"))
        fans = reports.fan_counts(entities, eventlog.latest(self.links(), graph.TRIPLE), self.decisions().where("severity = 'must'"))
        return reports.entry_points(fans), reports.core_modules(fans), reports.hotspots(fans)

    # --- writing

    def scan(self, root: str, exclude: list[str] | None = None, now: datetime | None = None) -> int:
        """Brings nodes and log up to a folder's files; returns the snapshot.

        Only files whose length or time differ from the last scan's are read, and
        only nodes that are new, changed, or gone are written; the scan, its nodes
        and its events are one snapshot.  The first scan makes the indexes of nodes.
        """
        now = now or datetime.now(UTC)
        found = watcher.look(self.store, root, exclude, {"imports": files.import_paths(F.col("path"), F.col("content"))})
        if found.quiet:
            return self.store.manifest()["snapshot"]
        seen = files.nodes(found.read, F.lit(now.isoformat()))
        nanos = int(now.timestamp() * 1e6) * 1000
        stamp = {"created_at_nanos": F.lit(nanos), "created_at": F.lit(now), "lifecycle": F.lit("active")}
        tables = self.store.tables()
        known = self.store.table("nodes") if "nodes" in tables else seen.limit(0)
        log = self.log() if "log" in tables else None
        known = written(known.join(found.read.select(F.col("path").alias("id")).union(found.gone.select("path")), "id", "left_semi"), "known-nodes")
        old = known.select("id", F.col("created_at").alias("_first"), F.struct("content_hash", "status").alias("_old"))
        fresh = seen.join(old, "id", "left").withColumn("created_at", F.coalesce("_first", "created_at"))
        fresh = fresh.where(~F.col("_old").eqNullSafe(F.struct("content_hash", "status"))).drop("_first", "_old")
        gone = maintenance.live(known).join(found.gone.select(F.col("path").alias("id")), "id", "left_semi").withColumns({"status": F.lit("deleted"), "updated_at": F.lit(now.isoformat())})
        nodes = written(fresh.unionByName(gone, allowMissingColumns=True), "changed-nodes")
        latest = known.where("status <> 'deleted'").select("id", F.col("content_hash").alias("hash"))
        changed = maintenance.new_versions(latest, seen.withColumn("hash", F.col("content_hash")))
        entity = F.struct("type", F.col("file_path").alias("path"), "name", F.col("content_hash").alias("hash"))

        def shaped(df: DataFrame) -> DataFrame:
            return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT_LOG])

        events = eventlog.append(log, changed.select(F.lit("entity").alias("kind"), "id", entity.alias("entity")).withColumns(stamp), [F.col("id")])
        imports = found.read.join(changed.select(F.col("id").alias("path")), "path", "left_semi").select("path", F.explode("imports").alias("import_path"))
        links = files.links_of(imports).withColumns(stamp)
        linked = eventlog.append_links(log, links, [F.col("id")])
        if log is not None:  # a link that is there already gets no new version
            linked = eventlog.append_absent(log, linked)
        more = found.commit()
        more.setdefault("put" if "nodes" in tables else "append", {})["nodes"] = nodes
        more.setdefault("append", {})["log"] = shaped(events).unionByName(shaped(linked))
        snapshot = self.store.commit(**more)
        missing = [f for f in INDEXED["nodes"] if f not in self.store.indexes("nodes")]
        return self.store.add_index("nodes", *missing) if missing else snapshot

    def put_decisions(self, rows: DataFrame, now: datetime | None = None) -> int:
        """Appends decisions (``id, title, body, severity, scope, source``) that are not there yet."""
        now = now or datetime.now(UTC)
        decision = F.struct("title", "body", "severity", "scope", "source")
        new = rows.select(F.lit("decision").alias("kind"), "id", decision.alias("decision")).withColumns({"created_at_nanos": F.lit(int(now.timestamp() * 1e6) * 1000), "created_at": F.lit(now), "lifecycle": F.lit("active")})
        log = self.log() if "log" in self.store.tables() else None
        new = eventlog.append_absent(log, new) if log is not None else new
        out = eventlog.append(None, new, [F.col("id")])
        return self.store.commit(append={"log": out.select(*[(F.col(f.name) if f.name in out.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT_LOG])})

    def alter(self, collection: str, field: str, kind: str, default=None, dry: bool = False):
        """Adds a field and fills it in batches, going on where an earlier call stopped; a dry run tells the records and the time."""
        registry = self.store.registry()
        rows = self.store.table(collection)
        if dry:
            return maintenance.alter_impact(rows).first().asDict()
        registry.add_field(collection, field, kind)
        spark_kind = registry.struct(collection)[field].dataType.simpleString()
        self.store.start_backfill(collection, field, default, spark_kind, registry)
        self.store.backfill(collection, field)
        return self.store.manifest()["snapshot"]
