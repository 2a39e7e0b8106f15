"""Context for files: candidates, scores, budget, anticipated references."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotlog.functions import scoring
from knotlog.functions.text import file_anchor, split_ref, tokens_for
from knotlog.operators.eventlog import latest
from knotlog.operators.graph import neighbors, reachable
from knotlog.sources.scratch import written

#: Hops from a focus file to a candidate.
CANDIDATE_DEPTH = 2


def normalize_path(path: str) -> str:
    """A caller's path as an entity's id: clean, with slashes, no leading one."""
    p = path.strip()
    if not p:
        return ""
    p = posixpath.normpath(p.replace("\\", "/")).lstrip("/")
    return "" if p == "." else p


@dataclass
class Request:
    """What context is asked for."""

    files: list[str]
    now: datetime
    workflow: str = "explore"
    budget: int = 0
    served: list[str] = field(default_factory=list)
    profile: scoring.Profile | None = None

    def paths(self) -> list[str]:
        """Clean paths in order, empty ones dropped."""
        return [p for p in map(normalize_path, self.files) if p]

    def weights(self) -> scoring.Profile:
        """The profile that governs the request."""
        return self.profile or scoring.PROFILES.get(self.workflow, scoring.PROFILES["explore"])


def shape(events: DataFrame) -> DataFrame:
    """``ref, kind, path, severity, title, body, tokens, created_at`` of events."""
    e, d, k = F.col("entity"), F.col("decision"), F.col("link")
    arrow = F.concat(k["src_ref"], F.lit(" --"), k["edge_type"], F.lit("--> "), k["dst_ref"])
    some = lambda c: F.when(c != "", c)
    own = F.coalesce(some(e["path"]), F.col("id"))
    entity_body = F.when((F.coalesce(e["type"], F.lit("")) == "") & (F.coalesce(e["name"], F.lit("")) == ""), e["path"]).otherwise(F.concat(F.coalesce(e["path"], F.lit("")), F.lit(": "), F.coalesce(e["type"], F.lit("")), F.lit(" "), F.coalesce(e["name"], F.lit(""))))
    kind = F.col("kind")
    ref = F.concat(F.substring(F.when(kind == "outcome", F.lit("x")).otherwise(kind), 1, 1), F.lit(":"), F.col("id"))
    body = F.when(kind == "entity", entity_body).when(kind == "decision", F.coalesce(some(d["body"]), d["title"])).when(kind == "link", arrow).otherwise(F.lit(""))
    title = F.when(kind == "entity", own).when(kind == "decision", F.coalesce(some(d["title"]), F.col("id"))).when(kind == "link", arrow).otherwise(ref)
    path = F.when(kind == "entity", own).when(kind == "decision", file_anchor(d["body"])).otherwise(F.lit(""))
    return events.select(ref.alias("ref"), "kind", path.alias("path"), d["severity"].alias("severity"), title.alias("title"), body.alias("body"), tokens_for(body).alias("tokens"), "created_at")


def candidates(spark: SparkSession, links: DataFrame, paths: list[str]) -> DataFrame:
    """``ref, rank``: the files' own references and what they reach either way.

    ``rank`` orders the files first and then by distance and name; it is the
    order that ties of equal score keep.
    """
    starts = spark.createDataFrame([(f"e:{p}", i) for i, p in enumerate(paths)], "ref string, i long")
    found = reachable(links, starts, CANDIDATE_DEPTH, "both")
    own = starts.select("ref", F.lit(0).cast("long").alias("depth"))
    return own.unionByName(found.select("ref", "depth")).groupBy("ref").agg(F.min("depth").alias("depth"))


def scored_sections(spark: SparkSession, log: DataFrame, links: DataFrame, request: Request) -> DataFrame:
    """Candidate sections with ``score``; references without an event are left out."""
    prof, paths = request.weights(), request.paths()
    refs = candidates(spark, links, paths).withColumn("_k", split_ref(F.col("ref"))).where("_k IS NOT NULL")
    keyed = refs.select(F.col("_k.kind").alias("kind"), F.col("_k.id").alias("id"), "depth")
    events = latest(log.join(keyed.select("kind", "id"), ["kind", "id"], "left_semi"))
    rows = shape(events).join(refs.select("ref", "depth"), "ref")
    files, now = F.array(*[F.lit(p) for p in paths]).cast("array<string>"), F.lit(request.now)
    score = scoring.total(
        prof,
        scoring.recency(F.col("created_at"), now),
        scoring.severity(F.col("kind"), F.col("severity")),
        scoring.proximity(F.col("path"), files),
        scoring.novelty(F.col("ref"), F.array(*[F.lit(s) for s in request.served]).cast("array<string>")),
    )
    if prof.edges and prof.boost:
        starts = spark.createDataFrame([(f"e:{p}",) for p in paths], "ref string")
        first = neighbors(links, starts, "forward", list(prof.edges)).select("ref").distinct().withColumn("_first", F.lit(True))
        rows = rows.join(first, "ref", "left")
        score = scoring.boosted(score, F.coalesce("_first", F.lit(False)), prof.boost)
    return rows.withColumn("score", score).select("ref", "kind", "title", "body", "tokens", "score", "created_at", "depth")


def admit(sections: DataFrame, limit: int, key: list[str] | None = None) -> DataFrame:
    """``sections`` with ``admitted`` by the greedy budget.

    One request's sections (of each ``key``) are folded in order of score.  Only
    those that can be admitted are gathered for that: of sections of one cost
    ``t``, all better ones would be admitted first, so at most ``limit / t`` can
    be.  That bounds a fold by ``limit * (1 + ln limit)`` items, however many
    sections there are; a section without cost is always admitted and not
    folded.
    """
    key = key or []
    order = [F.col("score").desc(), "depth", "ref"]
    if limit <= 0:
        return sections.withColumn("admitted", F.lit(False))
    sections = written(sections, "sections")  # used twice below
    costs = sections.where("tokens > 0 AND tokens <= %d" % limit).select(*key, "score", "depth", "ref", "tokens")
    rank = F.row_number().over(Window.partitionBy(*key, "tokens").orderBy(*order))
    able = costs.withColumn("_n", rank).where(F.col("_n") <= limit).where(F.col("_n") * F.col("tokens") <= limit)
    items = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "depth", "ref", "tokens")))
    admitted = able.groupBy(*key).agg(scoring.admitted_refs(items, limit).alias("_refs"))
    taken = admitted.select(*key, F.explode("_refs").alias("ref"), F.lit(True).alias("_taken"))
    right = taken.withColumnsRenamed({c: f"_{c}" for c in (*key, "ref")})
    same = sections["ref"].eqNullSafe(right["_ref"])
    for c in key:
        same = same & sections[c].eqNullSafe(right[f"_{c}"])
    marked = sections.join(right, same, "left").drop(*[f"_{c}" for c in (*key, "ref")])
    return marked.withColumn("admitted", F.coalesce("_taken", F.col("tokens") <= 0, F.lit(False))).drop("_taken")


def assemble(spark: SparkSession, log: DataFrame, links: DataFrame, request: Request) -> DataFrame:
    """The admitted sections of a request, best first, with running metadata."""
    if not request.paths():
        return scored_sections(spark, log, links, Request(["-"], request.now)).limit(0).withColumn("admitted", F.lit(True))
    rows = admit(scored_sections(spark, log, links, request), request.budget if request.budget > 0 else scoring.DEFAULT_BUDGET)
    return rows.where("admitted").orderBy(F.col("score").desc(), "depth", "ref")


def anticipated(links: DataFrame, starts: DataFrame, served: DataFrame) -> DataFrame:
    """``ref``: one-hop neighbours of the starts that were not served, sorted."""
    near = neighbors(links, starts, "both").select("ref").distinct()
    known = served.select("ref").unionByName(starts.select("ref"))
    return near.join(known, "ref", "left_anti").orderBy("ref")


def recall_score(text: Column, names: Column, terms: list[str]) -> Column:
    """Substring recall: 1 for each term in the text, 2 for each entity name that holds it."""

    def named(term: str) -> Column:
        return F.size(F.filter(names, lambda n: F.lower(n).contains(term)))

    out = F.lit(0)
    for t in map(str.lower, terms):
        out = out + F.when(F.lower(text).contains(t), 1).otherwise(0) + 2 * named(t)
    return out


def chunks(rows: DataFrame, order: list, size: int = 20, above: int = 50) -> DataFrame:
    """``rows`` with ``chunk``, ``chunks`` and ``total``; one chunk up to ``above`` rows.

    The order is found by sorting, and numbers by counting each partition of
    the sort first, so no task sees all rows.
    """
    # written: both uses below must see the same partitions of the sort
    ordered = written(rows.orderBy(*order).withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}), "chunks")
    counts = ordered.groupBy("_p").agg(F.count("*").alias("_c"), F.min("_m").alias("_first"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    everything = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select("_p", "_first", before.alias("_before"), F.sum("_c").over(everything).alias("total"))
    n = F.col("_before") + F.col("_m") - F.col("_first")
    chunk = F.when(F.col("total") > above, F.floor(n / size)).otherwise(F.lit(0)).cast("long")
    many = F.when(F.col("total") > above, F.ceil(F.col("total") / size)).otherwise(F.lit(1)).cast("long")
    return ordered.join(F.broadcast(offsets), "_p").withColumns({"chunk": chunk, "chunks": many}).drop("_p", "_m", "_first", "_before")
