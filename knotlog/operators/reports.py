"""Aggregate reports: topology, complexity, sessions, modules, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotlog.functions.paths import dir_name, is_test_file

TOP = 5
#: Limits of the topology classes.
ENTRY_MAX_IN, ENTRY_MIN_OUT, HOTSPOT_MIN = 1, 3, 3
#: Weights of the complexity score.
WEIGHTS = {"fan_in": 0.30, "instability": 0.25, "churn": 0.20, "files": 0.15, "entities": 0.10}
WINDOW_DAYS, SATURATION, CAPPED_AT = 90, 10, 50


def fan_counts(entities: DataFrame, links: DataFrame, must: DataFrame) -> DataFrame:
    """``ref, fan_in, fan_out, must_count`` of every entity.

    ``links`` are latest versions whatever their lifecycle.  Counts come from
    one pass over the links, each turned into what it adds to either end.
    """
    marked = links.join(must.select(F.concat(F.lit("d:"), "id").alias("dst_ref"), F.lit(1).alias("_must")).distinct(), "dst_ref", "left")
    imports = F.col("edge_type") == "imports"
    add = lambda ref, i, o, m: F.struct(ref.alias("ref"), i.alias("i"), o.alias("o"), m.alias("m"))
    zero, one = F.lit(0), F.lit(1)
    each = F.when(imports, F.array(add(F.col("src_ref"), zero, one, zero), add(F.col("dst_ref"), one, zero, zero))).when((F.col("edge_type") == "decision_link") & F.col("_must").isNotNull(), F.array(add(F.col("src_ref"), zero, zero, one)))
    sums = marked.select(F.explode(each).alias("x")).groupBy("x.ref").agg(F.sum("x.i").alias("i"), F.sum("x.o").alias("o"), F.sum("x.m").alias("m"))
    out = entities.select("ref").distinct().join(sums, "ref", "left")
    return out.select("ref", *[F.coalesce(c, F.lit(0)).cast("long").alias(n) for c, n in (("i", "fan_in"), ("o", "fan_out"), ("m", "must_count"))])


def entry_points(fans: DataFrame) -> DataFrame:
    """Entities that import much and are hardly imported."""
    return fans.where((F.col("fan_in") <= ENTRY_MAX_IN) & (F.col("fan_out") >= ENTRY_MIN_OUT)).orderBy(F.col("fan_out").desc(), "ref").limit(TOP)


def core_modules(fans: DataFrame) -> DataFrame:
    """``module, incoming``: folders whose entities are imported most."""
    path = F.regexp_replace("ref", "^e:", "")
    return fans.where("fan_in > 0").groupBy(dir_name(path).alias("module")).agg(F.sum("fan_in").alias("incoming")).orderBy(F.col("incoming").desc(), "module").limit(TOP)


def hotspots(fans: DataFrame) -> DataFrame:
    """Entities that most must-decisions are linked to."""
    return fans.where(F.col("must_count") >= HOTSPOT_MIN).orderBy(F.col("must_count").desc(), "ref").limit(TOP)


def module_fan_in(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """``module, fan_in``: distinct other modules that import a module."""
    of = nodes.where("coalesce(module, '') <> ''").select("file_path", "module").distinct()
    src = of.select(F.col("file_path").alias("source_node_id"), F.col("module").alias("src_module"))
    dst = of.select(F.col("file_path").alias("target_node_id"), "module")
    pairs = relations.where("type = 'imports'").join(src, "source_node_id").join(dst, "target_node_id").where("src_module <> module")
    return pairs.select("module", "src_module").distinct().groupBy("module").agg(F.count("*").alias("fan_in"))


def module_churn(nodes: DataFrame, evolution: DataFrame, since: Column) -> DataFrame:
    """``module, churn``: changes since a time; a change names a file in any of three ways."""
    alias = F.array_distinct(F.array(F.concat(F.lit("kn:"), "file_path"), F.col("id"), F.col("file_path")))
    names = nodes.where("coalesce(module, '') <> ''").select(F.explode(alias).alias("node_id"), "module").distinct()
    return evolution.where(F.col("timestamp") >= since).join(names, "node_id").groupBy("module").agg(F.count("*").alias("churn"))


def complexity(nodes: DataFrame, relations: DataFrame, evolution: DataFrame, since: Column) -> DataFrame:
    """``module, score`` and its parts, from 0 to 1.

    ``nodes`` has ``id, file_path, module, stability, entities`` (their number).
    A measure with one value only counts 0; without any entities their weight is
    shared by the other measures.
    """
    base = nodes.groupBy("module").agg(F.count("*").alias("files"), F.avg("stability").alias("stability"), F.sum("entities").alias("entities"))
    raw = base.join(module_fan_in(nodes, relations), "module", "left").join(module_churn(nodes, evolution, since), "module", "left")
    raw = raw.select("module", "files", (1 - F.coalesce("stability", F.lit(0.0))).alias("instability"), F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("churn", F.lit(0)).alias("churn"), (F.col("entities") / F.col("files")).alias("entities"))
    # one row of extremes beside the modules, which are few next to the nodes
    parts = ["fan_in", "churn", "files", "entities"]
    ends = raw.agg(*[F.min(c).alias(f"{c}_low") for c in parts], *[F.max(c).alias(f"{c}_high") for c in parts])
    x = raw.withColumn("_one", F.lit(1)).join(F.broadcast(ends.withColumn("_one", F.lit(1))), "_one")
    norm = lambda c: F.when(F.col(f"{c}_high") == F.col(f"{c}_low"), F.lit(0.0)).otherwise((F.col(c) - F.col(f"{c}_low")) / (F.col(f"{c}_high") - F.col(f"{c}_low")))
    rest = 1 - WEIGHTS["entities"]
    four = WEIGHTS["fan_in"] * norm("fan_in") + WEIGHTS["instability"] * F.col("instability") + WEIGHTS["churn"] * norm("churn") + WEIGHTS["files"] * norm("files")
    score = F.when(F.col("entities_high") > 0, four + WEIGHTS["entities"] * norm("entities")).otherwise(four / rest)
    return x.select("module", F.col("files"), F.col("fan_in"), F.col("churn"), score.alias("score"))


def count_by(nodes: DataFrame, column: str) -> DataFrame:
    """Counts by a column, empty values left out; most first, then by name."""
    return nodes.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column)


def test_ratio(nodes: DataFrame) -> DataFrame:
    """One row: test files, source files, and their quotient (0 without sources)."""
    tests, sources = F.count_if(F.col("class") == "test"), F.count_if(F.col("class") == "source")
    return nodes.agg(tests.alias("tests"), sources.alias("sources"), F.when(sources > 0, tests / sources).otherwise(F.lit(0.0)).alias("ratio"))


def module_summary(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """``module, files, stability, deps``: counts, mean stability, sorted import targets."""
    own = nodes.groupBy("module").agg(F.count("*").alias("files"), F.avg("stability").alias("stability"))
    src = nodes.select(F.col("file_path").alias("source_node_id"), "module").distinct()
    deps = relations.where("type = 'imports'").join(src, "source_node_id").select("module", "target_node_id").distinct()
    lists = deps.groupBy("module").agg(F.sort_array(F.collect_list("target_node_id")).alias("deps"))
    return own.join(lists, "module", "left").withColumn("deps", F.coalesce("deps", F.array().cast("array<string>")))


def file_stats(commits: DataFrame, since: Column) -> DataFrame:
    """``path, commits, stability, last_author, last_type`` over a window of commits.

    ``commits`` has ``path, sha, author, time, change_type``.  Stability falls
    by a tenth for each commit; a file at the history cap counts as unstable.
    """
    recent = commits.where(F.col("time") >= since)
    n = F.count("*")
    stable = F.when(n >= CAPPED_AT, F.lit(0.0)).otherwise(F.greatest(1 - n / F.lit(float(SATURATION)), F.lit(0.0)))
    last = lambda c: F.max_by(c, F.struct("time", "sha"))
    return recent.groupBy("path").agg(n.alias("commits"), stable.alias("stability"), last("author").alias("last_author"), last("change_type").alias("last_type"), F.max("time").alias("last_time"))


def authorship(commits: DataFrame) -> DataFrame:
    """``module, author, commits``, most first; a commit counts once for a module."""
    return commits.groupBy("module", "author").agg(F.countDistinct("sha").alias("commits")).orderBy("module", F.col("commits").desc(), "author")


def adjacency(relations: DataFrame) -> DataFrame:
    """``source, targets``: import and depends_on targets, sorted, repeats kept."""
    return relations.where(F.col("type").isin("imports", "depends_on")).groupBy(F.col("source_node_id").alias("source")).agg(F.sort_array(F.collect_list("target_node_id")).alias("targets"))


def session_stats(sessions: DataFrame, calls: DataFrame, served: DataFrame) -> DataFrame:
    """One row of totals over sessions, calls and what was served."""
    files = F.countDistinct(F.when(F.col("ref").startswith("e:"), F.col("ref")))
    decisions = F.countDistinct(F.when(F.col("ref").startswith("d:"), F.col("ref")))
    a = sessions.agg(F.count("*").alias("sessions"))
    b = calls.agg(F.count("*").alias("calls"))
    c = served.agg(files.alias("files"), decisions.alias("decisions"))
    one = lambda d: d.withColumn("_", F.lit(1))
    return one(a).join(one(b), "_").join(one(c), "_").drop("_")


def top_counts(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The most frequent values of a column."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column).limit(n)


def session_list(sessions: DataFrame, calls: DataFrame) -> DataFrame:
    """Sessions with their number of calls, newest first."""
    n = calls.groupBy("session").agg(F.count("*").alias("calls"))
    return sessions.join(n, "session", "left").withColumn("calls", F.coalesce("calls", F.lit(0))).orderBy(F.col("created_at").desc(), "session")


def session_show(calls: DataFrame, served: DataFrame, session: str) -> DataFrame:
    """A session's calls in time order with what each served."""
    own = calls.where(F.col("session") == session)
    lists = served.groupBy("call").agg(F.sort_array(F.collect_list("ref")).alias("served"))
    return own.join(lists, "call", "left").withColumn("served", F.coalesce("served", F.array().cast("array<string>"))).orderBy("created_at", "call")


def focus_map(served: DataFrame) -> DataFrame:
    """``ref, calls``: in how many calls a reference was served, most first."""
    return served.groupBy("ref").agg(F.countDistinct("call").alias("calls")).orderBy(F.col("calls").desc(), "ref")


def decisions_with_files(decisions: DataFrame, links: DataFrame) -> DataFrame:
    """Active decisions, each with the sorted files linked to it (none is an empty list)."""
    files = links.where("edge_type = 'decision_link'").select(F.regexp_replace("dst_ref", "^d:", "").alias("id"), F.regexp_replace("src_ref", "^e:", "").alias("file")).distinct()
    lists = files.groupBy("id").agg(F.sort_array(F.collect_list("file")).alias("files"))
    live = decisions.where("lifecycle IS NULL OR lifecycle = 'active'")
    return live.join(lists, "id", "left").withColumn("files", F.coalesce("files", F.array().cast("array<string>"))).orderBy("id")


def decisions_for_module(decisions: DataFrame, module: str) -> DataFrame:
    """Decisions that are global or have a file in a module."""
    return decisions.where((F.col("scope") == "global") | F.exists("files", lambda f: (f == module) | f.startswith(module + "/")))


def severity_rank(severity: Column) -> Column:
    """Order of severities: must, should, may, unset."""
    return F.when(severity == "must", 1).when(severity == "should", 2).when(severity == "may", 3).otherwise(4)


def severity_groups(decisions: DataFrame) -> DataFrame:
    """``severity, n, ids`` in order of severity."""
    return decisions.groupBy("severity").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids")).orderBy(severity_rank(F.col("severity")))


def list_decisions(decisions: DataFrame, source: str | None = None, severity: str | None = None, file: str | None = None, links: DataFrame | None = None) -> DataFrame:
    """Active decisions by source (any case), severity, and a file linked to them."""
    out = decisions.where("lifecycle = 'active'")
    if source:
        out = out.where(F.lower("source") == source.lower())
    if severity:
        out = out.where(F.col("severity") == severity)
    if file and links is not None:
        own = links.where((F.col("edge_type") == "decision_link") & (F.col("src_ref") == f"e:{file}")).select(F.regexp_replace("dst_ref", "^d:", "").alias("id"))
        out = out.join(own, "id", "left_semi")
    return out.orderBy("id")


def list_relations(relations: DataFrame, text: str = "", type: str = "") -> DataFrame:
    """Relations with a text in either end, and of a type."""
    out = relations
    if text:
        out = out.where(F.col("source_node_id").contains(text) | F.col("target_node_id").contains(text))
    return out.where(F.col("type") == type) if type else out


def file_history(evolution: DataFrame, path: str) -> DataFrame:
    """A file's changes, one line each."""
    line = F.concat_ws(" ", F.substring("timestamp", 1, 10), F.col("change_type"), F.substring("commit_hash", 1, 8), F.col("author"))
    return evolution.where(F.col("node_id") == path).select("id", "timestamp", line.alias("line")).orderBy(F.col("timestamp").desc(), "id")


def volatile_first(nodes: DataFrame, n: int = 20) -> DataFrame:
    """The least stable files."""
    return nodes.orderBy("stability", "file_path").limit(n)


def inferred_constraints(nodes: DataFrame) -> DataFrame:
    """Rules that hold because some Go file, or some infrastructure file, exists."""
    seen = nodes.agg(F.bool_or(F.col("language") == "Go").alias("go"), F.bool_or(F.col("class") == "infra").alias("infra"))
    rule = lambda on, scope, severity, text: F.when(F.coalesce(on, F.lit(False)), F.struct(F.lit(scope).alias("scope"), F.lit(severity).alias("severity"), F.lit(text).alias("description")))
    rules = F.array(rule(F.col("go"), "go", "should", "Errors are wrapped with context"), rule(F.col("infra"), "infra", "must", "Infrastructure changes are reviewed"))
    return seen.select(F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("r.*")


def longest_module_in(query: str, nodes: DataFrame) -> DataFrame:
    """``module``: the longest module name that a query mentions (ties by name)."""
    low = F.lower("module")
    return nodes.where(F.lit(query.lower()).contains(low)).agg(F.max_by("module", F.struct(F.length("module"), "module")).alias("module")).where("module IS NOT NULL")


def is_entry_point(path: Column, role: Column) -> Column:
    """Whether a file starts or serves the program."""
    return role.isin("entry_point", "api") | path.rlike(r"(^|/)main\.go$") | (path.rlike(r"^(cmd|api|app)/") & role.isNotNull() & (role == "source"))


def renames(changes: DataFrame) -> DataFrame:
    """``commit, from_path, to_path``: a delete and an add of one content in one commit.

    ``changes`` has ``commit, path, hash, action`` (``add`` or ``delete``).
    """
    gone = changes.where("action = 'delete'").select("commit", "hash", F.col("path").alias("from_path"))
    new = changes.where("action = 'add'").select("commit", "hash", F.col("path").alias("to_path"))
    return gone.join(new, ["commit", "hash"]).where("from_path <> to_path").select("commit", "from_path", "to_path")


def walkthrough(sections: DataFrame, skip: list[str] | None = None, shallow: bool = False, name: str | None = None) -> DataFrame:
    """Sections (``position, name, body``) left after filters; shallow keeps the first three."""
    out = sections.where(~F.col("name").isin(skip)) if skip else sections
    out = out.where(F.col("name") == name) if name else out
    return out.orderBy("position").limit(3) if shallow else out.orderBy("position")


def render_markdown(title: str, rows: DataFrame, columns: list[str], most: int = 500) -> str:
    """A small result as a Markdown table; ``most`` rows."""
    head = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(head + ["| " + " | ".join(str(r[c]) for c in columns) + " |" for r in rows.limit(most).collect()])


def with_test_flag(nodes: DataFrame) -> DataFrame:
    """Nodes with ``is_test`` by their path."""
    return nodes.withColumn("is_test", is_test_file(F.col("file_path")))
