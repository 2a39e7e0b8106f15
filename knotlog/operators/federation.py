"""Queries and checks over several repositories."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotlog.sources.scratch import written

#: Seconds between looks at running roots, and that a cancelled one is waited for.
POLL, GRACE = 0.05, 5.0


def union_repos(parts: dict[str, DataFrame], limit: int = 0) -> DataFrame:
    """Rows of all repositories with ``_repo``; of one (repository, id) the first stays.

    Rows without an id collapse to one for each repository.
    """
    out = None
    for repo, df in parts.items():
        own = df.withColumn("_repo", F.lit(repo))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    out = out.withColumn("_id", F.coalesce(F.col("id").cast("string"), F.lit(""))) if "id" in out.columns else out.withColumn("_id", F.lit(""))
    out = out.dropDuplicates(["_repo", "_id"]).drop("_id")
    return out.limit(limit) if limit > 0 else out


def query_repos(roots: dict[str, Callable[[], DataFrame]], limit: int = 0, at_once: int = 8, seconds: float | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """``union_repos`` over what each root returns; a root that fails, when planned or when run, or is too slow is reported.

    Roots run beside each other, at most ``at_once``, each from its own thread
    with a tag on its jobs; what it returns is written to the shared folder.  A
    root that takes over ``seconds`` from its start has its jobs cancelled.  With
    a ``limit`` no root gives more rows than that.
    """
    if not roots:
        return None, {}
    spark = SparkSession.getActiveSession()
    began: dict[str, float] = {}
    tags = {repo: f"root-{uuid.uuid4().hex}" for repo in roots}
    late: set[str] = set()

    def answer(repo: str) -> DataFrame:
        began[repo] = time.monotonic()
        spark.sparkContext.addJobTag(tags[repo])
        try:
            own = union_repos({repo: roots[repo]()}, limit)
            if repo in late:
                raise TimeoutError(repo)
            return written(own, "root")
        finally:
            spark.sparkContext.removeJobTag(tags[repo])

    pool = ThreadPoolExecutor(at_once, thread_name_prefix="root")
    running = {repo: pool.submit(inheritable_thread_target(spark)(answer), repo) for repo in roots}
    parts, errors = {}, {}
    while running:
        wait(running.values(), POLL, FIRST_COMPLETED)
        for repo, future in list(running.items()):
            if future.done():
                del running[repo]
                if e := future.exception():
                    errors.setdefault(repo, str(e).splitlines()[0] if str(e) else type(e).__name__)
                elif repo not in errors:
                    parts[repo] = future.result()
            elif seconds is not None and repo in began and time.monotonic() - began[repo] > seconds:
                late.add(repo)
                errors[repo] = f"no answer in {seconds:g} s"
                spark.sparkContext.cancelJobsWithTag(tags[repo])  # again in each round: a root may run several jobs
                if time.monotonic() - began[repo] > seconds + GRACE:  # it does not even run jobs: it is left behind
                    del running[repo]
    pool.shutdown(wait=False, cancel_futures=True)
    rows = None
    for repo in roots:  # in the order asked, whoever was first
        if repo in parts:
            rows = parts[repo] if rows is None else rows.unionByName(parts[repo], allowMissingColumns=True)
    return (rows.limit(limit) if rows is not None and limit > 0 else rows), {repo: errors[repo] for repo in roots if repo in errors}


def failures(errors: dict[str, str]) -> DataFrame:
    """``_repo, error`` of the roots that gave no answer."""
    return SparkSession.getActiveSession().createDataFrame(list(errors.items()), "_repo string, error string")


def cross_repo_deps(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Imports whose path starts with another repository's module path.

    ``imports`` has ``source_repo, source_node_id, import_path``; ``modules`` has
    ``module_path, repo``.  The prefix need not end at a slash.  A prefix match
    becomes an equi-join: each import is cut to every length a module path has.
    """
    lengths = modules.agg(F.array_sort(F.collect_set(F.length("module_path"))).alias("_lengths"))
    cut = imports.withColumn("_one", F.lit(1)).join(F.broadcast(lengths.withColumn("_one", F.lit(1))), "_one").drop("_one")
    cut = cut.withColumn("_n", F.explode(F.filter("_lengths", lambda n: n <= F.length("import_path")))).withColumn("module_path", F.substr(F.col("import_path"), F.lit(1), F.col("_n")))
    rest = F.regexp_replace(F.substr(F.col("import_path"), F.length("module_path") + 1), "^/", "")
    out = cut.join(modules.withColumnRenamed("repo", "target_repo"), "module_path").where("target_repo <> source_repo")
    return out.select("source_repo", "source_node_id", "target_repo", F.when(rest == "", F.lit("(root)")).otherwise(rest).alias("target_module"), "import_path")


def files_in_modules(files: DataFrame, modules: DataFrame) -> DataFrame:
    """``file, module`` where the file is the module or lies under it.

    Each file is exploded into its leading paths, so the join is an equi-join.
    """
    parts = F.split("file", "/")
    leads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return files.select("file", F.explode(leads).alias("module")).join(modules.select("module").distinct(), "module").select("file", "module")


def filter_deps(deps: DataFrame, node: str = "", module: str = "", direction: str = "", repo: str = "") -> DataFrame:
    """Dependencies by node, module and direction; all of them if none matches."""
    keep = F.lit(True)
    if node:
        keep = keep & (F.col("source_node_id") == node)
    if module:
        keep = keep & F.col("target_module").startswith(module)
    if direction == "outgoing":
        keep = keep & (F.col("source_repo") == repo)
    if direction == "incoming":
        keep = keep & (F.col("target_repo") == repo)
    found = deps.where(keep)
    return deps if found.isEmpty() else found


@dataclass(frozen=True)
class Rule:
    """A constraint of the manifest."""

    scope: str
    severity: str
    description: str


def _violation(rule: Rule, type_: Column, module: Column, annotations: Column) -> Column | None:
    text, low = rule.description.lower(), F.lower(F.coalesce(module, F.lit("")))
    if rule.scope == "all" and "no direct db access" in text:
        hit = (type_ == "import") & low.rlike("sql|database|db")
        return F.when(hit, F.concat(F.lit("Direct DB access detected in "), module))
    if rule.scope == "api" and "annotation" in text:
        hit = low.contains("api") & (F.coalesce(F.size(annotations), F.lit(0)) <= 0)
        return F.when(hit, F.concat(F.lit("API node missing required annotations in "), module))
    return None


def violations(nodes: DataFrame, rules: list[Rule]) -> DataFrame:
    """``id, scope, severity, rule, problem`` of every node and rule that it breaks.

    Rules come from a manifest and become one array expression: nodes are read
    once and nothing is joined.
    """
    made = []
    for r in rules:
        problem = _violation(r, F.col("type"), F.col("module"), F.col("annotations"))
        if problem is not None:
            made.append(F.when(problem.isNotNull(), F.struct(F.lit(r.scope).alias("scope"), F.lit(r.severity).alias("severity"), F.lit(r.description).alias("rule"), problem.alias("problem"))))
    if not made:
        made = [F.lit(None).cast("struct<scope:string,severity:string,rule:string,problem:string>")]
    return nodes.select("id", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("x")).select("id", "x.*")
