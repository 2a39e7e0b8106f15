"""Parameters that callers give as text: durations, recipes, manifests, workflows."""

from __future__ import annotations

import re
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotlog.functions.scoring import PROFILES, Profile
from knotlog.operators.federation import Rule

_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0, "w": 604800.0}


def duration(text: str) -> timedelta:
    """``30d``, ``2w``, ``1h30m``, ``1.5h``: a span from its text."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h|d|w)", text.strip())
    if not parts or "".join(n + u for n, u in parts) != text.strip():
        raise ValueError(f"no duration: {text!r}")
    return timedelta(seconds=sum(float(n) * _UNITS[u] for n, u in parts))


def duration_seconds(c: Column) -> Column:
    """Seconds of a span's text as ``duration`` reads it, or null if it is none."""
    clean = F.trim(c)
    parts = F.regexp_extract_all(clean, F.lit(r"\d+(?:\.\d+)?(?:ns|us|µs|ms|s|m|h|d|w)"), F.lit(0))
    units = F.create_map(*[F.lit(x) for pair in _UNITS.items() for x in pair])
    one = lambda p: F.regexp_extract(p, r"^[\d.]+", 0).cast("double") * F.element_at(units, F.regexp_extract(p, r"[a-zµ]+$", 0))
    return F.when((F.size(parts) > 0) & (F.array_join(parts, "") == clean), F.aggregate(F.transform(parts, one), F.lit(0.0), lambda a, b: a + b))


def recipes(settings: dict) -> dict[str, Profile]:
    """Profiles by workflow with a recipe file's changes; raises what is wrong.

    ``settings`` is the file's TOML: for each workflow ``weights`` (all four or
    some), ``edge_priority`` and ``edge_boost``.
    """
    out = dict(PROFILES)
    for workflow, own in settings.items():
        base = PROFILES.get(workflow, PROFILES["explore"])
        p = replace(base, **own.get("weights", {}), edges=tuple(own.get("edge_priority", base.edges)), boost=own.get("edge_boost", base.boost))
        if p.problems():
            raise ValueError(f"{workflow}: {'; '.join(p.problems())}")
        out[workflow] = p
    return out


def manifest(settings: dict) -> tuple[dict[str, str], list[Rule]]:
    """Repositories (name to path) and rules of a federation's TOML; raises what is wrong."""
    repos: dict[str, str] = {}
    for r in settings.get("repos", []):
        if not r.get("name") or not r.get("path"):
            raise ValueError("a repository needs a name and a path")
        if r["name"] in repos or r["path"] in repos.values():
            raise ValueError(f"repository {r['name']} twice")
        repos[r["name"]] = r["path"]
    rules = [Rule(r.get("scope", "all"), r.get("severity", "should"), r["description"]) for r in settings.get("constraints", {}).get("rules", [])]
    return repos, rules


def workflow_of(explicit: Column, session: Column) -> Column:
    """The call's workflow, else the session's, else ``explore``."""
    some = lambda c: F.when(c != "", c)
    return F.coalesce(some(explicit), some(session), F.lit("explore"))


def served_so_far(session: list[str], given: list[str]) -> list[str]:
    """What a session and a caller say was served: each once, in order."""
    return list(dict.fromkeys([*session, *given]))


def rerank(sections: DataFrame, vectors: DataFrame | None = None, query: list[float] | None = None) -> DataFrame:
    """The same sections with ``position``: by cosine to a query, or as they were.

    ``vectors`` has ``ref, embedding``; a section without one keeps its score's
    place after those with one.  Nothing is added, dropped or changed.
    """
    if vectors is None or not query:
        return sections
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding"))) * F.sqrt(dot(q, q))
    near = vectors.select("ref", F.when(norm > 0, dot(F.col("embedding"), q) / norm).alias("cosine"))
    return sections.join(near, "ref", "left").orderBy(F.col("cosine").desc_nulls_last(), F.col("score").desc(), "ref")


def changed_files(status: DataFrame) -> DataFrame:
    """``path`` of tracked files that differ from the last commit, sorted.

    ``status`` has one ``value`` for each line of ``git status --porcelain``.
    """
    path = F.regexp_replace(F.substring("value", 4, 1 << 30), r"^.* -> ", "")
    return status.where(~F.col("value").rlike(r"^(\?\?|!!)") & (F.length("value") > 3)).select(path.alias("path")).distinct().orderBy("path")


def branch_mismatch(stored: str, current: str) -> str | None:
    """A warning if the store was made on another branch."""
    return f"the store is of branch {stored!r}, the checkout of {current!r}" if stored and current and stored != current else None


def branch_differs(stored: Column, current: Column) -> Column:
    """Whether ``branch_mismatch`` warns of two branches."""
    named = lambda c: F.coalesce(c, F.lit("")) != ""
    return named(stored) & named(current) & ~stored.eqNullSafe(current)


def longest_prefix_dir(path: Column, depth: int = 2) -> Column:
    """The first ``depth`` folders of a path."""
    return F.array_join(F.slice(F.split(path, "/"), 1, depth), "/")
