"""Scores of sections and the greedy budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from knotlog.functions.paths import dir_name

HALF_LIFE_DAYS = 30.0
DEFAULT_BUDGET = 2000


@dataclass(frozen=True)
class Profile:
    """Weights of the four scores, edge types to prefer, and by how much."""

    recency: float
    severity: float
    proximity: float
    novelty: float
    edges: tuple[str, ...] = ()
    boost: float = 0.0

    @property
    def total(self) -> float:
        """Sum of the weights."""
        return self.recency + self.severity + self.proximity + self.novelty

    def problems(self) -> list[str]:
        """What is wrong with a custom profile."""
        out = []
        if not 0.95 <= self.total <= 1.05:
            out.append(f"weights sum to {self.total:.3f}")
        if not 0 <= self.boost <= 1:
            out.append(f"boost {self.boost} outside [0, 1]")
        return out


#: The profile of each workflow; explore is the neutral one.
PROFILES = {
    "bugfix": Profile(0.20, 0.40, 0.30, 0.10, ("decision_link", "imports"), 0.15),
    "feature": Profile(0.20, 0.25, 0.30, 0.25, ("imports", "decision_link"), 0.15),
    "review": Profile(0.15, 0.40, 0.20, 0.25, ("decision_link",), 0.15),
    "refactor": Profile(0.15, 0.30, 0.40, 0.15, ("imports",), 0.15),
    "test": Profile(0.30, 0.20, 0.35, 0.15, ("imports",), 0.15),
    "explore": Profile(0.25, 0.35, 0.25, 0.15),
}


def recency(created: Column, now: Column) -> Column:
    """Halves every 30 days; 1 in the future, 0 without a time."""
    days = (F.unix_micros(now) - F.unix_micros(created)) / F.lit(86_400e6)
    return F.when(created.isNull(), F.lit(0.0)).when(days < 0, F.lit(1.0)).otherwise(F.pow(F.lit(2.0), -days / HALF_LIFE_DAYS))


def severity(kind: Column, level: Column) -> Column:
    """1.0, 0.6, 0.3 for must, should, may of a decision, else 0.5."""
    named = F.when(level == "must", 1.0).when(level == "should", 0.6).when(level == "may", 0.3).otherwise(0.5)
    return F.when(kind == "decision", named).otherwise(F.lit(0.5))


def proximity(path: Column, files: Column) -> Column:
    """1.0 for a file itself, 0.5 for its folder, else 0.2; the first file that says so decides."""
    own = dir_name(path)
    each = F.transform(files, lambda f: F.when(f == path, F.lit(1.0)).when((dir_name(f) == own) & (own != "."), F.lit(0.5)))
    found = F.get(F.filter(each, lambda x: x.isNotNull()), F.lit(0))
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit(0.2)).otherwise(F.coalesce(found, F.lit(0.2)))


def novelty(ref: Column, served: Column) -> Column:
    """0 for what was served already, else 1."""
    return F.when(F.array_contains(served, ref), F.lit(0.0)).otherwise(F.lit(1.0))


def total(profile: Profile, r: Column, s: Column, p: Column, n: Column) -> Column:
    """Weighted sum of the four scores."""
    return profile.recency * r + profile.severity * s + profile.proximity * p + profile.novelty * n


def boosted(score: Column, preferred: Column, boost: float) -> Column:
    """``score`` raised for preferred rows, and only then held to 0 and 1."""
    return F.when(preferred, F.least(F.greatest(score + boost, F.lit(0.0)), F.lit(1.0))).otherwise(score)


def fit_to_budget(tokens: Column, limit: Column) -> Column:
    """Which items (costs in order) are admitted: an item too large is skipped.

    An array of booleans; the fold goes on after a skip, so a later, smaller
    item can still fit.
    """
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("take"))

    def step(a: Column, t: Column) -> Column:
        ok = (limit > 0) & (a["used"] + t <= limit)
        return F.struct((a["used"] + F.when(ok, t).otherwise(0)).cast("long").alias("used"), F.concat(a["take"], F.array(F.coalesce(ok, F.lit(False)))).alias("take"))

    return F.aggregate(tokens, start, step, lambda a: a["take"])


def admitted_refs(items: Column, limit: int) -> Column:
    """References of the items (``s, depth, ref, tokens``, best first) that the greedy budget admits.

    The same fold as ``fit_to_budget``, which keeps what is admitted only.
    """
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("refs"))

    def step(a: Column, x: Column) -> Column:
        used = a["used"] + x["tokens"].cast("long")
        return F.when(used <= limit, F.struct(used.alias("used"), F.concat(a["refs"], F.array(x["ref"])).alias("refs"))).otherwise(a)

    return F.aggregate(items, start, step, lambda a: a["refs"])
