"""Sections for a prompt: what a module's rules, history and warnings say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotlog.operators.reports import longest_module_in, severity_rank

SECTIONS = "section string, position long, text string"


def _numbered(rows: DataFrame, section: str, order: list, line, most: int) -> DataFrame:
    """The first ``most`` rows of a section as numbered lines."""
    from pyspark.sql import Window

    top = rows.orderBy(*order).limit(most)
    n = F.row_number().over(Window.orderBy(*order))  # of at most ``most`` rows
    return top.select(F.lit(section).alias("section"), n.cast("long").alias("position"), line.alias("text"))


def proactive(query: str, nodes: DataFrame, decisions: DataFrame, evolution: DataFrame, most: int = 10) -> DataFrame:
    """``section, position, text`` for the longest module that a query names; empty if none.

    Rules are its linked or global decisions, history its last changes, warnings
    its must-decisions.  ``decisions`` has ``id, title, severity, scope, files``.
    """
    module = longest_module_in(query, nodes)
    own_files = nodes.join(F.broadcast(module), "module", "left_semi").select("file_path")
    linked = decisions.select("id", "title", "severity", F.explode("files").alias("file_path")).join(own_files, "file_path", "left_semi").select("id", "title", "severity").distinct()
    rules = _numbered(linked, "rules", [severity_rank(F.col("severity")), F.col("id")], F.concat_ws(" ", F.col("severity"), F.col("title")), most)
    warnings = _numbered(linked.where("severity = 'must'"), "warnings", [F.col("id")], F.col("title"), most)
    changes = evolution.join(own_files.withColumnRenamed("file_path", "node_id"), "node_id", "left_semi")
    past = _numbered(changes, "history", [F.col("timestamp").desc(), F.col("node_id")], F.concat_ws(" ", F.col("change_type"), F.col("node_id")), most)
    return rules.unionByName(past).unionByName(warnings)


def sections(names: list[str], renderers: dict[str, Callable[[], str]]) -> list[str]:
    """Texts of the named sections in order; a name without a renderer is left out."""
    return [renderers[n]() for n in names if n in renderers]
