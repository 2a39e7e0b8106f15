"""Markdown pages of what is known, made as rows and written by Spark.

A page is a set of lines with a part and a place in it, so pages of any length
and number (one for each module) are sorted and written by many tasks; nothing
is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotlog.operators import reports

LINES = ["page", "part", "order", "line"]


def _heading(spark, page: str, part: int, *lines: str) -> DataFrame:
    return spark.createDataFrame([(page, part, f"{i:04d}", x) for i, x in enumerate(lines)], "page string, part int, order string, line string")


def _rows(rows: DataFrame, page: Column | str, part: int, order: Column, line: Column) -> DataFrame:
    page = F.lit(page) if isinstance(page, str) else page
    return rows.select(page.alias("page"), F.lit(part).alias("part"), F.concat(F.lit("~"), order.cast("string")).alias("order"), line.alias("line"))


def _cells(*columns: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), F.lit(" |"))


def module_page(module: Column) -> Column:
    """Path of a module's page."""
    return F.concat(F.lit("MODULES/"), F.replace(module, F.lit("/"), F.lit("_")), F.lit(".md"))


def pages(nodes: DataFrame, relations: DataFrame, decisions: DataFrame, fans: DataFrame | None = None) -> DataFrame:
    """``page, part, order, line`` of the overview pages and of a page for each module.

    ``fans`` (``reports.fan_counts``) adds the quick reference of the page for
    assistants; without it that page has no topology.
    """
    spark, head = nodes.sparkSession, _heading
    stability = F.format_number("stability", 2)
    summary = reports.module_summary(nodes, relations)
    parts = [
        head(spark, "ARCHITECTURE.md", 0, "# Architecture", "", "## Modules", "", "| Module | Files | Stability | Depends on |", "|---|---|---|---|"),
        _rows(summary, "ARCHITECTURE.md", 0, F.col("module"), _cells(F.col("module"), F.col("files"), stability, F.array_join("deps", ", "))),
        head(spark, "ARCHITECTURE.md", 1, "", "## Languages", ""),
        _rows(reports.count_by(nodes, "language").where("language <> ''"), "ARCHITECTURE.md", 1, F.col("language"), F.concat(F.lit("- "), "language", F.lit(": "), F.col("n").cast("string"), F.lit(" files"))),
        head(spark, "CONVENTIONS.md", 0, "# Conventions", "", "| Role | Files |", "|---|---|"),
        _rows(reports.count_by(nodes, "class"), "CONVENTIONS.md", 0, F.col("class"), _cells(F.col("class"), F.col("n"))),
        head(spark, "HISTORY.md", 0, "# History", "", "## Least stable files", "", "| File | Stability |", "|---|---|"),
        _rows(reports.volatile_first(nodes), "HISTORY.md", 0, F.concat(F.format_string("%012.6f", F.col("stability")), F.col("file_path")), _cells(F.col("file_path"), stability)),
        head(spark, "CONSTRAINTS.md", 0, "# Constraints", ""),
        _rows(reports.inferred_constraints(nodes), "CONSTRAINTS.md", 0, F.col("scope"), F.concat(F.lit("- **"), "severity", F.lit("** "), "scope", F.lit(": "), "description")),
        head(spark, "DECISIONS.md", 0, "# Decisions", ""),
        _rows(decisions, "DECISIONS.md", 0, F.concat(reports.severity_rank(F.col("severity")).cast("string"), F.col("id")), F.concat(F.lit("- **"), "severity", F.lit("** "), F.coalesce("title", "id"))),
        _rows(nodes.select("module").distinct(), module_page(F.col("module")), 0, F.lit(""), F.concat(F.lit("# "), "module", F.lit("\n\n| File | Role | Stability |\n|---|---|---|"))),
        _rows(nodes, module_page(F.col("module")), 1, F.col("file_path"), _cells(F.col("file_path"), F.col("class"), stability)),
        head(spark, "AGENTS.md", 0, "# Working in this repository", "", "Read the pages beside this one before changing code.", ""),
    ]
    if fans is not None:
        for part, (title, rows, order, line) in enumerate((
            ("Entry points", reports.entry_points(fans), F.col("ref"), F.regexp_replace("ref", "^e:", "")),
            ("Core modules", reports.core_modules(fans), F.format_string("%012d", 999_999_999_999 - F.col("incoming")), F.col("module")),
            ("Files with most rules", reports.hotspots(fans), F.col("ref"), F.regexp_replace("ref", "^e:", "")),
        ), 1):
            parts += [head(spark, "AGENTS.md", part, f"## {title}", ""), _rows(rows, "AGENTS.md", part, order, F.concat(F.lit("- "), line))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_pages(lines: DataFrame, folder: str) -> None:
    """Writes each page as text under ``folder/page=<page>``, its lines in order."""
    lines.repartition("page").sortWithinPartitions("page", "part", "order").select("page", F.col("line").alias("value")).write.mode("overwrite").partitionBy("page").text(folder)


def page_text(lines: DataFrame, page: str) -> str:
    """One page's text, for a reader that wants it whole."""
    return "\n".join(r["line"] for r in lines.where(F.col("page") == page).orderBy("part", "order").collect()) + "\n"
