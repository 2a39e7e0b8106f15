"""Commits of a repository as rows: one for each file of each commit.

``read_log`` reads text that ``export`` or ``git log`` (in ``FORMAT``) left in
any folder Spark reaches; its records are split over tasks by Spark's own text
reader.  ``GitLog`` reads a repository that is mounted on the executors, some
hundred commits a task; register it with ``spark.dataSource.register(GitLog)``.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from knotlog.functions.text import commit_decision_id, commit_decision_title, commit_type, is_commit_decision

SCHEMA = "sha string, author string, time string, message string, action string, path string"
#: Options of ``git log`` that make the text read here.
FORMAT = ["--name-status", "--format=%x01%H%x02%an%x02%aI%x02%B%x03"]
#: Only so many days and commits count as recent.
RECENT_DAYS, RECENT_COMMITS = 90, 200


def parse_log(text: str) -> Iterator[tuple]:
    """Rows of an exported log: one for each file of each commit."""
    for record in text.split("\x01")[1:]:
        head, _, files = record.partition("\x03")
        sha, author, time, message = head.split("\x02", 3)
        for line in files.splitlines():
            parts = line.split("\t")
            if len(parts) >= 2:
                yield sha, author, time, message.strip(), parts[0][:1], parts[-1]


def read_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of exported logs, by built-in functions; a record is a line of the reader."""
    raw = spark.read.option("lineSep", "\x01").text(path)
    part = lambda c, mark, n: F.split_part(c, F.lit(mark), F.lit(n))
    head, files = part(F.col("value"), "\x03", 1), part(F.col("value"), "\x03", 2)
    one = raw.where(F.contains("value", F.lit("\x03"))).select(
        part(head, "\x02", 1).alias("sha"), part(head, "\x02", 2).alias("author"), part(head, "\x02", 3).alias("time"), F.btrim(part(head, "\x02", 4), F.lit(" \t\r\n")).alias("message"),
        F.explode(F.split(files, "\r?\n")).alias("line"),
    )
    parts = F.split("line", "\t")
    return one.where(F.size(parts) >= 2).select("sha", "author", "time", "message", F.substring(F.get(parts, F.lit(0)), 1, 1).alias("action"), F.element_at(parts, -1).alias("path"))


def _git(repository: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repository, *args], capture_output=True, text=True, errors="replace", check=True).stdout


class _Part(InputPartition):
    def __init__(self, head: str, first: int):
        self.head, self.first = head, first


class _Reader(DataSourceReader):
    """Stretches of the history of one commit, by their place in it; the driver learns only how long it is."""

    def __init__(self, options: dict):
        self.repository, self.size = options["path"], int(options.get("commits", 500))
        self.only = [f"--since={options['since']}"] if "since" in options else []

    def partitions(self) -> list[InputPartition]:
        head = _git(self.repository, "rev-parse", "--verify", "HEAD").strip()
        n = int(_git(self.repository, "rev-list", "--count", *self.only, head))
        return [_Part(head, i) for i in range(0, n, self.size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from parse_log(_git(self.repository, "log", f"--skip={partition.first}", f"--max-count={self.size}", *self.only, *FORMAT, partition.head))


class GitLog(DataSource):
    """Format ``gitlog``: ``path`` is a repository; ``since`` bounds the commits, ``commits`` a task's."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def recent(rows: DataFrame, now: Column) -> DataFrame:
    """File changes of recent commits, with ``change_type``; the newest commits count."""
    times = rows.withColumn("time", F.to_timestamp("time"))
    window = times.where(F.col("time") >= now - F.make_interval(days=F.lit(RECENT_DAYS)))
    keep = window.select("sha", "time").distinct().orderBy(F.col("time").desc(), "sha").limit(RECENT_COMMITS).select("sha")
    return window.join(F.broadcast(keep), "sha").withColumn("change_type", commit_type(F.col("message")))


def commit_decisions(rows: DataFrame) -> DataFrame:
    """Commits whose subject marks a decision, as decisions."""
    one = rows.where("sha <> ''").select("sha", "message").distinct().where(is_commit_decision(F.col("message")))
    return one.select(commit_decision_id(F.col("sha")).alias("id"), commit_decision_title(F.col("message")).alias("title"), F.col("message").alias("body"), F.lit("should").alias("severity"), F.lit("global").alias("scope"), F.lit("commit").alias("source"))
