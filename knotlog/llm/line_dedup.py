"""Line dedup (operator 1), with DataFrame functions only.

Lines are exploded, normalised and hashed; distinct documents are counted per
hash; hashes over the threshold mark their lines by position; each document is
put together again from the positions that stay.

Scale: what is shuffled for the count is two hashes and an id for each long
line, summed before each exchange, so one line held by a third of all documents
is no hot task.  The frequent lines are written to the shared folder; they are
broadcast only if counted and found small, otherwise both sides of the join are
plain exchanges that adaptive execution can split.  The text itself moves once.

Defined cases: a null or empty text is one empty line.  Rows that share an id
count as one document.  Rows with a null id count for no line and lose none.
Repeated rows are treated alike.  Other columns pass through; one named as an
output column is replaced.  The 128-bit line hash is taken as exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotlog.llm._common import table, written

MIN_CHARS = 40
MIN_DOCS = 5
#: Frequent lines that are broadcast at most (24 bytes each).
BROADCAST_ROWS = 200_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """A line stripped of space and 0x09-0x0D at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), _UPPER, _UPPER.lower())


def line_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, prefix: str = "") -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and the text that stays, ``kept``.

    ``prefix`` goes before these names, for tables that have such columns.
    """
    mark = F.xxhash64(F.lit(3), F.col(text))
    # the mark is made below the explode, so once a text and not once a line
    split = docs.select(F.col(id).alias("doc"), mark.alias("mark"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("lines"))
    lines = split.select("doc", "mark", F.posexplode_outer("lines").alias("pos", "line"))  # outer: else a filter would split each text again
    keyed = lines.where(F.col("doc").isNotNull() & (F.length("line") >= min_chars)).withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    hashed = keyed.select("doc", "mark", "pos", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"))

    in_doc = hashed.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one"))
    frequent = in_doc.groupBy("h1", "h2").agg(F.count("one").alias("n"), F.max("doc").alias("last")).where(F.col("n") >= min_docs).select("h1", "h2", "last")
    frequent = written(frequent, "frequent-lines")
    if frequent.count() <= BROADCAST_ROWS:
        frequent = F.broadcast(frequent)
    hits = hashed.join(frequent, ["h1", "h2"]).where(F.col("doc") != F.col("last"))
    dropped = hits.groupBy("doc", "mark").agg(F.collect_list("pos").alias("gone"))

    new = [f"{prefix}{c}" for c in ("n_lines", "n_dropped", "kept")]
    row = docs.select(F.struct(*[c for c in docs.columns if c not in new]).alias("row"), F.col(id).alias("doc"), mark.alias("mark"))
    own = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    hit = row.join(dropped, ["doc", "mark"], "left").withColumn("split", F.split(own, "\n"))
    hit = hit.withColumn("left", F.when(F.col("gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("split") - 1), F.col("gone"))))
    kept = F.when(F.col("gone").isNull(), own).otherwise(F.array_join(F.transform(F.col("left"), lambda i: F.get(F.col("split"), i)), "\n"))
    n_dropped = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("split") - F.size("left")).cast("long")
    out = hit.select("row", F.struct(F.size("split").cast("long").alias("a"), n_dropped.alias("b"), kept.alias("c")).alias("out"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in new], *[F.col(f"out.{x}").alias(n) for x, n in zip("abc", new, strict=True)])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document, how many go, and a digest of what stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (f.k IS NOT NULL AND doc_id <> f.last) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.k IS NULL OR doc_id = f.last), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f ON keyed.k = f.k
GROUP BY doc_id
"""
