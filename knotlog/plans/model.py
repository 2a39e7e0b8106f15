"""The driver's tables seen as log, graph, nodes, decisions and sessions.

Each function has the DuckDB text of the same view beside it, so queries over
the model can be checked in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by folder and name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', cast({column} AS TIMESTAMP_NTZ))")


def _ref(kind: str, column: str) -> Column:
    return F.concat(F.lit(f"e:{kind}/"), F.col(column).cast("string"))


def links(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("placed", "contains", "supplied_by", "located_in", "part_of")) -> DataFrame:
    """All versions of the links between customers, orders, parts, suppliers, nations and regions."""
    parts: list[DataFrame] = []
    one, active = F.lit(1).cast("long"), F.lit("active")

    def add(df: DataFrame, src: Column, edge: str, dst: Column, version: Column, at: Column, life: Column) -> None:
        parts.append(df.select(src.alias("src_ref"), F.lit(edge).alias("edge_type"), dst.alias("dst_ref"), version.alias("version"), (at * 1000).alias("created_at_nanos"), life.alias("lifecycle")))

    if "placed" in kinds:
        add(table(spark, sf_dir, "orders"), _ref("c", "o_custkey"), "placed", _ref("o", "o_orderkey"), one, micros("o_orderdate"), active)
    items = table(spark, sf_dir, "lineitem")
    life = F.when(F.col("l_returnflag") == "R", F.lit("superseded")).otherwise(active)
    for edge, kind, key in (("contains", "p", "l_partkey"), ("supplied_by", "s", "l_suppkey")):
        if edge in kinds:
            # versions of a triple by its references themselves, so that conditions on either end go before the exchange
            w = Window.partitionBy("src_ref", "dst_ref").orderBy("l_shipdate", "l_linenumber")
            ends = items.select(_ref("o", "l_orderkey").alias("src_ref"), _ref(kind, key).alias("dst_ref"), "l_shipdate", "l_linenumber", "l_returnflag")
            add(ends, F.col("src_ref"), edge, F.col("dst_ref"), F.row_number().over(w).cast("long"), micros("l_shipdate"), life)
    zero = F.lit(0).cast("long")
    if "located_in" in kinds:
        add(table(spark, sf_dir, "customer"), _ref("c", "c_custkey"), "located_in", _ref("n", "c_nationkey"), one, zero, active)
        add(table(spark, sf_dir, "supplier"), _ref("s", "s_suppkey"), "located_in", _ref("n", "s_nationkey"), one, zero, active)
    if "part_of" in kinds:
        add(table(spark, sf_dir, "nation"), _ref("n", "n_nationkey"), "part_of", _ref("r", "n_regionkey"), one, zero, active)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


LINKS = """links AS (
  SELECT 'e:c/' || o_custkey AS src_ref, 'placed' AS edge_type, 'e:o/' || o_orderkey AS dst_ref, 1::BIGINT AS version,
         epoch_us(o_orderdate) * 1000 AS created_at_nanos, 'active' AS lifecycle FROM orders
  UNION ALL
  SELECT 'e:o/' || l_orderkey, 'contains', 'e:p/' || l_partkey,
         row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_shipdate, l_linenumber),
         epoch_us(l_shipdate) * 1000, CASE WHEN l_returnflag = 'R' THEN 'superseded' ELSE 'active' END FROM lineitem
  UNION ALL
  SELECT 'e:o/' || l_orderkey, 'supplied_by', 'e:s/' || l_suppkey,
         row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_shipdate, l_linenumber),
         epoch_us(l_shipdate) * 1000, CASE WHEN l_returnflag = 'R' THEN 'superseded' ELSE 'active' END FROM lineitem
  UNION ALL SELECT 'e:c/' || c_custkey, 'located_in', 'e:n/' || c_nationkey, 1, 0, 'active' FROM customer
  UNION ALL SELECT 'e:s/' || s_suppkey, 'located_in', 'e:n/' || s_nationkey, 1, 0, 'active' FROM supplier
  UNION ALL SELECT 'e:n/' || n_nationkey, 'part_of', 'e:r/' || n_regionkey, 1, 0, 'active' FROM nation
)"""


def active_sql(where: str = "true") -> str:
    """SQL of the active links that pass a filter on versions."""
    return f"""active AS (
  SELECT src_ref, edge_type, dst_ref FROM links WHERE {where}
  GROUP BY src_ref, edge_type, dst_ref HAVING arg_max(lifecycle, version) <> 'superseded'
)"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of observations: one chain for each user and type."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return e.select(
        F.lit("observation").alias("kind"), F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("id"),
        F.row_number().over(w).cast("long").alias("version"), (micros("ts") * 1000).alias("created_at_nanos"),
        F.when(F.col("event_type") == "error", "superseded").otherwise("active").alias("lifecycle"), "event_id", "value",
    )


EVENT_LOG = """log AS (
  SELECT 'observation' AS kind, user_id || ':' || event_type AS id,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS version,
         epoch_us(ts) * 1000 AS created_at_nanos,
         CASE WHEN event_type = 'error' THEN 'superseded' ELSE 'active' END AS lifecycle, event_id, value
  FROM events
)"""


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as versions of their order by line number: times are not in order."""
    i = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_shipdate")
    return i.select(F.lit("entity").alias("kind"), F.col("l_orderkey").cast("string").alias("id"), F.row_number().over(w).cast("long").alias("version"), (micros("l_shipdate") * 1000).alias("created_at_nanos"), "l_partkey")


ORDER_LOG = """log AS (
  SELECT 'entity' AS kind, l_orderkey::VARCHAR AS id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_shipdate) AS version,
         epoch_us(l_shipdate) * 1000 AS created_at_nanos, l_partkey
  FROM lineitem
)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nodes; role and stability follow from a document's numbers."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    return d.select(
        F.concat(F.lit("kn:doc_"), n.cast("string")).alias("id"), F.lit("file").alias("type"), F.concat(F.lit("doc_"), n.cast("string")).alias("name"),
        F.concat(F.col("source"), F.lit("/doc_"), n.cast("string")).alias("file_path"), F.col("lang").alias("language"), F.col("source").alias("module"),
        F.when(n % 3 == 0, "test").otherwise("source").alias("class"), ((F.col("n_chars") % 11) / F.lit(10.0)).alias("stability"),
        F.when(n % 17 == 0, "deleted").otherwise("active").alias("status"), F.sha2("text", 256).alias("content_hash"),
        (n % 4).cast("long").alias("entities"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.concat(F.lit("2024-01-"), F.lpad(((n % 28) + 1).cast("string"), 2, "0")).alias("updated_at"), n.alias("doc_id"),
    )


NODES = """nodes AS (
  SELECT 'kn:doc_' || doc_id AS id, 'file' AS type, 'doc_' || doc_id AS name, source || '/doc_' || doc_id AS file_path,
         lang AS language, source AS module, CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'source' END AS class,
         (n_chars % 11) / 10.0::DOUBLE AS stability, CASE WHEN doc_id % 17 = 0 THEN 'deleted' ELSE 'active' END AS status,
         sha256(text) AS content_hash, doc_id % 4 AS entities, '2024-01-01T00:00:00Z' AS created_at,
         '2024-01-' || lpad(((doc_id % 28) + 1)::VARCHAR, 2, '0') AS updated_at, doc_id
  FROM documents
)"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import relations between documents, by arithmetic on their numbers."""
    d = nodes(spark, sf_dir).select("doc_id", "file_path")
    src = d.select("doc_id", F.col("file_path").alias("source_node_id"), F.explode(F.array(F.lit(1), F.lit(5), F.lit(13))).alias("step"))
    hop = src.select("source_node_id", "step", (F.floor(F.col("doc_id") / F.col("step")) + F.col("step")).cast("long").alias("doc_id"))
    return hop.join(d.withColumnRenamed("file_path", "target_node_id"), "doc_id").select(F.concat_ws("#", "source_node_id", "step").alias("id"), "source_node_id", "target_node_id", F.when(F.col("step") == 5, "depends_on").otherwise("imports").alias("type"))


RELATIONS = """relations AS (
  SELECT s.file_path || '#' || step AS id, s.file_path AS source_node_id, t.file_path AS target_node_id,
         CASE WHEN step = 5 THEN 'depends_on' ELSE 'imports' END AS type
  FROM (SELECT doc_id, file_path, unnest([1, 5, 13]) AS step FROM nodes) s
  JOIN nodes t ON t.doc_id = s.doc_id // s.step + s.step
)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as decisions."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), F.col("source"), F.col("text").alias("body"),
        F.when(F.col("quality") == 0, "may").when(F.col("toxic") == 1, "should").otherwise("must").alias("severity"),
        F.when(F.col("lang") == "en", "global").when(F.col("lang") == "fr", "module").otherwise("file").alias("scope"),
        F.when(F.col("doc_id") % 9 == 0, "superseded").otherwise("active").alias("lifecycle"), "doc_id",
    )


DECISIONS = """decisions AS (
  SELECT 'doc_' || doc_id AS id, source, text AS body,
         CASE WHEN quality = 0 THEN 'may' WHEN toxic = 1 THEN 'should' ELSE 'must' END AS severity,
         CASE lang WHEN 'en' THEN 'global' WHEN 'fr' THEN 'module' ELSE 'file' END AS scope,
         CASE WHEN doc_id % 9 = 0 THEN 'superseded' ELSE 'active' END AS lifecycle, doc_id
  FROM documents JOIN labels USING (doc_id)
)"""


def knowledge_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import links of documents and decision links into labelled ones."""
    r = relations(spark, sf_dir).where("type = 'imports'").select(F.concat(F.lit("e:"), "source_node_id").alias("src_ref"), F.lit("imports").alias("edge_type"), F.concat(F.lit("e:"), "target_node_id").alias("dst_ref"))
    n = nodes(spark, sf_dir).select("doc_id", "file_path")
    d = decisions(spark, sf_dir).select("id", F.floor(F.col("doc_id") / 8).cast("long").alias("doc_id"))
    return r.distinct().unionByName(d.join(n, "doc_id").select(F.concat(F.lit("e:"), "file_path").alias("src_ref"), F.lit("decision_link").alias("edge_type"), F.concat(F.lit("d:"), "id").alias("dst_ref")))


KNOWLEDGE_LINKS = """klinks AS (
  SELECT DISTINCT 'e:' || source_node_id AS src_ref, 'imports' AS edge_type, 'e:' || target_node_id AS dst_ref
  FROM relations WHERE type = 'imports'
  UNION ALL
  SELECT 'e:' || n.file_path, 'decision_link', 'd:' || d.id FROM decisions d JOIN nodes n ON n.doc_id = d.doc_id // 8
)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as calls: ``session, call, tool, created_at`` (a number)."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("call"), F.col("role").alias("tool"), (F.col("conv_id") * 100 + F.col("turn")).alias("created_at"), "conv_id", "turn")


def served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``session, call, ref``: what each call served, by arithmetic."""
    n = table(spark, sf_dir, "documents").agg((F.max("doc_id") + 1).alias("n")).first()["n"] or 1
    number = (F.col("conv_id") * 7 + F.col("turn") * 3) % F.lit(n)
    ref = F.concat(F.when(F.col("turn") % 2 == 0, "e:d/").otherwise("d:d/"), number.cast("string"))
    return calls(spark, sf_dir).select("session", "call", ref.alias("ref"), "created_at")


CALLS = """calls AS (
  SELECT 's' || conv_id AS session, conv_id || '/' || turn AS call, role AS tool, conv_id * 100 + turn AS created_at,
         CASE WHEN turn % 2 = 0 THEN 'e:d/' ELSE 'd:d/' END || ((conv_id * 7 + turn * 3) % (SELECT max(doc_id) + 1 FROM documents)) AS ref,
         conv_id, turn
  FROM conversations
)"""
