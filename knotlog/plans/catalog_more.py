"""More registered queries: sources, indexes, sessions and outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotlog.functions import paths
from knotlog.operators import eventlog, federation, fieldindex, reports
from knotlog.plans import dsl, model, requests
from knotlog.plans.catalog import query
from knotlog.plans.model import CALLS, NODES, table
from knotlog.plans.stored import stored
from knotlog.sources import collections, entities, files, pages

# --- files made of the tables' rows ----------------------------------------


def _files(rows: DataFrame, path: Column, content: Column) -> DataFrame:
    return rows.select(path.alias("path"), F.encode(content, "UTF-8").alias("content"))


def _go_files(s: SparkSession, d: str) -> DataFrame:
    """A Go file for each part: two imports, a function, a type and a constant."""
    k = F.col("p_partkey").cast("string")
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    source = F.concat(F.lit('package p\n\nimport (\n\t"fmt"\n\tx "example.com/'), brand, F.lit('"\n)\n\n// func No() {\nfunc F'), k, F.lit("() string {\n\treturn \"}\"\n}\n\ntype t"), k, F.lit(" struct {\n\tn int\n}\n\nconst Size"), k, F.lit(" = "), F.col("p_size").cast("string"), F.lit("\n"))
    return _files(table(s, d, "part"), F.concat(F.lit("pkg/f"), k, F.lit(".go")), source)


@query("import_extraction", "SELECT 'pkg/f' || p_partkey || '.go' AS path, unnest(['fmt', 'example.com/' || lower(replace(p_brand, '#', ''))]) AS import_path FROM part")
def _(s, d):
    return files.imports(_go_files(s, d))


@query("import_links", "SELECT 'e:pkg/f' || p_partkey || '.go' AS src_ref, 'imports' AS edge_type, 'e:' || unnest(['fmt', 'example.com/' || lower(replace(p_brand, '#', ''))]) AS dst_ref FROM part")
def _(s, d):
    return files.import_links(_go_files(s, d))


@query("source_entities", """SELECT 'pkg/f' || p_partkey || '.go' AS path, unnest(['function', 'struct', 'constant']) AS kind, unnest(['F' || p_partkey, 't' || p_partkey, 'Size' || p_partkey]) AS name,
  unnest([true, false, true]) AS exported, unnest([9, 13, 17]::INTEGER[]) AS line, unnest([11, 15, 17]::INTEGER[]) AS end_line FROM part""")
def _(s, d):
    return entities.entities(_go_files(s, d)).select("path", "kind", "name", "exported", "line", "end_line")


@query("go_module_paths", "SELECT 's' || s_suppkey || '/go.mod' AS path, 'example.com/' || lower(replace(replace(s_name, '#', '_'), ' ', '_')) AS module_path FROM supplier")
def _(s, d):
    name = F.lower(F.replace(F.replace("s_name", F.lit("#"), F.lit("_")), F.lit(" "), F.lit("_")))
    mods = _files(table(s, d, "supplier"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("/go.mod")), F.concat(F.lit("// x\nmodule example.com/"), name, F.lit("\n\ngo 1.22\n")))
    return files.go_module(mods)


@query("adr_source", "SELECT 'adr:' || doc_id AS id, 'Use ' || lang AS title, 'must' AS severity, 'docs/adr/' || doc_id || '.md' AS file FROM documents")
def _(s, d):
    k = F.col("doc_id").cast("string")
    own = _files(table(s, d, "documents"), F.concat(F.lit("docs/adr/"), k, F.lit(".md")), F.concat(F.lit("\n# Use "), "lang", F.lit("\nbody\n")))
    return files.adr_decisions(own).select("id", "title", "severity", "file")


@query("doc_sections", "SELECT 'doc:' || doc_id || ':' || unnest(['first-part', 'of-' || lang]) AS id, unnest(['First part', 'Of ' || lang]) AS title, 'global' AS scope FROM documents")
def _(s, d):
    k = F.col("doc_id").cast("string")
    own = _files(table(s, d, "documents"), F.concat(F.lit("docs/"), k, F.lit(".md")), F.concat(F.lit("# T\n## First part\nx\n## Of "), "lang", F.lit("\ny\n")))
    return files.doc_decisions(own).select("id", "title", "scope")


@query("file_nodes", "SELECT 'pkg/f' || p_partkey || '.go' AS id, 'Go' AS language, 'pkg' AS module, 'source' AS class, 'f' || p_partkey || '.go' AS name FROM part")
def _(s, d):
    own = _go_files(s, d).withColumn("hash", F.sha2("content", 256))
    return files.nodes(own, F.lit("now")).select("id", "language", "module", "class", "name")


@query("exclude_glob", f"WITH {NODES} SELECT id FROM nodes WHERE NOT (regexp_full_match(file_path, 'src1[^/]/doc_[^/]*') OR regexp_full_match(name, '[^/]*_[^/]7'))")
def _(s, d):
    return model.nodes(s, d).where(~paths.excluded(F.col("file_path"), ["src1?/doc_*", "*_?7"])).select("id")


@query("changed_files", "SELECT source || '/new_' || doc_id AS path FROM documents WHERE doc_id % 3 <> 0")
def _(s, d):
    name = F.concat("source", F.lit("/new_"), F.col("doc_id").cast("string"))
    line = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("?? "), name)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" M "), name)).otherwise(F.concat(F.lit("R  old -> "), name))
    return requests.changed_files(table(s, d, "documents").select(line.alias("value")))


# --- indexes and the query language ----------------------------------------


@query("index_lookup", "SELECT 'kn:doc_' || doc_id AS id FROM documents WHERE lang = 'fr'")
def _(s, d):
    index = stored(s, d, "nodes-language", lambda path: fieldindex.FieldIndex.build(model.nodes(s, d), "language", path))
    return index.rows(model.nodes(s, d), ["fr"]).select("id")


@query("dsl_dotted", "SELECT doc_id::VARCHAR AS id, lang FROM documents WHERE lang = 'de'")
def _(s, d):
    registry = dsl.Registry()
    registry.add_collection("papers", {"id": "string", "meta.lang": "string"})
    rows = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("meta.lang"))
    return dsl.compile_query(dsl.parse("papers where meta.lang = 'de'"), rows, registry=registry).select("id", F.col("`meta.lang`").alias("lang"))


@query("append_links", "SELECT 'e\\cc/' || o_custkey || ':placed:e\\co/' || o_orderkey AS id, 1::BIGINT AS version, 'active' AS lifecycle FROM orders".replace("\\c", "' || chr(92) || 'c"))
def _(s, d):
    new = model.links(s, d, ("placed",)).select("src_ref", "edge_type", "dst_ref", "created_at_nanos", F.lit(None).cast("string").alias("lifecycle"))
    return eventlog.append_links(None, new, [F.col("created_at_nanos")]).select("id", "version", "lifecycle")


# --- sessions --------------------------------------------------------------


@query("session_observations", f"WITH {CALLS} SELECT call AS id, 'call' AS action, any_value(tool) AS subject FROM calls GROUP BY 1 UNION ALL SELECT DISTINCT session, 'session', '' FROM calls")
def _(s, d):
    from knotlog.streaming.collector import observations

    return observations(model.calls(s, d)).select("id", "action", "subject")


@query("session_workflow", f"WITH {CALLS} SELECT call, CASE WHEN tool = 'user' THEN 'review' WHEN conv_id % 2 = 0 THEN 'test' ELSE 'explore' END AS workflow FROM calls")
def _(s, d):
    explicit, session = F.when(F.col("tool") == "user", "review").otherwise(""), F.when(F.col("conv_id") % 2 == 0, "test").otherwise("")
    return model.calls(s, d).select("call", requests.workflow_of(explicit, session).alias("workflow"))


# --- reports and outputs ---------------------------------------------------


@query("json_output", """SELECT '{"id":"kn:doc_' || doc_id || '","language":"' || lang || '"}' AS value FROM documents""")
def _(s, d):
    return collections.as_json(model.nodes(s, d).select("id", "language", F.lit(None).cast("string").alias("gone")))


@query("entry_point_files", "SELECT doc_id, (doc_id % 4 = 0 OR doc_id % 4 = 1 AND lang = 'en' OR doc_id % 4 = 2) AS entry FROM documents")
def _(s, d):
    k = F.col("doc_id")
    path = F.when(k % 4 == 0, F.concat(F.lit("x"), k.cast("string"), F.lit("/main.go"))).when(k % 4 == 1, F.lit("cmd/tool/run.go")).otherwise(F.lit("lib/a.go"))
    role = F.when(k % 4 == 2, "api").when(F.col("lang") == "en", "source").otherwise("doc")
    return table(s, d, "documents").select("doc_id", reports.is_entry_point(path, role).alias("entry"))


@query("cross_repo_filter", """WITH i AS (SELECT p_partkey::VARCHAR AS source_node_id, 'example.com/' || lower(replace(p_brand, '#', '')) || '/' || p_size AS import_path FROM part), m AS (SELECT DISTINCT 'example.com/' || lower(replace(p_brand, '#', '')) AS module_path, p_brand AS repo FROM part)
SELECT source_node_id, repo AS target_repo FROM i JOIN m ON starts_with(import_path, module_path) WHERE starts_with(regexp_replace(substr(import_path, length(module_path) + 1), '^/', ''), '1') AND repo = 'Brand#11'""")
def _(s, d):
    from knotlog.plans.catalog import _imports

    mods = table(s, d, "part").select(F.concat(F.lit("example.com/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))).alias("module_path"), F.col("p_brand").alias("repo")).distinct()
    deps = federation.cross_repo_deps(_imports(s, d), mods)
    return federation.filter_deps(deps, module="1", direction="incoming", repo="Brand#11").select("source_node_id", "target_repo")


@query("module_pages", f"""WITH {NODES} SELECT 'MODULES/' || replace(module, '/', '_') || '.md' AS page, '| ' || file_path || ' | ' || class || ' | ' || printf('%.2f', stability) || ' |' AS line FROM nodes""")
def _(s, d):
    none = s.createDataFrame([], "id string, severity string, title string")
    lines = pages.pages(model.nodes(s, d), model.relations(s, d), none)
    return lines.where("page LIKE 'MODULES/%' AND part = 1").select("page", "line")
