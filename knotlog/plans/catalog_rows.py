"""Registered queries that run text, path and parameter functions over rows of the tables.

Inputs are made of a row's own values, one of several forms by its id; the SQL
makes the same inputs and says what each form has to give.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from knotlog.functions import paths, scoring, text
from knotlog.operators import eventlog, federation, textindex
from knotlog.operators.asof import as_of_join
from knotlog.plans import dsl, model, requests
from knotlog.plans.catalog import SEARCH, _bm25_sql, query
from knotlog.plans.model import CALLS, EVENT_LOG, NODES, table
from knotlog.plans.stored import stored
from knotlog.sources import collections, files
from knotlog.sources.scratch import scratch_path
from knotlog.sources.store import Store

# --- functions of a text ----------------------------------------------------

_OWN = {"{d}": "doc_id", "{s}": "source", "{l}": "lang"}


def _column(form: str) -> Column:
    """A form with the row's values in place of its marks."""
    return F.concat(*[F.coalesce(F.col(_OWN[x]).cast("string"), F.lit("")) if x in _OWN else F.lit(x) for x in re.split(r"(\{[dsl]\})", form)])


def _sql(form: str | None) -> str:
    if form is None:
        return "NULL"
    return " || ".join(f"coalesce({_OWN[x]}::VARCHAR, '')" if x in _OWN else "'" + x.replace("'", "''") + "'" for x in re.split(r"(\{[dsl]\})", form))


def _by_turns(forms: list[str]) -> Column:
    k, out = F.pmod("doc_id", F.lit(len(forms))), None
    for i, f in enumerate(forms):
        out = F.when(k == i, _column(f)) if out is None else out.when(k == i, _column(f))
    return out


def _by_turns_sql(forms: list[str | None], end: str = "VARCHAR") -> str:
    cases = " ".join(f"WHEN {i} THEN ({_sql(f)})" for i, f in enumerate(forms))
    return f"CASE doc_id % {len(forms)} {cases} END::{end}"


def of_rows(name: str, forms: dict[str, str | None], column) -> None:
    """Registers a function of one text over texts made of documents."""
    sql = f"SELECT doc_id, {_by_turns_sql(list(forms))} AS input, {_by_turns_sql(list(forms.values()))} AS output FROM documents"
    made = lambda s, d: table(s, d, "documents").select("doc_id", _by_turns(list(forms)).alias("input"))
    query(name, sql)(lambda s, d: made(s, d).withColumn("output", column(F.col("input"))))


_joined = lambda c: F.array_join(text.tokenize(c), ",")
_bars = lambda *cs: F.concat(*[x for c in cs for x in (F.lit("|"), c)][1:])

of_rows("classify_paths", {
    "pkg/{s}/t{d}_test.go": "test", "web/{s}{d}.spec.ts": "test", "tests/test_{d}.py": "test", "a/io{d}_test.py": "test", "src/User{d}Test.java": "test", "deploy/{s}/Dockerfile": "infra",
    "main{d}.tf": "infra", "ops/k8s/pod{d}.yaml": "infra", "{s}/go.mod": "config", "conf/app{d}.toml": "config", "README{d}.md": "doc", "{s}/LICENSE": "doc", "img/logo{d}.png": "asset",
    "cmd/tool{d}/main.go": "entry_point", "web/api/users{d}.py": "api", "pkg/models/user{d}.go": "data_layer", "pkg/{s}/tree{d}.go": "source", "data/x{d}.json": "unknown", "strange{d}": "unknown",
}, paths.classify)
of_rows("detect_language", {"a/b{d}.go": "Go", "x{d}.PY": "Python", "{s}/y.tsx": "TypeScript", "z.unknown{d}": "", "{s}/Makefile": "", "q{d}.h": "C/C++ Header"}, paths.language)
of_rows("detect_module", {"main{d}.go": "(root)", "internal/{s}/tree.go": "internal/{s}", "a/src/{s}/c.py": "src/{s}", "docs/x{d}.md": "docs", "src/main{d}.py": "src", "x/pkg/{s}/lib/z/f.go": "pkg/{s}"}, paths.detect_module)
of_rows("slugify", {"Hello, {l} {d}!": "hello-{l}-{d}", "  A  {l}_c  ": "a-{l}-c", "Éa – {d}": "éa-{d}", "--": ""}, text.slugify)
of_rows("commit_type", {"feat: add {d}": "feat", "fix({s})!: bug": "fix", "Feat: {d}": "unknown", "docs:{d}": "unknown", "chore(a{d}): b\nfeat: c": "chore"}, text.commit_type)
of_rows("commit_decision", {"ADR: use {s}": "use {s}", "decision:{l}{d}\n\nbody": "{l}{d}", "rfc:": "rfc:"}, text.commit_decision_title)
of_rows("camel_split", {"{l}JSON": "{l},json,{l}json", "HTTPServer_{l}": "http,server,{l},httpserver_{l}", "error_code{d}": "error,code,{d},error_code{d}", "{l}": "{l}", "東京都 {l}": "東京,京都,{l}", "a東{l}": "a,東,{l}"}, _joined)
of_rows("cjk_terms", {"東京都庁 {l}": "東京,京都,都庁,{l}", "カード {d}": "カー,ード,{d}", "字{l}": "字,{l}", "한국어 {l}": "한국,국어,{l}", "{l}東京XyZ": "{l},東京,xy,z,xyz"}, _joined)
of_rows("file_anchor", {"x [file: {s}/b.go:{d}] y": "{s}/b.go", "[file: c{d}.py]": "c{d}.py", "none {d}": "", "[file: d:e{d}x]": "d:e{d}x"}, text.file_anchor)
of_rows("first_line", {"\n\n## Title {d} \nx": "Title {d}", "": "(untitled)", "# \n\nreal {s}": "real {s}"}, text.first_line)
of_rows("split_ref", {"e:{s}/b:v0000000000000003": "entity|{s}/b", "d:{d}": "decision|{d}", "q:{d}": None, "e:": None}, lambda c: _bars(text.split_ref(c)["kind"], text.split_ref(c)["id"]))
of_rows("escape_id", {"{s}:{d}": "{s}\\c{d}", "a\\{s}": "a\\\\{s}", "plain{d}": "plain{d}"}, text.escape_id)
of_rows("unescape_id", {"{s}\\c{d}": "{s}:{d}", "a\\\\{d}": "a\\{d}", "a\\\\c{d}": "a\\c{d}"}, text.unescape_id)
of_rows("annotations", {"// @kb-rule must-{l}: use {s}": "rule|must-{l}|use {s}|must", "  # @kb-lesson may-{d}": "lesson|may-{d}||may", "* @kb-rule {l}: b: c{d}": "rule|{l}|b: c{d}|should", "x = {d} // @kb-rule n: no": None, "// plain {d}": None}, lambda c: _bars(*[text.annotation(c, "@kb")[x] for x in ("type", "name", "description")], text.severity_of_name(text.annotation(c, "@kb")["name"])))
of_rows("h2_sections", {"# T\n## A{d}\nx\n## B\n{s}\nz": "A{d}=x;B={s}\nz", "none {d}": "", "## Only {l}": "Only {l}="}, lambda c: F.array_join(F.transform(text.h2_sections(c), lambda x: F.concat(x["title"], F.lit("="), x["body"])), ";"))
of_rows("severity_of_name", {"must-{d}": "must", "MAY-{l}": "may", "should-{d}": "should", "other{d}": "should"}, text.severity_of_name)
of_rows("session_test_files", {"a/io{d}_test.go": "true", "test_{s}.py": "true", "testdata/{d}.json": "true", "src/con{d}test.py": "false", "a/tests/{d}.txt": "true"}, lambda c: paths.is_session_test_file(c).cast("string"))
of_rows("scanner_test_files", {"pkg/a{d}_test.go": "true", "web/app{d}.spec.ts": "true", "tests/test_{d}.py": "true", "src/main{d}.py": "false"}, lambda c: paths.is_test_file(c).cast("string"))
of_rows("normalize_path", {"./{s}//b/../c{d}.go": "{s}/c{d}.go", "a\\{d}.go": "a/{d}.go", "/x/{s}": "x/{s}", " . ": "", "../{s}/{d}": "../{s}/{d}", "{s}/../..": ".."}, paths.clean_path)

_BRANCHES = [("fix/{d}", "", 0, "bugfix", 0.9), ("Feature/{s}", "", 0, "feature", 0.9), ("cleanup/{d}", "", 0, "refactor", 0.9), ("tests/{d}", "", 0, "test", 0.85), ("main", "a{d}_test.go,tests/{s}.py", 0, "test", 0.8), ("main", "", 3, "review", 0.7), ("main", "", 0, "explore", 0.6), ("dev{d}", "a{d}.go", 0, "explore", 0.3)]


@query("detect_workflow", f"""SELECT doc_id, CASE doc_id % 8 {' '.join(f"WHEN {i} THEN '{b[3]}'" for i, b in enumerate(_BRANCHES))} END AS workflow, CASE doc_id % 8 {' '.join(f"WHEN {i} THEN {b[4]}" for i, b in enumerate(_BRANCHES))} END::DOUBLE AS confidence FROM documents""")
def _(s, d):
    k = F.col("doc_id") % 8
    rows = table(s, d, "documents").select("doc_id", _by_turns([b[0] for b in _BRANCHES]).alias("branch"), _by_turns([b[1] for b in _BRANCHES]).alias("changed"))
    changed = F.filter(F.split("changed", ","), lambda x: x != "")
    w = paths.detect_workflow(F.col("branch"), changed, F.when(k == 5, F.array(*[F.lit(x) for x in "abc"])).otherwise(F.array().cast("array<string>")), ~k.isin(5, 6), k.between(4, 6))
    return rows.select("doc_id", w["workflow"].alias("workflow"), w["confidence"].alias("confidence"))


# --- parameters that callers give ---------------------------------------------


@query("human_duration", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN doc_id * 86400.0 WHEN 1 THEN doc_id * 3600.0 + 1800 WHEN 2 THEN 5400.0 WHEN 3 THEN doc_id / 1000.0 END::DOUBLE AS seconds FROM documents")
def _(s, d):
    form = _by_turns(["{d}d", "{d}h30m", "1.5h", "{d}ms", "{d} parsecs"])
    return table(s, d, "documents").select("doc_id", requests.duration_seconds(form).alias("seconds"))


def _weights(profiles: dict[str, scoring.Profile], workflow: Column) -> Column:
    """The weights of a row's workflow; those of ``explore`` if there is no such."""
    row = lambda p: F.struct(*[F.lit(getattr(p, c)).alias(c) for c in ("recency", "severity", "proximity", "novelty", "boost")], F.lit(",".join(p.edges)).alias("edges"))
    known = F.create_map(*[x for n, p in profiles.items() for x in (F.lit(n), row(p))])
    return F.coalesce(F.element_at(known, workflow), row(profiles["explore"]))


_SHOWN = ["recency", "severity", "proximity", "novelty", "boost", "edges"]


@query("workflow_profiles", f"""WITH {CALLS}, p AS (SELECT * FROM (VALUES ('bugfix', 0.2, 0.4, 0.3, 0.1, 0.15, 'decision_link,imports'), ('feature', 0.2, 0.25, 0.3, 0.25, 0.15, 'imports,decision_link'), ('review', 0.15, 0.4, 0.2, 0.25, 0.15, 'decision_link'), ('refactor', 0.15, 0.3, 0.4, 0.15, 0.15, 'imports'), ('test', 0.3, 0.2, 0.35, 0.15, 0.15, 'imports'), ('explore', 0.25, 0.35, 0.25, 0.15, 0.0, '')) AS t(workflow, recency, severity, proximity, novelty, boost, edges))
SELECT call, {', '.join(f'{c}::DOUBLE AS {c}' for c in _SHOWN[:-1])}, edges FROM calls JOIN p ON p.workflow = CASE turn % 7 WHEN 0 THEN 'bugfix' WHEN 1 THEN 'feature' WHEN 2 THEN 'review' WHEN 3 THEN 'refactor' WHEN 4 THEN 'test' ELSE 'explore' END""")
def _(s, d):
    names, k = ["bugfix", "feature", "review", "refactor", "test", "explore", "nothing of the kind"], F.col("turn") % 7
    workflow = F.element_at(F.array(*[F.lit(n) for n in names]), (k + 1).cast("int"))
    return model.calls(s, d).select("call", _weights(scoring.PROFILES, workflow).alias("w")).select("call", *[F.col(f"w.{c}").alias(c) for c in _SHOWN])


@query("recipes", f"""WITH {CALLS} SELECT call, CASE WHEN tool = 'user' THEN 0.1 WHEN tool = 'assistant' THEN 0.25 ELSE 0.25 END::DOUBLE AS recency, CASE WHEN tool = 'user' THEN 0.5 ELSE 0.35 END::DOUBLE AS severity,
  CASE WHEN tool = 'user' THEN 0.5 ELSE 0.0 END::DOUBLE AS boost, CASE WHEN tool = 'assistant' THEN 'calls' ELSE '' END AS edges FROM calls""")
def _(s, d):
    own = requests.recipes(files.toml('[user]\nedge_boost = 0.5\n[user.weights]\nrecency = 0.1\nseverity = 0.5\n[assistant]\nedge_priority = ["calls"]\n'))
    return model.calls(s, d).select("call", _weights(own, F.col("tool")).alias("w")).select("call", "w.recency", "w.severity", "w.boost", "w.edges")


@query("repo_registry", "SELECT n_name, '/r/' || r_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    regions = table(s, d, "region").select("r_regionkey", "r_name").collect()  # five
    repos, _ = requests.manifest(files.toml("".join(f'[[repos]]\nname = "{r["r_regionkey"]}"\npath = "/r/{r["r_name"]}"\n' for r in regions)))
    known = F.create_map(*[F.lit(x) for pair in repos.items() for x in pair])
    return table(s, d, "nation").select("n_name", F.element_at(known, F.col("n_regionkey").cast("string")).alias("path"))


@query("settings_layers", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'r' ELSE 'q' END AS y, CASE c_mktsegment WHEN 'MACHINERY' THEN 3 ELSE 1 END::BIGINT AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def _(s, d):
    told = files.layered({"BUILDING": {"y": "q", "n": 1}, "MACHINERY": {"y": "q", "n": 1}}, files.toml('[BUILDING]\ny = "r"\n'), files.toml("[MACHINERY]\nn = 3\n"))
    known = F.create_map(*[x for k, v in told.items() for x in (F.lit(k), F.struct(F.lit(v["y"]).alias("y"), F.lit(v["n"]).cast("long").alias("n")))])
    return table(s, d, "customer").where(F.col("c_mktsegment").isin(list(told))).select("c_custkey", F.element_at(known, F.col("c_mktsegment")).alias("x")).select("c_custkey", "x.y", "x.n")


@query("branch_mismatch", "SELECT doc_id, coalesce(lang, '') <> '' AND doc_id % 3 <> 2 AND lang <> CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS warned FROM documents")
def _(s, d):
    current = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).when(F.col("doc_id") % 3 == 1, F.col("source")).otherwise("")
    return table(s, d, "documents").select("doc_id", requests.branch_differs(F.col("lang"), current).alias("warned"))


@query("text_outputs", """SELECT 'text' AS form, string_agg('n_nationkey=' || n_nationkey || '  n_name=' || n_name, chr(10) ORDER BY n_nationkey) AS output FROM nation
UNION ALL SELECT 'yaml', string_agg('- n_nationkey: ' || n_nationkey || chr(10) || '  n_name: ' || CASE WHEN regexp_full_match(n_name, '[A-Za-z0-9]*[A-Za-z][A-Za-z0-9]*') THEN n_name ELSE '"' || n_name || '"' END, chr(10) ORDER BY n_nationkey) FROM nation""")
def _(s, d):
    rows = table(s, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey")
    return s.createDataFrame([(form, collections.render(rows, form)) for form in ("text", "yaml")], "form string, output string")


_FORMS = {
    "nodes where module = '{}' and stability > 0.5": "Collection: nodes|Strategy:   IndexSeek|Index:      by_module|Seek key:   {0}|Filters:    module = {0} AND stability > 0.5",
    "nodes where language = '{}' order by updated_at desc limit 5": "Collection: nodes|Strategy:   FullScan|Filters:    language = {0}|Order by:   updated_at DESC|Limit:      5",
    "notes where id = '{}' or content contains 'y'": "Collection: notes|Strategy:   FullScan|Filters:    id = {0} OR content contains y",
}


@query("dsl_explain", " UNION ALL ".join("SELECT DISTINCT '" + q.replace("'", "''").replace("{}", "' || source || '") + "' AS query, '" + p.replace("{0}", "' || source || '") + "' AS plan FROM documents WHERE source IS NOT NULL" for q, p in _FORMS.items()))
def _(s, d):
    names = [r["source"] for r in table(s, d, "documents").where("source IS NOT NULL").select("source").distinct().collect()]
    every = [q.format(n) for q in _FORMS for n in names]
    return s.createDataFrame([(q, dsl.explain(dsl.parse(q)).replace("\n", "|")) for q in every], "query string, plan string")


# --- the store ------------------------------------------------------------------


def _node_store(s: SparkSession, d: str, label: str) -> Store:
    """A store of the tables' nodes, ordered by module, with indexes of module and language."""
    store = Store(s, scratch_path(s, label))
    nodes = model.nodes(s, d).drop("doc_id")
    store.commit(append={"nodes": nodes.repartitionByRange(8, "module", "id").sortWithinPartitions("module", "id")})
    for field in ("module", "language"):
        store.add_index("nodes", field)
    return store


@query("dsl_index_seek", f"WITH {NODES} SELECT id, language, module, stability FROM nodes WHERE (module = 'src1' AND stability > 0.5) OR (language = 'es' AND module = 'src3')")
def _(s, d):
    store = stored(s, d, "node-store", lambda path: _node_store(s, d, "nodes"))
    return dsl.over_store(dsl.parse("nodes where module = 'src1' and stability > 0.5 or language = 'es' and module = 'src3'"), store)[0].select("id", "language", "module", "stability")


@query("store_put_delete", f"""WITH {NODES} SELECT id, 'moved' AS module FROM nodes WHERE language = 'fr' AND doc_id % 7 <> 0
UNION ALL SELECT id, 'src2' FROM nodes WHERE language <> 'fr' AND module = 'src2' AND doc_id % 7 <> 0""")
def _(s, d):
    store, nodes = _node_store(s, d, "put"), model.nodes(s, d)
    store.put("nodes", nodes.where("language = 'fr'").drop("doc_id").withColumn("module", F.lit("moved")))
    store.delete("nodes", nodes.where("doc_id % 7 = 0").select("id"))
    return store.lookup("nodes", "module", ["moved", "src2"]).select(F.col("key").alias("id"), F.col("value").alias("module"))


@query("backfill_batches", f"WITH {NODES} SELECT id, CASE WHEN doc_id % 10 = 0 THEN 'own' ELSE 'me' END AS owner FROM nodes")
def _(s, d):
    store, own = _node_store(s, d, "backfill"), model.nodes(s, d).where("doc_id % 10 = 0").drop("doc_id")
    store.start_backfill("nodes", "owner", "me", "string")
    store.backfill("nodes", "owner", batch=3, batches=1)  # and then it stopped
    store.put("nodes", own.withColumn("owner", F.lit("own")))
    store.backfill("nodes", "owner", batch=3)
    return store.table("nodes").select("id", "owner")


@query("alter_registry", "SELECT 'note' || doc_id AS id, 0.5::DOUBLE AS rank FROM documents WHERE lang = 'fr'")
def _(s, d):
    store = Store(s, scratch_path(s, "alter"))
    notes = table(s, d, "documents").select(F.concat(F.lit("note"), "doc_id").alias("id"), F.array("lang", "source").alias("tags"), F.lit("").alias("content"))
    store.commit(append={"notes": notes})
    registry = store.registry()
    if not registry.add_field("notes", "rank", "number") or registry.add_field("notes", "rank", "number"):
        raise AssertionError("a field is new once")
    store.start_backfill("notes", "rank", 0.5, "double", registry)
    store.backfill("notes", "rank")
    store.add_index("notes", "tags")
    return dsl.over_store(dsl.parse("notes where tags contains 'fr' and rank >= 0.5"), store)[0].select("id", "rank")


# --- search, fan-out, pointers, sessions ----------------------------------------


def _blocked(s: SparkSession, d: str) -> textindex.Index:
    """An index of small blocks, in which frequent terms have bounds by block."""
    return stored(s, d, "blocked-index", lambda path: textindex.Index.build(table(s, d, "documents"), path, block_docs=32, frequent=64))


@query("fts_block_topk", _bm25_sql("ORDER BY sum(ln((n - df + 0.5) / (df + 0.5) + 1) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) DESC, doc_id LIMIT 10"))
def _(s, d):
    return _blocked(s, d).searched(SEARCH, 10, direct=0)[0].select("doc_id", F.round("score", 6).alias("score"))


@query("fts_segments", _bm25_sql("", "doc_id % 17 = 0"))
def _(s, d):
    docs = table(s, d, "documents")
    index = textindex.Index(s, scratch_path(s, "segments"), 0)
    for k in range(3):
        index.add(docs.where(F.pmod("doc_id", F.lit(3)) == k), merge=False)
    index.delete(docs.where("doc_id % 17 = 0").select("doc_id"))
    return index.bm25(SEARCH).select("doc_id", F.round("score", 6).alias("score"))


@query("fed_fan_out", """SELECT lang AS _repo, count(DISTINCT source) AS n, false AS failed FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'broken', 0, true""")
def _(s, d):
    docs = table(s, d, "documents").where("lang IS NOT NULL").select(F.col("source").alias("id"), "lang")
    langs = [r["lang"] for r in docs.select("lang").distinct().collect()]
    roots = {x: lambda x=x: docs.where(F.col("lang") == x).select("id") for x in langs}
    roots["broken"] = lambda: docs.select(F.raise_error(F.concat(F.lit("no "), "id")).cast("string").alias("id"))
    rows, errors = federation.query_repos(roots)
    good = rows.groupBy("_repo").agg(F.count("*").alias("n")).withColumn("failed", F.lit(False))
    return good.unionByName(federation.failures(errors).select("_repo", F.lit(0).cast("long").alias("n"), F.lit(True).alias("failed")))


@query("log_resolve_supersedes", f"WITH {EVENT_LOG} SELECT id, version, version - 1 AS hop, 'ok' AS state FROM log")
def _(s, d):
    log = model.event_log(s, d)
    own = text.version_key(eventlog.prefix_of(F.col("kind")), F.col("id"), F.col("version") - 1)
    return eventlog.resolve_supersedes(log.withColumn("supersedes", F.when(F.col("version") > 1, own)), 1_000_000).select("id", "version", "hop", "state")


@query("as_of_join", """SELECT e.event_id, (SELECT max(version) FROM log l WHERE l.id = e.user_id || ':view' AND l.created_at_nanos <= epoch_us(e.ts) * 1000) AS version FROM events e WHERE e.event_type = 'purchase'""".replace("SELECT e.event_id", f"WITH {EVENT_LOG} SELECT e.event_id", 1))
def _(s, d):
    bought = table(s, d, "events").where("event_type = 'purchase'").select("event_id", F.concat(F.col("user_id").cast("string"), F.lit(":view")).alias("id"), (model.micros("ts") * 1000).alias("created_at_nanos"))
    views = model.event_log(s, d).select("id", "created_at_nanos", "version")
    day = 86_400 * 10**9
    return as_of_join(bought, views, ["id"], "created_at_nanos", F.col("version"), day, tie="version").select("event_id", F.col("as_of").alias("version"))


@query("session_stream", f"WITH {CALLS}, f AS (SELECT session, ref, min((created_at, call)) AS o FROM calls GROUP BY 1, 2), n AS (SELECT session, count(*) AS calls FROM calls GROUP BY 1) SELECT session, string_agg(ref, ',' ORDER BY o) AS served, any_value(n.calls) AS calls FROM f JOIN n USING (session) GROUP BY session")
def _(s, d):
    from knotlog.streaming import sessions

    at = F.timestamp_seconds(F.col("created_at") + 1_600_000_000)
    calls = model.served(s, d).select("session", "call", F.lit("t").alias("tool"), at.alias("created_at"), F.array("ref").alias("served"))
    source, target, checkpoint = (scratch_path(s, f"sessions-{x}") for x in ("in", "out", "checkpoint"))
    half = F.pmod(F.xxhash64("call"), F.lit(2)) == 0
    before = {k: s.conf.get(k, None) for k in sessions.STATE_STORE}
    try:
        for k, v in sessions.STATE_STORE.items():
            s.conf.set(k, v)
        for part in (calls.where(half), calls.where(~half)):  # the query ends and is started again on what came meanwhile
            part.coalesce(2).write.mode("append").json(source)
            sessions.follow_sessions(s, source, target, checkpoint, idle_ms=10**12, late="36500 days").awaitTermination()
    finally:
        for k, v in before.items():
            s.conf.unset(k) if v is None else s.conf.set(k, v)
    return sessions.latest_sessions(s, target).select("session", F.array_join("served", ",").alias("served"), "calls")

