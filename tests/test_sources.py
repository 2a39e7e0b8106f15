"""Store, file sources, commits and streams."""

import json

import pytest
from pyspark.sql import functions as F

from knotlog.operators import fieldindex
from knotlog.plans import migrations
from knotlog.sources import commits, entities, files, pages
from knotlog.sources.store import Locked, Store, once
from knotlog.streaming import collector, watcher


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.commit(append={"t": spark.range(3)}) == 1
    old = store.table("t")
    registry = store.registry()
    registry.add_field("notes", "rank", "number")
    assert store.commit(append={"t": spark.range(3, 5)}, replace={"u": spark.range(1)}, registry=registry) == 2
    assert old.count() == 3 and store.table("t").count() == 5 and "rank" in store.registry().fields("notes")
    store.compact(1)
    assert store.diagnostics().orderBy("table").collect()[0]["rows"] == 5
    assert once(store, "m1", lambda: {"v": spark.range(2)}) and not once(store, "m1", lambda: {"v": spark.range(9)})
    (tmp_path / "s" / "writer.lock").write_text("")
    with pytest.raises(Locked):
        store.commit(append={"t": spark.range(1)})


@pytest.fixture
def repo(tmp_path):
    for name, content in {
        "main.go": 'package main\n\nimport (\n\t"fmt"\n\tx "a.io/b"\n)\nimport "os"\n// @kb-rule must-log: always\nfunc Run() {}\n',
        "pkg/util/io.py": "import os, sys as s\nfrom a.b import c\n\nclass K:\n    def m(self): pass\n\ndef f(): pass\n",
        "web/x.ts": "import { a } from './a'\nimport 'side'\nexport class Q {}\n",
        "J.java": "import static a.B.c;\nimport d.e.*;\nclass J {}\n",
        "go.mod": "module a.io/repo\n",
        "docs/adr/0001-x.md": "# Use X\nbody\n",
        "docs/guide.md": "# T\n## First Part\nx\n## Second\ny\n",
        ".hidden/z.py": "import q\n",
        ".github/w.yml": "a: 1\n",
        "pkg/__init__.py": "",
        "server.pem": "key",
    }.items():
        p = tmp_path / "repo" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content)
    return str(tmp_path / "repo")


def test_files(spark, repo):
    tree = files.file_tree(spark, repo, ["*.lock"])
    assert {r["path"] for r in tree.collect()} == {"main.go", "pkg/util/io.py", "web/x.ts", "J.java", "go.mod", "docs/adr/0001-x.md", "docs/guide.md", ".github/w.yml", "pkg/__init__.py"}
    assert files.file_tree(spark, f"file://{repo}").count() == 7
    found = {(r["path"], r["import_path"]) for r in files.imports(tree).collect()}
    assert found == {("main.go", "fmt"), ("main.go", "a.io/b"), ("main.go", "os"), ("pkg/util/io.py", "os"), ("pkg/util/io.py", "sys"), ("pkg/util/io.py", "a.b"), ("web/x.ts", "./a"), ("web/x.ts", "side"), ("J.java", "a.B.c"), ("J.java", "d.e.*")}
    found = {(r["path"], r["kind"], r["name"], r["receiver"], r["line"]) for r in entities.entities(tree).collect()}
    assert found == {("pkg/util/io.py", "class", "K", "", 4), ("pkg/util/io.py", "method", "m", "K", 5), ("pkg/util/io.py", "function", "f", "", 7), ("main.go", "function", "Run", "", 9), ("web/x.ts", "class", "Q", "", 3), ("J.java", "class", "J", "", 3)}
    assert files.go_module(tree).first()["module_path"] == "a.io/repo"
    rule = files.annotation_decisions(files.annotations(tree)).first()
    assert (rule["id"], rule["severity"], rule["body"]) == ("rule:must-log", "must", "[file: main.go:8]\n\nalways")
    assert files.adr_decisions(tree).first()["title"] == "Use X"
    assert [r["id"] for r in files.doc_decisions(tree, {"guide": "pkg/util"}).collect()] == ["doc:guide:first-part", "doc:guide:second"]
    node = files.nodes(tree, F.lit("now")).where("id = 'pkg/util/io.py'").first()
    assert (node["module"], node["language"], node["class"]) == ("pkg/util", "Python", "source")


def test_layers():
    assert files.layered(files.toml("[a]\nx = 1\ny = 2"), files.toml("[a]\nx = 3")) == {"a": {"x": 3, "y": 2}}


def test_commits(spark, tmp_path):
    log = "\x01abc123def4567\x02Ann\x022024-01-02T00:00:00Z\x02ADR: use y\n\x03\nA\ta.go\nM\tb.go\n\x01ffff\x02Bob\x022020-01-01T00:00:00Z\x02feat: z\n\x03\nD\tc.go\n"
    (tmp_path / "log").write_text(log)
    rows = commits.read_log(spark, str(tmp_path / "log"))
    assert rows.count() == 3
    assert {r["path"] for r in commits.recent(rows, F.lit("2024-02-01").cast("timestamp")).collect()} == {"a.go", "b.go"}
    d = commits.commit_decisions(rows).collect()
    assert [(r["id"], r["title"]) for r in d] == [("commit:abc123def456", "use y")]


def test_collector(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    calls = [{"session": "s", "call": f"c{i}", "tool": "t", "created_at": f"2024-01-01T00:0{i}:00Z", "served": ["e:a", "e:b"][: i + 1]} for i in range(2)]
    (source / "a.json").write_text("\n".join(map(json.dumps, calls)))
    for _ in range(2):
        collector.collect_stream(spark, str(source), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "links")).count() == 4 + 3
    assert spark.read.parquet(str(tmp_path / "out" / "observations")).count() == 3
    batch = spark.read.schema(collector.CALLS).json(str(source))
    assert collector.served_in_order(batch).first()["served"] == ["e:a", "e:b"]


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps({"session": "s", "call": f"c{i}", "tool": "t", "created_at": f"2024-01-01T00:{i:02d}:00Z", "served": []}) for i in range(20)))
    stream = spark.readStream.schema(collector.CALLS).json(str(source))
    q = collector.new_sessions(stream).writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    assert spark.table("once").count() == 1
    q = collector.activity(stream).writeStream.format("memory").queryName("act").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert spark.table("act").agg(F.sum("calls")).first()[0] >= 5
    seen = []
    collector.watch(spark, str(source), str(tmp_path / "c3"), lambda df, n: seen.append(df.count())).awaitTermination()
    assert seen == [1]


GO = """package x
// Doc {
func Add(a int, s string) (int, error) {
	x := "func Bad() {"
	return a, nil
}
func (t *Tree[K]) Get(k K) bool { return true }
type (
	A struct {
		f int
	}
	B interface{ M() }
)
type D[T any] interface {
	N()
}
const Max = 3
const (
	one = iota
	Two
)
"""
JS = """import x from "y";
export default class Foo extends Bar {
  constructor(x) { if (x) { y(); } }
  async load(a, b = {}) { return `}{`; }
}
export async function run(a, {b}) { function inner() {} }
export const f = async (a) => { return 1 };
const g = x => x;
const K = { run() { } };
interface Q { a: string }
"""
JAVA = """package a;
/** Doc { */
@Service("x{")
public class Foo<T> extends Bar {
  public static final int MAX = 3;
  private static final String[] NAMES = {"a", "b"};
  private int n = 0;
  public Foo(int n) { this.n = n; }
  @Override
  public <X> List<X> get(Map<String, X> m) throws E { if (a) { return; } return null; }
  abstract void none();
  public static class Inner { void deep() {} }
}
interface I { void a(); }
public enum Color { RED, GREEN; void x() {} }
@interface Ann { String value() default ""; }
"""


def test_declarations():
    assert sorted(entities.go(GO)) == sorted([("function", "Add", "", True, 3, 6), ("method", "Get", "Tree", True, 7, 7), ("struct", "A", "", True, 9, 11), ("interface", "B", "", True, 12, 12), ("interface", "D", "", True, 14, 16), ("constant", "Max", "", True, 17, 17), ("constant", "one", "", False, 19, 19), ("constant", "Two", "", True, 20, 20)])
    assert sorted(entities.javascript(JS)) == sorted([("class", "Foo", "", True, 2, 5), ("method", "constructor", "Foo", True, 3, 3), ("method", "load", "Foo", True, 4, 4), ("function", "run", "", True, 6, 6), ("function", "f", "", True, 7, 7), ("function", "g", "", False, 8, 8), ("constant", "K", "", False, 9, 9), ("interface", "Q", "", False, 10, 10)])
    got = [x[:4] for x in entities.java(JAVA)]
    assert got == [("class", "Foo", "", True), ("constant", "MAX", "", True), ("constant", "NAMES", "", False), ("method", "Foo", "Foo", True), ("method", "get", "Foo", True), ("method", "none", "Foo", False), ("class", "Foo.Inner", "", True), ("method", "deep", "Foo.Inner", False), ("interface", "I", "", False), ("method", "a", "I", False), ("enum", "Color", "", True), ("annotation", "Ann", "", False)]
    for text in ("", "}}}{{{", "func (", "class {", 'class A { String s = "', "type (", "const f = ("):
        for read in (entities.go, entities.javascript, entities.java):
            list(read(text))


def test_git(spark, tmp_path):
    import shutil
    import subprocess

    if not shutil.which("git"):
        pytest.skip("no git")
    repo = tmp_path / "r"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=A B", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    for i in range(5):
        (repo / f"f{i}.txt").write_text(str(i))
        run("add", "-A")
        run("commit", "-q", "-m", f"feat: number {i}\n\nbody\twith tab")
    spark.dataSource.register(commits.GitLog)
    rows = spark.read.format("gitlog").option("commits", 2).load(str(repo))
    assert rows.rdd.getNumPartitions() == 3 and {(r["path"], r["action"], r["author"]) for r in rows.collect()} == {(f"f{i}.txt", "A", "A B") for i in range(5)}
    (tmp_path / "log.txt").write_text(subprocess.run(["git", "-C", str(repo), "log", *commits.FORMAT], check=True, capture_output=True, text=True).stdout)
    assert sorted(map(tuple, commits.read_log(spark, str(tmp_path / "log.txt")).collect())) == sorted(map(tuple, rows.collect()))
    assert sorted(commits.parse_log((tmp_path / "log.txt").read_text())) == sorted(map(tuple, rows.collect()))


def test_field_index(spark, tmp_path):
    rows = spark.createDataFrame([("a", ["x", "y", "x"], 1), ("b", ["y"], 2), ("c", None, 1), (None, ["x"], 3)], "id string, tags array<string>, n int")
    index = fieldindex.FieldIndex.build(rows, "tags", str(tmp_path / "i"))
    assert {r["key"] for r in index.keys(["x"]).collect()} == {"a"} and index.keys([]).count() == 0 and index.keys(["zz"]).count() == 0
    assert {r["id"] for r in index.rows(rows, ["x", "y"]).collect()} == {"a", "b"}
    store = Store(spark, str(tmp_path / "s"))
    store.commit(replace={"t": rows})
    assert fieldindex.backfill_index(store, "t", "n") and not fieldindex.backfill_index(store, "t", "n")
    assert sorted((r["value"], r["key"]) for r in store.lookup("t", "n", ["1", "2", "9"]).collect()) == [("1", "a"), ("1", "c"), ("2", "b")]


def test_migrations(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    nodes = spark.createDataFrame([("file", "a.go", "a.go", "h", "active", "t")], "type string, file_path string, name string, content_hash string, status string, created_at string")
    relations = spark.createDataFrame([("kn:a", "b", "", "t"), ("", "b", "x", "t")], "source_node_id string, target_node_id string, type string, created_at string")
    notes = spark.createDataFrame([("n1", "# Title\nx", "t")], "id string, content string, created_at string")
    store.commit(replace={"nodes": nodes, "relations": relations, "notes": notes, "evolution": spark.createDataFrame([("x",)], "id string")})
    assert migrations.migrate(store, 11) == [10, 11] and migrations.migrate(store) == [12, 13, 14, 15] and migrations.migrate(store) == []
    assert store.table("entities").first()["id"] == "a.go" and store.table("evolution").count() == 0
    assert [tuple(r)[:3] for r in store.table("links").collect()] == [("e:a", "related", "e:b")] and store.table("decisions").first()["id"] == "note:n1"


def test_watcher(spark, tmp_path):
    root, store = tmp_path / "r", Store(spark, str(tmp_path / "s"))
    root.mkdir()
    (root / "a.py").write_text("1")
    (root / "b.py").write_text("2")
    kinds = lambda df: {r["path"]: r["change"] for r in df.collect()}
    assert kinds(watcher.scan_changes(store, str(root))) == {"a.py": "new", "b.py": "new"}
    assert watcher.scan_changes(store, str(root)).count() == 0
    (root / "a.py").unlink()
    (root / "b.py").write_text("3")
    (root / "c.py").write_text("4")
    seen = []
    assert watcher.follow(store, str(root), lambda df: seen.append(kinds(df)), rounds=2, wait=lambda s: None) == 1
    assert seen == [{"a.py": "missing", "b.py": "changed", "c.py": "new"}]
    row = store.diagnostics().first()
    assert (row["table"], row["rows"]) == ("scan", 2) and row["parts"] and row["files"] > 0 and row["bytes"] > 0


def test_pages(spark, tmp_path):
    nodes = spark.createDataFrame([("a/x.go", "Go", "a", "source", 0.5), ("a/y.go", "Go", "a", "test", 0.25), ("b/z.tf", "HCL", "b/c", "infra", 1.0)], "file_path string, language string, module string, class string, stability double")
    relations = spark.createDataFrame([("a/x.go", "b/z.tf", "imports")], "source_node_id string, target_node_id string, type string")
    decisions = spark.createDataFrame([("d2", "may", "Later"), ("d1", "must", "First")], "id string, severity string, title string")
    fans = spark.createDataFrame([("e:a/x.go", 0, 3, 0), ("e:b/z.tf", 4, 0, 3)], "ref string, fan_in long, fan_out long, must_count long")
    lines = pages.pages(nodes, relations, decisions, fans)
    assert pages.page_text(lines, "DECISIONS.md") == "# Decisions\n\n- **must** First\n- **may** Later\n"
    assert pages.page_text(lines, "MODULES/a.md") == "# a\n\n| File | Role | Stability |\n|---|---|---|\n| a/x.go | source | 0.50 |\n| a/y.go | test | 0.25 |\n"
    assert "## Entry points\n\n- a/x.go\n" in pages.page_text(lines, "AGENTS.md") and "- b/z.tf" in pages.page_text(lines, "AGENTS.md")
    pages.write_pages(lines, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out")).where("page = 'MODULES/b_c.md'").count()
    assert back == pages.page_text(lines, "MODULES/b_c.md").count("\n")
