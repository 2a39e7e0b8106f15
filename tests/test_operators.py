"""Log, graph, budget, tokenizer and other operators against plain Python."""

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from knotlog.functions import paths, scoring, text
from knotlog.operators import eventlog, federation, graph, maintenance, reports, retrieval, search, textindex

LINK = "src_ref string, edge_type string, dst_ref string, version long, created_at_nanos long, lifecycle string"


def bfs(edges, start, depth):
    seen, level = {start: 0}, [start]
    for d in range(1, depth + 1):
        level = sorted({b for a, b in edges if a in level and b not in seen})
        seen.update(dict.fromkeys(level, d))
    return {k: v for k, v in seen.items() if k != start}


@pytest.mark.parametrize("seed", [1, 2])
def test_reachable_random(spark, seed):
    rnd = random.Random(seed)
    edges = {(f"e:{rnd.randrange(15)}", f"e:{rnd.randrange(15)}") for _ in range(25)}
    links = spark.createDataFrame([(a, "imports", b, 1, 0, "active") for a, b in edges], LINK)
    start = spark.createDataFrame([("e:1",), ("e:2",)], "ref string")
    got = {(r["start"], r["ref"]): r["depth"] for r in graph.reachable(links, start, 4).collect()}
    assert got == {(s, k): v for s in ("e:1", "e:2") for k, v in bfs(edges, s, 4).items()}
    back = {(b, a) for a, b in edges}
    both = {(r["ref"]) for r in graph.reachable(links, start.limit(1), 3, "both").collect()}
    assert both == set(bfs(edges, "e:1", 3)) | set(bfs(back, "e:1", 3))


def test_lifecycle_and_time(spark):
    rows = [("e:a", "t", "e:b", 1, 10, "active"), ("e:a", "t", "e:b", 2, 20, "superseded"), ("e:a", "t", "e:c", 1, 10, "historical"), ("e:a", "u", "e:d", 1, 30, "active")]
    links, start = spark.createDataFrame(rows, LINK), spark.createDataFrame([("e:a",)], "ref string")
    near = lambda **k: {r["ref"] for r in graph.neighbors(links, start, **k).collect()}
    assert near() == {"e:c", "e:d"}
    assert near(as_of_nanos=15) == {"e:b", "e:c"}
    assert near(edge_types=["u"]) == {"e:d"}


def capped_bfs(edges, start, depth, ways, cap):
    """Breadth first by one queue; ``edges`` are (source, type, target)."""
    seen, out, queue = {(start, w) for w in ways}, {}, [(start, 0, w) for w in ways]
    while queue:
        at, d, way = queue.pop(0)
        if d >= depth:
            continue
        near = sorted((t, b) for a, t, b in edges if a == at) if way == "f" else sorted((t, a) for a, t, b in edges if b == at)
        for _, n in near:
            if (n, way) in seen:
                continue
            seen.add((n, way))
            if len(seen) > cap:
                return out, True
            out.setdefault(n, d + 1)
            queue.append((n, d + 1, way))
    return out, False


@pytest.mark.parametrize("held", [300, 0])
def test_cap(spark, monkeypatch, held):
    """Over the cap a walk returns what it visited, in its order; small and large frontiers alike."""
    monkeypatch.setattr(graph, "LITERALS", held)
    links = spark.createDataFrame([("e:a", "t", f"e:{i}", 1, 0, "active") for i in range(9)], LINK)
    got = graph.reachable(links, spark.createDataFrame([("e:a",)], "ref string"), 3, cap=5).collect()
    assert all(r["capped"] for r in got) and {r["ref"] for r in got} == {"e:0", "e:1", "e:2", "e:3"}
    rnd = random.Random(3)
    edges = {(f"e:{rnd.randrange(30)}", rnd.choice("tu"), f"e:{rnd.randrange(30)}") for _ in range(70)}
    links = spark.createDataFrame([(a, t, b, 1, 0, "active") for a, t, b in edges], LINK)
    index = graph.EdgeIndex.build(links)
    start = spark.createDataFrame([("e:1",), ("e:2",), ("e:77",)], "ref string")
    for cap, direction, ways in ((8, "forward", "f"), (13, "both", "fr"), (500, "reverse", "r")):
        for source in (links, index):
            got = {}
            for r in graph.reachable(source, start, 4, direction, cap=cap).collect():
                got.setdefault(r["start"], ({}, r["capped"]))[0][r["ref"]] = r["depth"]
            for s in ("e:1", "e:2", "e:77"):
                want = capped_bfs(edges, s, 4, ways, cap)
                assert got.get(s, ({}, False)) == (want if want[0] else ({}, False))


def test_as_of_stops_first(spark):
    rows = [("e", "x", 1, 10), ("e", "x", 2, 30), ("e", "x", 3, 20), ("e", "y", 1, 50)]
    log = spark.createDataFrame(rows, "kind string, id string, version long, created_at_nanos long")
    assert [(r["id"], r["version"]) for r in eventlog.as_of(log, 25).collect()] == [("x", 1)]
    assert [(r["id"], r["version"]) for r in eventlog.as_of_highest(log, 25).collect()] == [("x", 3)]


def test_append_goes_on(spark):
    old = spark.createDataFrame([("entity", "a:b", 1)], "kind string, id string, version long")
    new = spark.createDataFrame([("entity", "a:b", None, 2), ("entity", "a:b", "historical", 1), ("entity", "c", None, 1)], "kind string, id string, lifecycle string, o int")
    got = {(r["id"], r["version"]): (r["lifecycle"], r["supersedes"]) for r in eventlog.append(old, new, [F.col("o")]).collect()}
    assert got == {("a:b", 2): ("historical", "e:a\\cb:v0000000000000001"), ("a:b", 3): ("active", "e:a\\cb:v0000000000000002"), ("c", 1): ("active", None)}


def test_drop_links(spark):
    log = spark.createDataFrame([("l", ("e:a", "t", "e:b")), ("l", ("e:c", "t", "e:d")), ("e", None)], "kind string, link struct<src_ref:string,edge_type:string,dst_ref:string>")
    got = eventlog.drop_links_touching(log, spark.createDataFrame([("e:b",)], "ref string"))
    assert sorted(str(r["link"]) for r in got.collect()) == sorted(["None", "Row(src_ref='e:c', edge_type='t', dst_ref='e:d')"])


@pytest.mark.parametrize("seed", range(4))
def test_budget(spark, seed):
    rnd = random.Random(seed)
    costs = [rnd.randrange(0, 60) for _ in range(rnd.randrange(0, 30))]
    limit, used, want = rnd.choice([0, 50, 200]), 0, []
    for c in costs:
        ok = limit > 0 and used + c <= limit
        used += c if ok else 0
        want.append(ok)
    df = spark.createDataFrame([(costs,)], "c array<long>")
    assert df.select(scoring.fit_to_budget(F.col("c"), F.lit(limit)).alias("t")).first()["t"] == want


@pytest.mark.parametrize("seed", range(3))
def test_admit(spark, seed):
    """Of many sections only those that can be admitted are folded; the result is the whole fold's."""
    rnd = random.Random(seed)
    rows = [(f"r{i}", rnd.choice("ab"), rnd.random(), rnd.randrange(3), rnd.choice([0, 1, 1, 2, 3, 7, 40, 500])) for i in range(400)]
    limit, want = 90, set()
    for key in "ab":
        used = 0
        for ref, _, _, _, cost in sorted((r for r in rows if r[1] == key), key=lambda r: (-r[2], r[3], r[0])):
            if used + cost <= limit:
                used += cost
                want.add(ref)
    df = spark.createDataFrame(rows, "ref string, k string, score double, depth int, tokens int")
    got = retrieval.admit(df, limit, ["k"]).collect()
    assert len(got) == 400 and {r["ref"] for r in got if r["admitted"]} == want
    assert retrieval.admit(df, 0).where("admitted").count() == 0


def test_index(spark, tmp_path):
    """Added, replaced and deleted documents are found as a scan of the live ones finds them."""
    rnd = random.Random(4)
    words = ["alpha", "betaGamma", "delta", "eps_zeta", "東京都", "Omega9", "omega"]
    make = lambda ids: [(i, " ".join(rnd.choices(words, k=rnd.randrange(0, 9))) or None) for i in ids]
    first, second = make(range(40)), make(range(30, 50))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = textindex.Index.build(frame(first), str(tmp_path / "index"), buckets=3)
    near = lambda df: {r["doc_id"]: pytest.approx(r["score"]) for r in df.collect()}
    for q in ("alpha", "beta omega 京都", "nothing", ""):
        assert {r["doc_id"]: r["score"] for r in index.bm25(q).collect()} == near(search.bm25(frame(first), q))
    index.add(frame(second))
    index.delete(frame([(3, None), (35, None)]))
    index.add(frame([(3, "alpha again")]))
    live = [r for r in first if r[0] < 30 and r[0] != 3] + [r for r in second if r[0] != 35] + [(3, "alpha again")]
    index.save()
    index = textindex.Index.open(spark, str(tmp_path / "index"))
    for _ in range(2):
        for q in ("alpha", "gamma 9"):
            assert {r["doc_id"]: r["score"] for r in index.bm25(q, live_statistics=True).collect()} == near(search.bm25(frame(live), q))
        index.compact()
    assert len(index.segments) == 1 and not index.segments[0]['gone'] and index.search("alpha", 2).count() == 2


def test_terms_match_tokenizer(spark):
    texts = ["parseJSON error_code parseJSON", "東京都 x 東京", "v2Ray東 カード", "", "__ _ a_b_C"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in docs.select("doc_id", text.tokenize(F.col("text")).alias("t")).collect():
        want = {}
        for k, t in enumerate(r["t"]):
            want.setdefault(t, []).append(k)
        got = {x["term"]: x["positions"] for x in search.postings(docs).where(F.col("doc_id") == r["doc_id"]).collect()}
        assert got == want
    assert {r["doc_id"]: r["dl"] for r in search.norms(docs).collect()}[3] == 0


def test_tokenizer(spark):
    cases = {"parseJSON error_code": ["parse", "json", "parsejson", "error", "code", "error_code"], "東京都 x": ["東京", "京都", "x"], "v2Ray東": ["v", "2", "ray", "v2ray", "東"], "": [], "__": ["__"], "カード": ["カー", "ード"]}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r["s"]: r["t"] for r in df.select("s", text.tokenize(F.col("s")).alias("t")).collect()}
    assert got == cases


def test_search(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha gamma"), (3, "delta"), (4, None)], "doc_id long, text string")
    assert [r["doc_id"] for r in search.search(docs, "alpha", 5).collect()] == [2, 1]
    gone = spark.createDataFrame([(2,)], "doc_id long")
    assert [r["doc_id"] for r in search.search(docs, "alpha", 5, deleted=gone).collect()] == [1]
    assert search.search(docs, "nothing", 5).count() == 0


def test_proximity_first_file_decides(spark):
    df = spark.createDataFrame([("a/x.go",), ("b/y.go",), ("z.go",), ("",)], "p string")
    got = [r[0] for r in df.select(scoring.proximity(F.col("p"), F.array(F.lit("a/q.go"), F.lit("a/x.go"), F.lit("y.go")))).collect()]
    assert got == [0.5, 0.2, 0.2, 0.2]


def test_assemble_empty_and_profile(spark):
    assert retrieval.normalize_path("./a//b/../c.go") == "a/c.go" and retrieval.normalize_path(" . ") == ""
    r = retrieval.Request(["./x.go", ""], datetime(2024, 1, 1, tzinfo=UTC), "nope")
    assert r.paths() == ["x.go"] and r.weights() == scoring.PROFILES["explore"]
    assert all(not p.problems() for p in scoring.PROFILES.values())
    assert scoring.Profile(1, 1, 0, 0, (), 2).problems()


def test_federation(spark):
    a = spark.createDataFrame([("1", "x"), ("1", "y"), (None, "z"), (None, "w")], "id string, v string")
    assert federation.union_repos({"r": a, "q": a}).count() == 4

    def broken():
        raise ValueError("gone")

    rows, errors = federation.query_repos({"r": lambda: a, "q": broken})
    assert rows.count() == 2 and errors == {"q": "gone"}
    imports = spark.createDataFrame([("l", "f", "m.io/abc/x"), ("l", "g", "m.io/ab")], "source_repo string, source_node_id string, import_path string")
    mods = spark.createDataFrame([("m.io/ab", "R")], "module_path string, repo string")
    got = {(r["source_node_id"], r["target_module"]) for r in federation.cross_repo_deps(imports, mods).collect()}
    assert got == {("f", "c/x"), ("g", "(root)")}
    deps = federation.cross_repo_deps(imports, mods)
    assert federation.filter_deps(deps, node="f").count() == 1 and federation.filter_deps(deps, node="none").count() == 2


def test_excluded(spark):
    df = spark.createDataFrame([("a/b.tmp",), ("b.tmp",), ("a/b/c.go",)], "p string")
    assert [r[0] for r in df.select(paths.excluded(F.col("p"), ["*.tmp", "a/*/c.go"])).collect()] == [True, True, True]
    assert [r[0] for r in df.select(paths.excluded(F.col("p"), ["a/*"])).collect()] == [True, False, False]


def test_maintenance(spark):
    rows = spark.createDataFrame([("a", None)], "id string, v string")
    once = maintenance.backfill(rows, "v", "d", "string")
    assert once.collect() == maintenance.backfill(once, "v", "e", "string").collect()
    nodes = spark.createDataFrame([("p", "active", "t"), ("q", "deleted", "t")], "file_path string, status string, updated_at string")
    got = {r["file_path"]: (r["status"], r["updated_at"]) for r in maintenance.mark_deleted(nodes, nodes.limit(0), F.lit("now")).collect()}
    assert got == {"p": ("deleted", "now"), "q": ("deleted", "t")}


def test_chunks(spark):
    few = retrieval.chunks(spark.range(50), [F.col("id")]).select("chunk", "chunks").distinct().collect()
    assert [tuple(r) for r in few] == [(0, 1)]
    many = {r["id"]: r["chunk"] for r in retrieval.chunks(spark.range(55), [F.col("id").desc()]).collect()}
    assert many == {i: (54 - i) // 20 for i in range(55)}


def test_reports(spark):
    assert reports.render_markdown("T", spark.createDataFrame([(1, "a")], "n long, s string"), ["n", "s"]).endswith("| 1 | a |")
    sections = spark.createDataFrame([(i, f"s{i}", "") for i in range(5)], "position int, name string, body string")
    assert reports.walkthrough(sections, ["s1"], shallow=True).count() == 3
    nodes = spark.createDataFrame([("Go", "source"), ("SQL", "infra")], "language string, class string")
    assert reports.inferred_constraints(nodes).count() == 2 and reports.inferred_constraints(nodes.limit(0)).count() == 0
