"""Fan-out over roots, pointer chains, as-of joins, stateful sessions, listing and watching."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from knotlog.functions.paths import clean_path
from knotlog.operators import eventlog, federation, graph
from knotlog.operators.asof import as_of_join
from knotlog.operators.retrieval import normalize_path
from knotlog.plans.requests import branch_differs, branch_mismatch, duration, duration_seconds
from knotlog.sources import files
from knotlog.sources.store import Store
from knotlog.streaming import sessions, watcher
from knotlog.streaming.collector import served_in_order

# --- fan-out ----------------------------------------------------------------


def test_roots_fail_late_and_slow(spark):
    """A root that fails while it runs and one that is too slow are reported; the others answer, side by side."""
    nap = F.udf(lambda x: time.sleep(60) or x, "long")
    roots = {f"r{k}": lambda k=k: spark.range(k + 1).select(F.col("id").cast("string").alias("id"), F.lit(k).alias("v")) for k in range(5)}
    roots["planned"] = lambda: spark.range(1).select("nowhere")
    roots["run"] = lambda: spark.range(3).select(F.raise_error(F.lit("boom at run")).cast("string").alias("id"))
    roots["slow"] = lambda: spark.range(2).select(nap("id").cast("string").alias("id"))
    began = time.monotonic()
    rows, errors = federation.query_repos(roots, at_once=4, seconds=12)
    assert time.monotonic() - began < 45
    assert sorted(map(tuple, rows.groupBy("_repo").count().collect())) == [(f"r{k}", k + 1) for k in range(5)]
    assert set(errors) == {"planned", "run", "slow"} and "boom" in errors["run"] and errors["slow"] == "no answer in 12 s"
    assert {r["_repo"] for r in federation.failures(errors).collect()} == set(errors)
    assert federation.query_repos({}) == (None, {}) and federation.query_repos({"x": roots["run"]})[0] is None
    assert federation.query_repos({k: roots[k] for k in ("r3", "r4")}, limit=3)[0].count() == 3


# --- pointers ---------------------------------------------------------------


def key(id, version):
    return f"o:{id}:v{version:016d}"


def test_pointers_of_all_chains(spark):
    rows, want = [], {}
    for name, n in (("a", 1), ("b", 2), ("long", 37)):
        for v in range(1, n + 1):
            rows.append(("observation", name, v, key(name, v - 1) if v > 1 else None))
            want[name, v] = (key(name, 1), v - 1, "ok")
    rows += [("observation", "lost", v, key("lost", v - 1)) for v in (5, 6)]  # versions before 5 are not there
    want |= {("lost", 5): (key("lost", 5), 0, "dangling"), ("lost", 6): (key("lost", 5), 1, "dangling")}
    rows += [("observation", "ring", v, key("ring", v % 3 + 1)) for v in (1, 2, 3)] + [("observation", "into", 1, key("ring", 2))]
    log = spark.createDataFrame(rows, "kind string, id string, version long, supersedes string")
    got = {(r["id"], r["version"]): (r["root"], r["hop"], r["state"]) for r in eventlog.resolve_supersedes(log).collect()}
    assert {k: got[k] for k in want} == want
    assert {got[k][0::2] for k in got if k not in want} == {(None, "cycle")}
    short = {(r["id"], r["version"]): r["state"] for r in eventlog.resolve_supersedes(log, hops=10).where("id = 'long'").collect()}
    assert short["long", 11] == "ok" and short["long", 37] == "too long"
    assert eventlog.resolve_supersedes(log.limit(0)).count() == 0


def test_pointers_are_dealt_by_rows(spark, monkeypatch):
    """However small their files are, no join of pointers is a broadcast or one task."""
    monkeypatch.setattr(eventlog, "POINTERS_OF_TASK", 100)
    rows = spark.range(3_000).select(F.lit("observation").alias("kind"), F.lit("one").alias("id"), (F.col("id") + 1).alias("version"))
    log = rows.withColumn("supersedes", F.when(F.col("version") > 1, F.format_string("o:one:v%016d", F.col("version") - 1)))
    out = eventlog.resolve_supersedes(log, 10_000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and ", 31)" in plan
    assert out.where("state = 'ok' AND hop = version - 1").count() == 3_000


# --- as-of joins ------------------------------------------------------------


def test_as_of_join_is_that_of_all_pairs(spark):
    """Whatever the width, with ties, nulls, and a key that has most rows."""
    draw = random.Random(9)
    of = lambda: draw.choice(["hot", "hot", "hot", "a", "b", None])
    when = lambda: draw.choice([None, *range(-40, 60)])
    left = [(i, of(), when()) for i in range(150)]
    right = [(of(), when(), draw.randrange(3), f"v{i}") for i in range(90)]
    lefts, rights = spark.createDataFrame(left, "n long, k string, t long"), spark.createDataFrame(right, "k string, t long, tie int, v string")

    def brute(k, t):
        own = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and r[1] <= t]
        top = max(((r[1], r[2]) for r in own), default=None)
        return {r[3] for r in own if (r[1], r[2]) == top} or {None}

    for width in (1, 7, 1000):
        got = as_of_join(lefts, rights, ["k"], "t", F.col("v"), width, tie="tie").collect()
        assert len(got) == len(left) and all(r["as_of"] in brute(r["k"], r["t"]) for r in got)
    assert as_of_join(lefts, rights.limit(0), ["k"], "t", F.col("v"), 5).where("as_of IS NOT NULL").isEmpty()


def test_hot_key_of_an_as_of_join_is_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(40_000).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
        out = as_of_join(rows, rows.withColumn("v", F.col("t")), ["k"], "t", F.col("v"), 100)
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert out.where("as_of = t").count() == 40_000 and len(sizes) > 1 and max(sizes) < 30_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# --- sessions ---------------------------------------------------------------


def calls_of(n, first=0):
    draw = random.Random(first)
    return [{"session": f"s{draw.randrange(4)}", "call": f"c{first + i}", "tool": "t", "created_at": f"2024-01-01T{draw.randrange(10, 12)}:{draw.randrange(60):02d}:00Z", "served": draw.sample(["e:a", "e:b", "e:c", "e:d"], draw.randrange(4))} for i in range(n)]


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_sessions_restart_and_replay(spark, tmp_path):
    """A stream that was stopped and started, and one that starts from the log, end as a fold over all calls does."""
    for k, v in sessions.STATE_STORE.items():
        spark.conf.set(k, v)
    source, parts = tmp_path / "calls", [calls_of(15), calls_of(15, 100), calls_of(15, 200)]
    schema = "session string, call string, tool string, created_at timestamp, served array<string>"
    frame = lambda rows: spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    args = (str(source), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    for n, part in enumerate(parts):  # each time the query ends and is started again
        put(source, f"{n}.json", part)
        sessions.follow_sessions(spark, *args, late="1 day").awaitTermination()
    every = [r for p in parts for r in p]
    want = {r["session"]: r["served"] for r in served_in_order(frame(every)).collect()}
    got = {r["session"]: r for r in sessions.latest_sessions(spark, args[1]).collect()}
    assert {s: r["served"] for s, r in got.items() if r["served"]} == want and sum(r["calls"] for r in got.values()) == len(every)

    put(tmp_path / "tail", "0.json", parts[2])
    sessions.follow_sessions(spark, str(tmp_path / "tail"), str(tmp_path / "out2"), str(tmp_path / "checkpoint2"), log=frame(parts[0] + parts[1]), late="1 day").awaitTermination()
    tail = {r["session"]: r["served"] for r in sessions.latest_sessions(spark, str(tmp_path / "out2")).collect()}
    assert tail == {s: want.get(s, []) for s in tail} and set(tail) == {r["session"] for r in parts[2]}


def test_quiet_sessions_are_closed(spark, tmp_path):
    for k, v in sessions.STATE_STORE.items():
        spark.conf.set(k, v)
    call = lambda s, c, at, ref: {"session": s, "call": c, "tool": "t", "created_at": at, "served": [ref]}
    args = (str(tmp_path / "calls"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    put(tmp_path / "calls", "0.json", [call("s", "1", "2024-01-01T10:00:00Z", "e:a"), call("s", "2", "2024-01-01T10:05:00Z", "e:b")])
    sessions.follow_sessions(spark, *args, idle_ms=600_000, late="1 minute").awaitTermination()
    put(tmp_path / "calls", "1.json", [call("other", "3", "2024-01-01T12:00:00Z", "e:c")])
    sessions.follow_sessions(spark, *args, idle_ms=600_000, late="1 minute").awaitTermination()
    got = {r["session"]: (r["served"], r["closed"]) for r in sessions.latest_sessions(spark, args[1]).collect()}
    assert got["s"] == (["e:a", "e:b"], True) and got["other"] == (["e:c"], False)


# --- files ------------------------------------------------------------------


def test_a_deep_tree_is_listed_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FOLDERS", 3)
    want = set()
    for a in range(4):
        for b in ("", "x", "x/y", ".hid", ".github"):
            p = tmp_path / f"d{a}" / b / f"f{a}.py"
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text("x")
            if b != ".hid":
                want.add(os.path.relpath(p, tmp_path))
    (tmp_path / "top.py").write_text("abc")
    assert any(deep for _, deep in files._folders(str(tmp_path)))
    assert {r["path"] for r in files.listing(spark, str(tmp_path)).collect()} == want | {"top.py"}
    assert files.file_tree(spark, str(tmp_path)).where("path = 'top.py'").first()["bytes"] == 3


def test_only_what_differs_is_read(spark, tmp_path, monkeypatch):
    root, store, read = tmp_path / "r", Store(spark, str(tmp_path / "s")), []
    root.mkdir()
    for n in "abcd":
        (root / f"{n}.py").write_text(n)
    real = watcher.contents
    monkeypatch.setattr(watcher, "contents", lambda s, r, f: read.append(sorted(x["path"] for x in f.collect())) or real(s, r, f))
    kinds = lambda: {r["path"]: r["change"] for r in watcher.scan_changes(store, str(root)).collect()}
    assert kinds() == dict.fromkeys(["a.py", "b.py", "c.py", "d.py"], "new") and kinds() == {}
    os.utime(root / "a.py", (1, 1))  # touched, and the same
    (root / "b.py").write_text("other")
    (root / "c.py").unlink()
    assert kinds() == {"b.py": "changed", "c.py": "missing"} and kinds() == {}
    assert read == [["a.py", "b.py", "c.py", "d.py"], ["a.py", "b.py"]]


# --- hot hubs ---------------------------------------------------------------


def test_links_of_a_hub_are_many_files(spark, tmp_path):
    links = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "e:hub").otherwise(F.concat(F.lit("e:"), "id")).alias("src_ref"), F.lit("has").alias("edge_type"), F.concat(F.lit("e:t"), "id").alias("dst_ref"), F.lit(1).cast("long").alias("version"), F.lit(0).cast("long").alias("created_at_nanos"), F.lit("active").alias("lifecycle"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = graph.EdgeIndex.build(links, str(tmp_path / "e"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["n"] for r in index.forward.where("src_ref = 'e:hub'").groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 10_000 and max(sizes) < 9_000
    assert graph.neighbors(index, spark.createDataFrame([("e:hub",)], "ref string")).count() == 10_000
    with pytest.raises(Exception, match="Path does not exist"):
        graph.EdgeIndex.open(spark, str(tmp_path / "none"))


def test_a_walk_moves_only_what_it_touches(spark, monkeypatch):
    """Without a stored index the frontier reaches the tables: before the exchange for versions, which other kinds never see."""
    from knotlog.plans import catalog, model
    from knotlog.plans.stored import forget

    links = model.links(spark, "/root/testdata/sf0.001")
    index = graph.EdgeIndex.of(links)
    for way, ref in (("f", "e:o/7"), ("r", "e:p/7")):
        plan = index.touching(way, None, 1, [ref])._jdf.queryExecution().optimizedPlan().toString()
        under = [x.split("Relation")[0] for x in plan.split("Window [")[1:]]
        assert len(under) == 2 and all(f"= {ref})" in x for x in under)
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 0)
    near = spark.createDataFrame([("e:c/1",), ("e:c/2",)], "a string")
    plan = index.touching("f", near, 2, None)._jdf.queryExecution().optimizedPlan().toString()
    under = [x.split("Relation")[0] for x in plan.split("Window [")[1:]]
    assert len(under) == 2 and all(">= e:c/1)" in x and "<= e:c/2)" in x for x in under)
    forget()
    catalog.QUERIES["graph_neighbors_fwd"](spark, "/root/testdata/sf0.001")
    assert catalog.built(spark, "/root/testdata/sf0.001", "edges") is None


# --- columns that follow a function of the driver -----------------------------


def test_columns_equal_their_functions(spark):
    texts = ["./a//b/../c.go", "a\\b.go", "/x/y", " . ", "", "../a/../../b", "/../x", "a/..", "..", "a/./b/", "//", "/a/../..", "x/../../y", "30d", "2w", "1h30m", "1.5h", "500ms", "5 parsecs", "1h x", "10us2ns", "d"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")

    def seconds(t):
        try:
            return duration(t).total_seconds()
        except ValueError:
            return None

    for r in frame.select("t", clean_path(F.col("t")).alias("p"), duration_seconds(F.col("t")).alias("s")).collect():
        assert r["p"] == normalize_path(r["t"]), r["t"]
        assert r["s"] == pytest.approx(seconds(r["t"]), abs=1e-6), r["t"]
    pairs = spark.createDataFrame([("a", "b"), ("a", "a"), ("", "b"), (None, "b"), ("a", None)], "x string, y string")
    assert all(r["w"] == (branch_mismatch(r["x"] or "", r["y"] or "") is not None) for r in pairs.select("x", "y", branch_differs(F.col("x"), F.col("y")).alias("w")).collect())
