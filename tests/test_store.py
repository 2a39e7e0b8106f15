"""Snapshots, indexes that keep up with writes, index-aware queries, and back-fills."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from knotlog.operators.fieldindex import FieldIndex, evaluated
from knotlog.plans import dsl
from knotlog.sources.store import Locked, Store

NODE = "id string, module string, type string, tags array<string>, stability double"


def node(i, module, tags=()):
    return (f"n{i}", module, "file" if i % 2 else "dir", list(tags), i % 10 / 10)


def by_module(store, module):
    return {r["key"] for r in store.lookup("nodes", "module", [module]).collect()}


def test_puts_deletes_and_lookups_agree(spark, tmp_path):
    """After each of many commits the table and every index answer as a plain dict does."""
    draw, want = random.Random(2), {}
    store = Store(spark, str(tmp_path / "s"))
    for step in range(7):
        rows = [node(draw.randrange(40), f"m{draw.randrange(4)}", draw.sample("xyz", draw.randrange(3))) for _ in range(8)]
        rows = list({r[0]: r for r in rows}.values())
        frame = spark.createDataFrame(rows, NODE)
        if step == 0:
            store.commit(append={"nodes": frame})
            for field in ("module", "tags"):
                store.add_index("nodes", field)
        elif step == 5:
            store.compact()
            rows = []
        elif step % 3 == 2:
            gone = [r[0] for r in rows]
            store.delete("nodes", spark.createDataFrame([(g,) for g in gone], "id string"))
            want = {k: r for k, r in want.items() if k not in gone}
            rows = []
        else:
            store.put("nodes", frame)
        want |= {r[0]: r for r in rows}
        assert {r["id"]: tuple(r) for r in store.table("nodes").collect()} == want
        for m in (1, 3):
            assert by_module(store, f"m{m}") == {k for k, r in want.items() if r[1] == f"m{m}"}, step
        assert {r["key"] for r in store.lookup("nodes", "tags", ["x"]).collect()} == {k for k, r in want.items() if "x" in r[3]}
        for text in ("nodes where module = 'm1' and stability > 0.3", "nodes where tags contains 'y' and module = 'm2'", "nodes where module = 'm0' or tags contains 'z'", "nodes where module = 'none'", "nodes where stability < 0.5", "nodes where type = 'file' or module = 'm1'"):
            q = dsl.parse(text)
            got, seek = dsl.over_store(registered(q, store), store)
            every = dsl.compile_query(q, store.table("nodes"), registry=store.registry())
            assert sorted(map(repr, got.collect())) == sorted(map(repr, every.collect())), (step, text)
            assert (seek is not None) == ("stability <" not in text and "type" not in text)


def registered(q, store):
    registry = store.registry()
    if registry.add_field("nodes", "tags", "[]string"):
        store.commit(registry=registry)
    return q


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_query_reads_what_its_index_names(spark, tmp_path):
    """An equality reads one bucket of the index and the files that hold the value; the rest goes into the scan."""
    store = Store(spark, str(tmp_path / "s"))
    for k in range(6):
        store.commit(append={"nodes": spark.createDataFrame([node(100 * k + i, f"m{k}") for i in range(20)], NODE).coalesce(1)})
    store.add_index("nodes", "module")
    got, seek = dsl.over_store(dsl.parse("nodes where module = 'm3' and stability > 0.5"), store)
    assert len(seek.files) == 1 and seek.of == 6 and len(got.inputFiles()) == 1 and got.count() == 8
    assert "PushedFilters: [IsNotNull(module), IsNotNull(stability), EqualTo(module,m3), GreaterThan(stability,0.5)]" in plan(got)
    index = store._index(store.manifest(), "nodes", "module").lookup(["m3"])
    assert "PartitionFilters: [isnotnull(bucket" in plan(index) and "EqualTo(value,m3)" in plan(index)
    assert "Files:      1 of 6 by module" in dsl.explain(dsl.parse("nodes where module = 'm3'"), seek)
    none, seek = dsl.over_store(dsl.parse("nodes where module = 'nowhere'"), store)
    assert none.count() == 0 and seek.files == ()


def test_no_index_is_used_for_the_past(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = [("a", "m1", 1, 10), ("a", "m2", 2, 20)]
    store.commit(append={"nodes": spark.createDataFrame(rows[:1], "id string, module string, version long, created_at_nanos long")})
    store.commit(append={"nodes": spark.createDataFrame(rows[1:], "id string, module string, version long, created_at_nanos long")})
    store.add_index("nodes", "module")
    got, seek = dsl.over_store(dsl.parse("nodes where module = 'm1' as of '2024-01-01'"), store)
    assert got.count() == 0 and seek is None


def test_a_hot_value_is_many_files(spark, tmp_path):
    """A value that a third of all rows have is dealt by its keys."""
    rows = spark.range(60_000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 1000)).alias("module"))
    index = FieldIndex.build(rows, "module", str(tmp_path / "i"))
    sizes = [r["n"] for r in spark.read.parquet(str(tmp_path / "i")).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert index.keys(["hot"]).count() == 20_000 and max(sizes) < 12_000
    assert index.keys(["v1", "v2"]).count() == 80


def test_expressions_are_evaluated_without_a_job(spark):
    spark.sparkContext.setJobGroup("probe", "probe")
    try:
        assert evaluated(spark, ["b", "it's", ""], F.length) == [1, 4, 0] and evaluated(spark, [], F.length) == []
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("probe")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_failed_commit_leaves_the_snapshot(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.commit(append={"t": spark.range(3)})
    with pytest.raises(Exception, match="boom"):
        store.commit(append={"t": spark.range(1)}, replace={"t": spark.range(2).select(F.raise_error(F.lit("boom")).cast("long").alias("id"))})
    assert store.table("t").count() == 3 and not os.path.exists(tmp_path / "s" / "writer.lock")
    assert store.commit(append={"t": spark.range(1)}) == 2 and store.manifest(1)["snapshot"] == 1
    # a writer that died between writing and publishing: no manifest, nothing to see
    (tmp_path / "s" / ".manifest-dead").write_text("{")
    assert Store(spark, str(tmp_path / "s")).table("t").count() == 4


def test_a_dead_writer_is_taken_over(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), lease=30)
    store.commit(append={"t": spark.range(3)})
    lock = tmp_path / "s" / "writer.lock"
    lock.write_text(json.dumps({"owner": "x", "at": time.time()}))
    with pytest.raises(Locked, match="held for"):
        store.commit(append={"t": spark.range(1)})
    os.utime(lock, (time.time() - 60, time.time() - 60))
    assert store.commit(append={"t": spark.range(1)}) == 2 and not lock.exists()


def test_who_lost_the_lock_publishes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), lease=30)
    store.commit(append={"t": spark.range(3)})
    with pytest.raises(Locked, match="took over"), store._writing() as m:
        os.utime(tmp_path / "s" / "writer.lock", (1, 1))
        Store(spark, str(tmp_path / "s"), lease=30).commit(append={"t": spark.range(2)})
        store._part(m, "t", spark.range(100), True)
    assert store.table("t").count() == 5 and store.manifest()["snapshot"] == 2


def test_backfill_goes_on_where_it_stopped(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    for k in range(5):
        store.commit(append={"nodes": spark.createDataFrame([node(10 * k + i, f"m{k}") for i in range(10)], NODE).coalesce(1)})
    store.add_index("nodes", "module")
    store.start_backfill("nodes", "owner", "me", "string")
    assert store.table("nodes").where("owner IS NULL").count() == 50 and store.progress("nodes", "owner") == 5
    assert store.backfill("nodes", "owner", batch=2, batches=1) == 3
    store.start_backfill("nodes", "owner", "you", "string")  # started again: nothing changes
    other = Store(spark, str(tmp_path / "s"))
    assert other.progress("nodes", "owner") == 3 and other.table("nodes").where("owner = 'me'").count() == 20

    real = other._part
    other._part = lambda *a: (real(*a), 1 / 0)  # a crash after the files were written
    with pytest.raises(ZeroDivisionError):
        other.backfill("nodes", "owner", batch=2, batches=1)
    other._part = real
    assert other.progress("nodes", "owner") == 3 and other.table("nodes").count() == 50
    # rows put meanwhile, with the field and without it, into files done and not done
    other.put("nodes", spark.createDataFrame([(*node(1, "m0"), "own"), (*node(49, "m9"), None)], NODE + ", owner string"))
    other.delete("nodes", spark.createDataFrame([("n30",)], "id string"))
    assert other.backfill("nodes", "owner", batch=2) == 0 and other.backfill("nodes", "owner") == 0
    got = {r["id"]: r["owner"] for r in other.table("nodes").collect()}
    assert len(got) == 49 and got["n1"] == "own" and set(got.values()) == {"own", "me"}
    assert by_module(other, "m9") == {"n49"} and len(by_module(other, "m3")) == 9


def test_vacuum_keeps_what_is_named(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.commit(append={"nodes": spark.createDataFrame([node(i, "m") for i in range(9)], NODE)})
    store.add_index("nodes", "module")
    store.put("nodes", spark.createDataFrame([node(3, "other")], NODE))
    later = lambda: time.time() + 1e6
    assert store.vacuum() == 0  # files may be a writer's that has not published yet
    assert store.vacuum(keep=9, now=later) == 0
    assert store.vacuum(now=later) > 0 and store.table("nodes").count() == 9 and by_module(store, "other") == {"n3"}


def test_partitioned_tables(spark, tmp_path):
    """Their columns in folders survive appends, puts, deletes and compaction; indexes by file are refused."""
    store = Store(spark, str(tmp_path / "s"))
    frame = lambda *rows: spark.createDataFrame(list(rows), "id string, module string, v int")
    store.commit(append={"t": frame(("a", "m1", 1), ("b", "m2", 2))}, partition={"t": ["module"]})
    store.commit(append={"t": frame(("c", "m1", 3))})
    store.put("t", frame(("b", "m3", 4)))
    store.delete("t", spark.createDataFrame([("a",)], "id string"))
    store.compact()
    assert sorted((r["id"], r["module"], r["v"]) for r in store.table("t").collect()) == [("b", "m3", 4), ("c", "m1", 3)]
    assert "PartitionFilters: [isnotnull(module" in plan(store.table("t").where("module = 'm1'"))
    with pytest.raises(ValueError, match="partitioned"):
        store.add_index("t", "module")
