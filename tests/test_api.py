"""The engine from scan to context, and small helpers."""

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from knotlog.api import Engine, federated
from knotlog.plans import requests
from knotlog.sources.collections import as_json, from_json, render

T0 = datetime(2024, 1, 1, tzinfo=UTC)


def test_engine(spark, tmp_path):
    repo = tmp_path / "repo"
    (repo / "pkg").mkdir(parents=True)
    (repo / "pkg" / "a.py").write_text("import b\n")
    (repo / "pkg" / "b.py").write_text("x = 1\n")
    e = Engine(spark, str(tmp_path / "store"))
    e.scan(str(repo), now=T0)
    assert {r["id"] for r in e.query("nodes where language = 'Python' order by id").collect()} == {"pkg/a.py", "pkg/b.py"}
    assert [r["ref"] for r in e.graph("e:pkg/a.py").collect()] == ["e:b"]
    e.scan(str(repo), now=T0 + timedelta(days=1))
    assert e.log().count() == 3
    (repo / "pkg" / "b.py").write_text("x = 2\n")
    (repo / "pkg" / "a.py").unlink()
    e.scan(str(repo), now=T0 + timedelta(days=2))
    assert [(r["version"], r["line"]) for r in e.history("entity", "pkg/b.py").collect()] == [(1, "file pkg/b.py"), (2, "file pkg/b.py")]
    assert e.query("nodes where status = 'deleted'").first()["id"] == "pkg/a.py"
    rule = spark.createDataFrame([("rule:x", "x", "[file: pkg/b.py:1]\n\nuse it", "must", "file", "annotation")], "id string, title string, body string, severity string, scope string, source string")
    e.put_decisions(rule, T0)
    e.put_decisions(rule, T0)
    assert e.decisions().count() == 1
    got = e.context(["./pkg/a.py"], now=T0).collect()
    assert [r["ref"] for r in got] == ["e:pkg/a.py"]
    assert e.context([], now=T0).count() == 0
    assert {r["id"] if "id" in r else r["doc_id"] for r in e.recall("Python b").collect()} == {"pkg/a.py", "pkg/b.py"}
    assert "FullScan" in e.explain("nodes where name = 'a'")
    assert e.alter("nodes", "owner", "string", "me", dry=True)["records"] == 2
    e.alter("nodes", "owner", "string", "me")
    assert e.query("nodes where owner = 'me'").count() == 2
    assert len(e.topology()) == 3


def test_federated_stores(spark, tmp_path, capsys):
    """One query over several stores; one that is broken is named, the others answer."""
    from knotlog.__main__ import main

    for name in ("one", "two"):
        (tmp_path / name / "src").mkdir(parents=True)
        (tmp_path / name / "src" / f"{name}.py").write_text("x = 1\n")
        (tmp_path / name / "src" / "same.py").write_text("x = 1\n")
        Engine(spark, str(tmp_path / f"{name}.store")).scan(str(tmp_path / name), now=T0)
    roots = {n: str(tmp_path / f"{n}.store") for n in ("one", "two", "none")}
    rows, errors = federated(spark, roots, "nodes where language = 'Python' order by id")
    assert sorted((r["_repo"], r["id"]) for r in rows.collect()) == [("one", "src/one.py"), ("one", "src/same.py"), ("two", "src/same.py"), ("two", "src/two.py")]
    assert list(errors) == ["none"]
    (tmp_path / "repos.toml").write_text("".join(f'[[repos]]\nname = "{n}"\npath = "{p}"\n' for n, p in roots.items()))
    main([str(tmp_path / "repos.toml"), "federate", "nodes where id = 'src/one.py'"])
    said = capsys.readouterr()
    assert "id=src/one.py" in said.out and "_repo=one" in said.out and "none:" in said.err
    main([roots["one"], "explain", "nodes where module = 'src'"])
    assert "Files:" in capsys.readouterr().out


def test_json(spark):
    rows = spark.createDataFrame([('{"id": "n", "tags": ["a"]}',), ("{bad",), (None,)], "value string")
    got = from_json(rows, "notes")
    assert [(r["id"], r["tags"], r["content"]) for r in got.collect()] == [("n", ["a"], None)]
    assert as_json(got).first()["value"] == '{"id":"n","tags":["a"]}'
    assert render(got.select("id", "tags"), "yaml") == "- id: n\n  tags:\n    - a"
    assert '"id": "n"' in render(got, "json") and render(got, "text").startswith("id=n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        from_json(rows, "notes", strict=True).collect()


def test_requests(spark):
    assert requests.duration("1h30m") == timedelta(minutes=90) and requests.duration("2w") == timedelta(days=14)
    with pytest.raises(ValueError):
        requests.duration("5 parsecs")
    assert requests.recipes({"test": {"edge_boost": 0.5}})["test"].boost == 0.5
    with pytest.raises(ValueError):
        requests.recipes({"test": {"weights": {"recency": 3.0}}})
    repos, rules = requests.manifest({"repos": [{"name": "a", "path": "/a"}], "constraints": {"rules": [{"scope": "api", "description": "annotation"}]}})
    assert repos == {"a": "/a"} and rules[0].severity == "should"
    with pytest.raises(ValueError):
        requests.manifest({"repos": [{"name": "a", "path": "/a"}, {"name": "a", "path": "/b"}]})
    df = spark.createDataFrame([("", "bugfix"), ("test", "x"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(requests.workflow_of(F.col("a"), F.col("b"))).collect()] == ["bugfix", "test", "explore"]
    status = spark.createDataFrame([(" M b.go",), ("?? new.go",), ("R  old.go -> a.go",)], "value string")
    assert [r[0] for r in requests.changed_files(status).collect()] == ["a.go", "b.go"]
    sections = spark.createDataFrame([("x", 0.9), ("y", 0.1), ("z", 0.5)], "ref string, score double")
    vectors = spark.createDataFrame([("x", [0.0, 1.0]), ("y", [1.0, 0.0])], "ref string, embedding array<double>")
    assert [r["ref"] for r in requests.rerank(sections, vectors, [1.0, 0.1]).collect()] == ["y", "x", "z"]
    assert requests.served_so_far(["a", "b"], ["b", "c"]) == ["a", "b", "c"]
    assert requests.branch_mismatch("a", "b") and not requests.branch_mismatch("a", "a")


def test_broker():
    from knotlog.streaming.broker import Broker

    b, seen = Broker(), []
    stop = b.subscribe("t", seen.append)
    b.subscribe("t", lambda e: 1 / 0)
    assert b.publish("t", 1) == 1 and seen == [1]
    stop()
    assert b.publish("t", 2) == 0 and seen == [1]


def test_prompt_sections():
    from knotlog.operators.prompts import sections

    assert sections(["a", "nope", "b"], {"b": lambda: "B", "a": lambda: "A"}) == ["A", "B"]
