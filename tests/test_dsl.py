"""The query language: parsing, checks, plans and results."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import types as T

from knotlog.plans import dsl
from knotlog.schema import Registry, SchemaConflict

ROWS = [("a", "api", 0.9, ["x", "y"]), ("b", "db", 0.2, []), ("c", None, None, None), ("d", "api", 0.5, ["y"])]


@pytest.fixture(scope="module")
def notes(spark):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("module", T.StringType()), T.StructField("stability", T.DoubleType()), T.StructField("tags", T.ArrayType(T.StringType()))])
    return spark.createDataFrame(ROWS, schema)


@pytest.fixture
def registry():
    r = Registry()
    r.add_field("nodes", "tags", "[]string")
    r.add_field("nodes", "ok", "bool")
    return r


CASES = {
    "nodes where module = 'api'": "ad",
    "nodes where module != 'api'": "b",
    'nodes WHERE module = "api" AND stability > 0.6': "a",
    "nodes where stability > 0.6 or module = 'db' and stability < 0.1": "a",
    "nodes where stability > -1": "abd",
    "nodes where module contains 'p'": "ad",
    "nodes where tags contains 'x'": "a",
    "nodes where module matches '^d.$'": "b",
    "nodes where module matches '('": "",
    "nodes where module matches 'a(?=p)'": "",
    "nodes order by stability desc limit 2": "ad",
    "nodes order by stability": "cbda",
    "limit_first": None,
}


@pytest.mark.parametrize("text", [c for c in CASES if CASES[c] is not None])
def test_results(notes, registry, text):
    assert "".join(r["id"] for r in dsl.run(text, notes, registry=registry).collect()) == CASES[text]


@pytest.mark.parametrize("text", ["", "nodes where", "nodes where module", "nodes where module =", "nodes where module = 'x", "nodes limit 0", "nodes limit -1", "nodes limit 1 limit 2", "nodes where ;", "nodes as of 'x'", "nodes where traverse(l, depth=1.5) from 'e:a'", "nodes where traverse(l, hops=1) from 'e:a'", "nodes where traverse(l) from ''", "nodes order stability"])
def test_syntax(text):
    with pytest.raises(dsl.SyntaxProblem):
        dsl.parse(text)


def test_checks(registry):
    for text, problem in {"things": dsl.UnknownCollection, "nodes where nope = 1": dsl.UnknownField, "nodes where module > 'a'": dsl.IncompatibleOperator, "nodes where stability contains '1'": dsl.IncompatibleOperator, "nodes where ok matches 'x'": dsl.IncompatibleOperator, "nodes order by nope": dsl.UnknownField}.items():
        with pytest.raises(problem):
            dsl.check(dsl.parse(text), registry)


def test_time():
    assert dsl.time_nanos("1970-01-02") == 86_400 * 10**9
    assert dsl.time_nanos("1970-01-01T00:00:30.123456789Z") == 30_123_456_789
    assert dsl.time_nanos("1970-01-01T01:00:00+01:00") == 0


def test_explain():
    got = dsl.explain(dsl.parse("nodes where stability > 0.5 and module = 'api' order by name limit 3"))
    assert "IndexSeek" in got and "by_module" in got and "Limit:      3" in got
    assert "FullScan" in dsl.explain(dsl.parse("nodes where module = 'a' or module = 'b'"))


def test_pushed_down(spark, notes, tmp_path, registry):
    notes.write.parquet(str(tmp_path / "n"))
    plan = dsl.run("nodes where module = 'api'", spark.read.parquet(str(tmp_path / "n")), registry=registry)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(module,api)" in plan


@given(st.text(max_size=40))
def test_never_crashes(text):
    try:
        dsl.parse(text)
    except dsl.QueryError:
        pass


def test_registry():
    r = Registry()
    assert r.add_field("notes", "rank", "int") and not r.add_field("notes", "rank", "number")
    with pytest.raises(SchemaConflict):
        r.add_field("notes", "rank", "string")
    assert Registry.from_json(r.to_json()) == r
