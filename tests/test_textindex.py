"""The stored text index: top-k by blocks, segments, deletions, merges."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from knotlog.functions.text import tokenize
from knotlog.operators import search, textindex
from knotlog.operators.textindex import Index

DOC = "doc_id long, text string"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """4,000 documents of words from the very frequent to the rare, in blocks of 20."""
    draw = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = [(i, " ".join(draw.choices(words, weights, k=draw.randrange(1, 60)))) for i in range(4_000)]
    rows += [(5_000 + i, "twin w3 w200") for i in range(30)]  # ties over many blocks
    patch = pytest.MonkeyPatch()
    patch.setattr(textindex, "BLOCK_DOCS", 20)
    patch.setattr(textindex, "FREQUENT", 40)
    patch.setattr(textindex, "DIRECT", 0)
    patch.setattr(textindex, "FIRST", 8)
    yield Index.build(spark.createDataFrame(rows, DOC), str(tmp_path_factory.mktemp("i") / "x"), buckets=4)
    patch.undo()


def best(df):
    return [(r["doc_id"], round(r["score"], 9)) for r in df.collect()]


def by_all(index, query, limit, **more):
    return best(index.bm25(query, **more).orderBy(F.col("score").desc(), "doc_id").limit(limit))


@pytest.mark.parametrize(("query", "limit"), [("w0 w150 w390", 10), ("w0", 10), ("w399", 10), ("w1 w2 w3 w4", 3), ("twin", 10), ("twin w3", 40), ("w0 nothing", 10), ("w7", 5_000), ("nothing", 10)])
def test_best_by_blocks_are_the_best(corpus, query, limit):
    got, work = corpus.searched(query, limit)
    assert best(got) == by_all(corpus, query, limit)
    assert work.postings <= work.of_postings and work.blocks <= work.of_blocks


def test_fewer_postings_are_read(corpus):
    """Blocks whose bound is under the tenth score are left out."""
    for query in ("w0", "w0 w350", "w5 w120"):
        _, work = corpus.searched(query, 10)
        assert work.postings < work.of_postings / 2, (query, work)


def test_named_and_joined_blocks_are_the_same(corpus, monkeypatch):
    want = best(corpus.search("w0 w9", 60))
    monkeypatch.setattr(textindex, "NAMED", 0)
    assert best(corpus.search("w0 w9", 60)) == want == by_all(corpus, "w0 w9", 60)


def test_scan_skips_by_term_and_block(corpus):
    """Bucket, term and blocks reach the scan."""
    plan = corpus._in_blocks(["w0"], corpus._numbers(["w0"]), [(0, 1), (0, 2)])._jdf.queryExecution().executedPlan().toString()
    assert "In(block, [1,2])" in plan and "EqualTo(term,w0)" in plan and "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan


@pytest.mark.parametrize("direct", [0, 10**6])
def test_adds_and_deletes_equal_a_rebuilt_index(spark, tmp_path, monkeypatch, direct):
    """Ten adds and deletes, with merges on the way, find what an index of the live documents finds."""
    for name, value in (("BLOCK_DOCS", 5), ("FREQUENT", 10), ("DIRECT", direct), ("FIRST", 2), ("FANOUT", 3)):
        monkeypatch.setattr(textindex, name, value)
    draw, live, index = random.Random(3), {}, None
    say = lambda: " ".join(draw.choices(["alpha", "beta", "gamma", "deltaEps", "東京都"], [9, 3, 2, 1, 1], k=draw.randrange(0, 9))) or None
    merged = 0
    for step in range(10):
        ids = draw.sample(range(60), 8)
        if step % 4 == 3:
            index.delete(spark.createDataFrame([(i,) for i in ids], "doc_id long"))
            live = {i: t for i, t in live.items() if i not in ids}
            continue
        rows = [(i, say()) for i in ids]
        live |= dict(rows)
        frame = spark.createDataFrame(rows, DOC)
        index = index or Index(spark, str(tmp_path / "i"), 3)
        before = len(index.segments)
        index.add(frame)
        merged += len(index.segments) <= before
    assert merged and 1 < len(index.segments) < 9 and sum(s["gone"] for s in index.segments)
    assert sum(s["docs"] - s["gone"] for s in index.segments) == len(live)
    frame = spark.createDataFrame(list(live.items()), DOC)
    for q in ("alpha", "gamma eps 京都", "beta beta"):
        want = {r["doc_id"]: pytest.approx(r["score"]) for r in search.bm25(frame, q).collect()}
        assert {r["doc_id"]: r["score"] for r in index.bm25(q, live_statistics=True).collect()} == want
        assert best(index.search(q, 7, live_statistics=True)) == by_all(index, q, 7, live_statistics=True)
    # one anti-join a segment with dead documents, however many adds and deletes there were
    plan = index.hits(["alpha"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == sum(1 for s in index.segments if s["gone"])
    index.save()
    again, want = Index.open(spark, str(tmp_path / "i")), by_all(index, "alpha", 7, live_statistics=True)
    again.compact()
    assert best(again.search("alpha", 7)) == want and not again.segments[0]["gone"]


def test_an_index_of_nothing(spark, tmp_path):
    empty = Index(spark, str(tmp_path / "none"), 3)
    empty.compact()
    assert empty.search("alpha").count() == 0 and empty.bm25("alpha").count() == 0
    built = Index.build(spark.createDataFrame([], DOC), str(tmp_path / "zero"))
    assert built.search("alpha").count() == 0
    built.add(spark.createDataFrame([(1, "alpha"), (2, None)], DOC))
    assert best(built.search("alpha"))[0][0] == 1


def test_buckets_are_those_of_the_column(spark, corpus):
    words = ["", "a", "w399", "東京", "x" * 100]
    frame = spark.createDataFrame([(w,) for w in words], "t string").select(corpus._bucket(F.col("t")).alias("b"))
    assert corpus._numbers(words) == sorted({r["b"] for r in frame.collect()})


def test_a_term_of_every_document_is_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "BUCKET_ROWS", 1_000)
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("hot own"), F.col("id") % 7).alias("text"))
    index = Index.build(docs, str(tmp_path / "i"))
    sizes = [r["n"] for r in spark.read.parquet(f"{index.segments[0]['name']}/postings").where("term = 'hot'").groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 12_000 and max(sizes) < 3_000


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("abAB19_ .-Zz"), max_size=24))
def test_query_terms_are_the_tokenizers(spark, text):
    want = spark.sql("SELECT * FROM VALUES (:t) AS v(t)", args={"t": text}).select(F.array_distinct(tokenize(F.col("t"))).alias("x")).first()["x"]
    assert textindex.query_terms(spark, text) == list(want)


def test_order_of_parts_is_no_part_of_a_score(spark):
    """Documents with the same of each term tie to the last bit, however their postings come."""
    of = lambda d, order: [(t, d, f, 9) for t, f in sorted({"a": 1, "b": 2, "c": 5, "e": 7}.items(), key=lambda x: order.index(x[0]))]
    rows = [r for d, order in enumerate(("abce", "ecba", "bcea", "caeb", "aecb", "ebac")) for r in of(d, order)]
    hits = spark.createDataFrame(rows, "term string, doc_id long, freq long, dl long").coalesce(1)
    assert search.score(hits, 1_000, 7.3, {"a": 3, "b": 41, "c": 500, "e": 77}).select("score").distinct().count() == 1


def test_counting_moves_no_words(spark):
    """Terms are counted within a document's row; of one id twice, texts are one."""
    docs = spark.createDataFrame([(i, "the parseJSON the") for i in range(50)], DOC)
    for plan in (search.terms(docs), search.postings(docs), search.norms(docs)):
        assert "hashpartitioning" not in plan._jdf.queryExecution().executedPlan().toString()
    twice = spark.createDataFrame([(1, "the The"), (1, "the"), (2, None)], DOC)
    assert [tuple(r) for r in search.terms(twice).collect()] == [(1, "the", 3)]
    assert sorted(map(tuple, search.norms(twice).collect())) == [(1, 3), (2, 0)]


def test_bounds_lie_with_the_first_posting_of_a_block(spark, corpus):
    """Blocks are written without an exchange of their own: counts and bests are those of the postings."""
    s = corpus.segments[0]
    posts, bound = corpus._table(s, "postings"), corpus._table(s, "blocks")
    assert posts.agg(F.sum("n")).first()[0] == posts.count() == s["rows"]
    want = posts.groupBy("term", "block").agg(F.count("*").alias("n"), F.max(textindex.part(s["avgdl"])).alias("best"))
    often = posts.groupBy("term").count().where(F.col("count") >= s["frequent"]).select("term")
    assert sorted(map(tuple, bound.select("term", "block", "n", "best").collect())) == sorted(map(tuple, want.join(often, "term").select("term", "block", "n", "best").collect()))
