"""Full-text search over texts: postings, statistics, BM25, tombstones.

A text is taken apart and counted within its row, so nothing of it is moved before
its distinct terms are.  ``textindex`` stores what is found here, for queries
that touch no text.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotlog.functions.text import tokenize
from knotlog.session import spread
from knotlog.sources.scratch import written

K1, B = 1.2, 0.75
#: Ids of replaced and deleted documents that are broadcast at most (two longs each, and twice that for the hash).
BROADCAST_IDS = 2_000_000


def _whole(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``doc_id, text``, one row for each id; texts of one id, which are rare, become one."""
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    if rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return spread(rows)
    return rows.groupBy("doc_id").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))


def _runs(docs: DataFrame, id: str, text: str) -> tuple[DataFrame, Column]:
    """Rows of ``doc_id, t`` (sorted terms), and the array of ``term, freq`` of such a row.

    A document is counted within its row: its terms are sorted and each run is one
    of them, so no occurrence is moved and memory is that of one document.
    """
    rows = _whole(docs, id, text).select("doc_id", F.sort_array(tokenize(F.col("text"))).alias("t"))
    rows = rows.withColumn("at", F.array_compact(F.transform("t", lambda x, i: F.when((i == 0) | (x != F.get(F.col("t"), i - 1)), i))))
    count = lambda i, k: F.coalesce(F.get(F.col("at"), k + 1), F.size("t")) - i  # noqa: E731  up to the next run
    each = F.transform("at", lambda i, k: F.struct(F.get(F.col("t"), i).alias("term"), count(i, k).cast("long").alias("freq")))
    return rows, each


def counted(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, dl, terms`` of every document: its number of terms, and an array of ``term, freq``."""
    rows, each = _runs(docs, id, text)
    return rows.select("doc_id", F.size("t").cast("long").alias("dl"), each.alias("terms"))


def terms(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, term, freq`` of every document."""
    rows, each = _runs(docs, id, text)
    return rows.select("doc_id", F.inline(each))


def postings(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``term, doc_id, freq, positions`` of every term of every document."""
    place = F.transform(tokenize(F.col("text")), lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    rows = _whole(docs, id, text).select("doc_id", F.sort_array(place).alias("t"))
    rows = rows.withColumn("at", F.array_compact(F.transform("t", lambda x, i: F.when((i == 0) | (x["term"] != F.get(F.col("t"), i - 1)["term"]), i))))
    count = lambda i, k: F.coalesce(F.get(F.col("at"), k + 1), F.size("t")) - i
    run = lambda i, k: F.transform(F.slice("t", i + 1, count(i, k)), lambda x: x["pos"])
    each = F.transform("at", lambda i, k: F.struct(F.get(F.col("t"), i)["term"].alias("term"), count(i, k).cast("long").alias("freq"), run(i, k).alias("positions")))
    return rows.select("doc_id", F.inline(each)).select("term", "doc_id", "freq", "positions")


def norms(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, dl``: number of terms of every document."""
    return _whole(docs, id, text).select("doc_id", F.size(tokenize(F.col("text"))).cast("long").alias("dl"))


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query, as the tokenizer makes them."""
    row = SparkSession.getActiveSession().range(1, numPartitions=1).select(F.array_distinct(tokenize(F.lit(query))).alias("t")).first()
    return list(row["t"])


def score(hits: DataFrame, n_docs: int, avgdl: float, counts: dict[str, int]) -> DataFrame:
    """``doc_id, score`` of ``doc_id, term, freq, dl``; ``counts`` has each term's documents.

    Parts are added in order of the terms, whatever order they come in,
    so documents that have the same of each term have the same score to the last bit.
    """
    if not counts:
        return hits.select("doc_id", F.lit(0.0).alias("score")).where("false")
    length = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit(float(avgdl or 1.0)))
    own = lambda t, n: F.lit(math.log((n_docs - n + 0.5) / (n + 0.5) + 1)) * F.col("freq") * F.lit(K1 + 1) / (F.col("freq") + length)
    parts = [F.sum(F.when(F.col("term") == t, own(t, n))).alias(f"p{i}") for i, (t, n) in enumerate(sorted(counts.items()))]
    every = reduce(lambda x, y: x + y, [F.coalesce(f"p{i}", F.lit(0.0)) for i in range(len(parts))])
    return hits.groupBy("doc_id").agg(*parts).select("doc_id", every.alias("score"))


def bm25(docs: DataFrame, query: str, id: str = "doc_id", text: str = "text", deleted: DataFrame | None = None, live_statistics: bool = False) -> DataFrame:
    """``doc_id, score`` of every document with a term of the query, without an index.

    One pass over the texts; ``textindex.Index`` is for more than one query.  ``deleted``
    (``doc_id``) are documents not merged away yet: they are not found and not
    in a term's document count, but count in the corpus size and mean length
    unless ``live_statistics``.
    """
    wanted = query_terms(query)
    of = lambda t: t.isin(wanted) if wanted else F.lit(False)
    rows = _whole(docs, id, text).select("doc_id", tokenize(F.col("text")).alias("t"))
    rows = rows.select("doc_id", F.size("t").cast("long").alias("dl"), F.filter("t", of).alias("hits"))
    per_doc = written(rows, "search")  # texts are read once; what stays of one is its length and its hits
    live = per_doc if deleted is None else per_doc.join(deleted.select("doc_id"), "doc_id", "left_anti")
    corpus = (live if live_statistics else per_doc).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")).first()
    each = F.filter(F.transform(F.array(*map(F.lit, wanted)), lambda w: F.struct(w.alias("term"), F.size(F.filter("hits", lambda t: t == w)).cast("long").alias("freq"))), lambda x: x["freq"] > 0) if wanted else F.array().cast("array<struct<term:string,freq:long>>")
    hits = live.where(F.size("hits") > 0).select("doc_id", "dl", F.inline(each))
    counts = {r["term"]: r["n"] for r in hits.groupBy("term").agg(F.count("*").alias("n")).collect()}  # one row per query term
    return score(hits, corpus["n_docs"], corpus["avgdl"] or 0.0, counts)


def search(docs: DataFrame, query: str, limit: int = 10, **more) -> DataFrame:
    """The best documents for a query; ties in order of the id."""
    return bm25(docs, query, **more).orderBy(F.col("score").desc(), "doc_id").limit(limit)


def merge_segments(old: DataFrame, new: DataFrame, deleted: DataFrame) -> DataFrame:
    """Postings of two segments as one: deleted documents go, the newer of a document stays."""
    dead = deleted.select("doc_id")
    older = written(new.select("doc_id").distinct().unionByName(dead).distinct(), "replaced")
    few = older.count() <= BROADCAST_IDS
    gone = lambda ids: F.broadcast(ids) if few else ids  # noqa: E731  the ids move, postings do not
    return old.join(gone(older), "doc_id", "left_anti").unionByName(new.join(gone(dead), "doc_id", "left_anti"))


def last_posting(rows: DataFrame, order: str = "segment") -> DataFrame:
    """Of several postings of a term and document, the one added last."""
    rest = [c for c in rows.columns if c not in ("term", "doc_id")]
    return rows.groupBy("term", "doc_id").agg(F.max_by(F.struct(*rest), order).alias("x")).select("term", "doc_id", "x.*")


def precision_at(results: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, precision``: share of the first ``k`` results that are relevant.

    ``results`` has ``query_id, doc_id, score``; ``relevant`` has ``query_id, doc_id``.
    """
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    top = results.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    good = relevant.select("query_id", "doc_id").distinct().withColumn("_hit", F.lit(1))
    return top.join(good, ["query_id", "doc_id"], "left").groupBy("query_id").agg((F.count("_hit") / F.lit(float(k))).alias("precision"))
