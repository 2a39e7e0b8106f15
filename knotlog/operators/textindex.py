"""A stored inverted index: segments of postings, block-max top-k, tiered merges.

Postings lie in buckets of terms, sorted by term, block and document, each with
its document's length; a block is a set of documents chosen by a hash.  Beside
them stand the document frequency of each term and, for frequent terms, the best
part of a score that each block can give.  The best documents of a query are
found by reading the blocks with the highest bounds first and then only those
that can still reach what was found.

Every segment has a list of its documents that newer ones replaced or that were
deleted, so live postings are one anti-join for each segment.  Segments of like
size are merged when there are ``FANOUT`` of them.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from dataclasses import dataclass, field
from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotlog.functions.text import tokenize
from knotlog.operators.fieldindex import evaluated
from knotlog.operators.search import K1, B, counted, score
from knotlog.sources.scratch import remove, written

#: Postings of one bucket (about), documents of one block (about), and postings from which a term has bounds by block.
BUCKET_ROWS, BLOCK_DOCS, FREQUENT = 5_000_000, 4_096, 65_536
#: Postings of a query that are scored without looking at blocks, and that one task scores; terms whose counts are kept.
DIRECT, ONE_TASK, KEPT_TERMS = 1_000_000, 100_000, 100_000
#: Blocks that are read first, blocks that are named in a scan at most, and dead documents that are broadcast at most.
FIRST, NAMED, BROADCAST_DEAD = 32, 2_000, 500_000
#: Frequent terms that are broadcast at most, to keep their bounds only.
BROADCAST_TERMS = 500_000
#: Segments of like size that are merged.
FANOUT = 6

_KINDS = {
    "norms": "doc_id long, dl long",
    "postings": "term string, block int, doc_id long, freq long, dl long, n long, best double, bucket int",
    "dictionary": "term string, df long, bucket int",
    "blocks": "term string, block int, n long, best double, bucket int",
}
_ASCII_WORD = re.compile(r"[A-Za-z0-9_]+").findall
_ASCII_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])").split


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """Distinct terms of a query, as the tokenizer makes them; no job runs."""
    if not query.isascii():
        return list(evaluated(spark, [query], lambda c: F.array_distinct(tokenize(c)))[0])
    out: dict[str, None] = {}
    for word in _ASCII_WORD(query):
        parts = [p for s in word.split("_") if s for p in _ASCII_CAMEL(s) if p]
        out |= dict.fromkeys(p.lower() for p in (*(parts if len(parts) > 1 else ()), word))
    return list(out)


@dataclass(frozen=True)
class Work:
    """What a search read: blocks and postings, of those that its terms have."""

    blocks: int
    of_blocks: int
    postings: int
    of_postings: int


@dataclass
class Index:
    """A stored inverted index in a folder; ``save`` writes what ``open`` reads."""

    spark: SparkSession
    path: str
    buckets: int
    segments: list[dict] = field(default_factory=list)
    block_docs: int = 0
    frequent: int = 0
    #: Tables of segments, which never change, as opened; and what terms count, by the segments' state.
    _opened: dict[tuple[str, str], DataFrame] = field(default_factory=dict, repr=False)
    _counted: dict[tuple, tuple[int, dict[int, int]]] = field(default_factory=dict, repr=False)

    # --- the folder

    @classmethod
    def build(cls, docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", buckets: int | None = None, block_docs: int = 0, frequent: int = 0) -> Index:
        """An index of ``docs`` (one row for each id) in a new folder; ``BLOCK_DOCS`` and ``FREQUENT`` hold where nothing is said."""
        index = cls(docs.sparkSession, path.rstrip("/"), buckets or 0, block_docs=block_docs, frequent=frequent)
        index.add(docs, id, text)
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        """The index that ``save`` left in a folder."""
        row = spark.read.text(f"{path.rstrip('/')}/manifest").first()
        return cls(spark, path.rstrip("/"), **json.loads(row["value"]))

    def save(self) -> None:
        """Writes the list of segments beside them."""
        value = json.dumps({"buckets": self.buckets, "segments": self.segments, "block_docs": self.block_docs, "frequent": self.frequent})
        self.spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest")

    # --- writing

    def add(self, docs: DataFrame, id: str = "doc_id", text: str = "text", merge: bool = True) -> None:
        """Documents as a new segment, which takes the place of older documents of their ids."""
        found = written(counted(docs, id, text).withColumn("n", F.size("terms")), "documents")
        lengths = found.select("doc_id", "dl")
        self._bury(lengths)
        rows = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        self.segments.append(self._write(found.select("doc_id", "dl", F.inline("terms")), lengths, rows))
        if merge:
            self._merge_tiers()

    def delete(self, ids: DataFrame) -> None:
        """Takes out documents (``doc_id``) of the segments there are now."""
        self._bury(ids)

    def _bury(self, ids: DataFrame) -> None:
        """Adds the documents of some ids to the dead of every segment that has them alive."""
        ids = ids.select("doc_id").distinct()
        for s in self.segments:
            gone = written(self._alive(s, self._table(s, "norms")).join(ids, "doc_id", "left_semi"), "dead")
            n = gone.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
            if n["n"]:
                path = f"{s['name']}/dead-{uuid.uuid4().hex}"
                gone.coalesce(max(1, n["n"] // 1_000_000)).write.parquet(path)
                s["dead"].append(path)
                s["gone"], s["gone_dl"] = s["gone"] + n["n"], s["gone_dl"] + n["dl"]

    def _write(self, found: DataFrame, lengths: DataFrame, rows: int) -> dict:
        """A segment of ``rows`` rows of ``doc_id, term, freq, dl`` and the documents' lengths.

        Postings move once, to be dealt by ranges; the first posting of a term in a
        block has the block's count and best part, so bounds move nothing.
        """
        name = f"{self.path}/segment-{uuid.uuid4().hex}"
        counts = lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
        n, avgdl = counts["n"], counts["dl"] / counts["n"] if counts["n"] else 0.0
        self.buckets = self.buckets or max(8, -(-rows // BUCKET_ROWS))
        blocks, frequent = max(1, n // (self.block_docs or BLOCK_DOCS)), self.frequent or FREQUENT
        # dealt by ranges down to pieces of a block, so a term that every document has is as many tasks as its postings need
        parts, pieces = max(self.buckets, -(-rows // BUCKET_ROWS)), max(1, 4 * n // blocks // BUCKET_ROWS)
        block = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(blocks)).cast("int")
        piece = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(pieces)).cast("int")
        each = found.select(self._bucket(F.col("term")).alias("bucket"), "term", block.alias("block"), piece.alias("piece"), "doc_id", "freq", "dl")
        key = ["bucket", "term", "block", "piece"]
        own = Window.partitionBy(*key)
        first = F.row_number().over(own.orderBy("doc_id")) == 1
        held = each.repartitionByRange(parts, *key).withColumns({"n": F.count("*").over(own), "best": F.max(part(avgdl)).over(own), "first": first})
        held = held.withColumns({"n": F.when(F.col("first"), F.col("n")), "best": F.when(F.col("first") & (F.col("n") > 1), F.col("best"))})
        held.select("bucket", "term", "block", "doc_id", "freq", "dl", "n", "best").write.partitionBy("bucket").parquet(f"{name}/postings")
        stored = self.spark.read.schema(_KINDS["postings"]).parquet(f"{name}/postings")
        words = written(stored.groupBy("bucket", "term").agg(F.count("*").alias("df")), "dictionary")
        words.repartitionByRange(self.buckets, "bucket", "term").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{name}/dictionary")
        often = words.where(F.col("df") >= frequent).select("term")
        bound = stored.where("n IS NOT NULL").select("bucket", "term", "block", "n", F.coalesce("best", part(avgdl)).alias("best"))
        if often.count() <= BROADCAST_TERMS:  # of more, the bounds of rare terms stay, which nothing reads
            bound = bound.join(F.broadcast(often), "term", "left_semi")
        bound.write.parquet(f"{name}/blocks")  # in order as the postings are
        lengths.write.parquet(f"{name}/norms")
        return {"name": name, "docs": n, "dl": counts["dl"], "blocks": blocks, "avgdl": avgdl, "rows": rows, "frequent": frequent, "dead": [], "gone": 0, "gone_dl": 0}

    def _merge_tiers(self) -> None:
        """Merges segments of one size class while a class has ``FANOUT`` of them."""
        while True:
            tiers: dict[int, list[dict]] = {}
            for s in self.segments:
                tiers.setdefault(int(math.log(max(s["docs"] - s["gone"], 1), FANOUT)), []).append(s)
            full = next((t for _, t in sorted(tiers.items()) if len(t) >= FANOUT), None)
            if full is None:
                return
            self._merge(full)

    def _merge(self, segments: list[dict]) -> None:
        """Some segments as one of their live documents."""
        union = lambda table: reduce(DataFrame.unionByName, [self._alive(s, self._table(s, table)) for s in segments])
        found = union("postings").select("doc_id", "term", "freq", "dl")
        made = self._write(found, written(union("norms"), "lengths"), found.count())
        self.segments = [s for s in self.segments if s not in segments] + [made]
        remove(self.spark, [s["name"] for s in segments])

    def compact(self) -> None:
        """One segment of the live documents."""
        if self.segments:
            self._merge(list(self.segments))

    # --- reading

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _table(self, s: dict, table: str) -> DataFrame:
        key = (s["name"], table)
        if key not in self._opened:
            self._opened[key] = self.spark.read.schema(_KINDS[table]).parquet(f"{s['name']}/{table}")
        return self._opened[key]

    def _alive(self, s: dict, rows: DataFrame) -> DataFrame:
        """Rows of a segment without those of its dead documents."""
        if not s["gone"]:
            return rows
        dead = self.spark.read.parquet(*s["dead"]).select("doc_id")
        return rows.join(F.broadcast(dead) if s["gone"] <= BROADCAST_DEAD else dead, "doc_id", "left_anti")

    def _of_terms(self, s: dict, table: str, words: list[str], numbers: list[int]) -> DataFrame:
        return self._table(s, table).where(F.col("bucket").isin(numbers) & F.col("term").isin(words))

    def _numbers(self, words: list[str]) -> list[int]:
        """Buckets of some terms; the hash is Spark's own."""
        signed = lambda w: (xxhash.xxh64_intdigest(w.encode(), 42) ^ 1 << 63) - (1 << 63)
        return sorted({signed(w) % self.buckets for w in words})

    def hits(self, words: list[str]) -> DataFrame:
        """``term, doc_id, freq, dl`` of the live documents with one of the terms."""
        numbers = self._numbers(words)
        each = [self._alive(s, self._of_terms(s, "postings", words, numbers)).select("term", "doc_id", "freq", "dl") for s in self.segments]
        return reduce(DataFrame.unionByName, each) if each else self.spark.createDataFrame([], "term string, doc_id long, freq long, dl long")

    def _frequencies(self, words: list[str]) -> tuple[dict[str, int], dict[tuple[int, str], int]]:
        """Live documents of each term, and its postings by segment; what was read once is kept.

        The dictionary has the postings; of segments with dead documents the
        postings of these are counted and taken off.
        """
        state = tuple((s["name"], s["gone"]) for s in self.segments)
        new = [w for w in words if (state, w) not in self._counted]
        if new:
            if len(self._counted) > KEPT_TERMS:
                self._counted.clear()
            numbers = self._numbers(new)
            known = [self._of_terms(s, "dictionary", new, numbers).select(F.lit(k).alias("k"), "term", "df", F.lit(False).alias("dead")) for k, s in enumerate(self.segments)]
            for k, s in enumerate(self.segments):
                if s["gone"]:
                    dead = self.spark.read.parquet(*s["dead"]).select("doc_id")
                    lost = self._of_terms(s, "postings", new, numbers).join(F.broadcast(dead) if s["gone"] <= BROADCAST_DEAD else dead, "doc_id", "left_semi")
                    known.append(lost.groupBy("term").agg(F.count("*").alias("df")).select(F.lit(k).alias("k"), "term", "df", F.lit(True).alias("dead")))
            found: dict[str, tuple[int, dict[int, int]]] = {w: (0, {}) for w in new}
            for r in reduce(DataFrame.unionByName, known).collect() if known else ():  # a row or two for each term and segment
                live, of = found[r["term"]]
                if not r["dead"]:
                    of[r["k"]] = r["df"]
                found[r["term"]] = (live - r["df"] if r["dead"] else live + r["df"], of)
            self._counted |= {(state, w): x for w, x in found.items()}
        mine = {w: self._counted[state, w] for w in words}
        return {w: n for w, (n, _) in mine.items() if n}, {(k, w): n for w, (_, of) in mine.items() for k, n in of.items()}

    def _corpus(self, live_statistics: bool) -> tuple[int, float]:
        """Documents and their mean length."""
        n, dl = sum(s["docs"] for s in self.segments), sum(s["dl"] for s in self.segments)
        if live_statistics:
            n, dl = n - sum(s["gone"] for s in self.segments), dl - sum(s["gone_dl"] for s in self.segments)
        return n, dl / n if n else 0.0

    def bm25(self, query: str, live_statistics: bool = False) -> DataFrame:
        """``doc_id, score`` of every live document with a term of the query.

        Documents not merged away yet count in the corpus size and mean length
        unless ``live_statistics``.
        """
        words = query_terms(self.spark, query)
        live, _ = self._frequencies(words)
        n, avgdl = self._corpus(live_statistics)
        return score(self.hits(words), n, avgdl, live)

    def search(self, query: str, limit: int = 10, live_statistics: bool = False) -> DataFrame:
        """The best documents for a query; ties in order of the id."""
        return self.searched(query, limit, live_statistics)[0]

    def searched(self, query: str, limit: int = 10, live_statistics: bool = False, direct: int | None = None) -> tuple[DataFrame, Work]:
        """``search``, and what it read; up to ``direct`` postings are all scored (``DIRECT``)."""
        words = query_terms(self.spark, query)
        numbers = self._numbers(words)
        live, stored = self._frequencies(words)
        n, avgdl = self._corpus(live_statistics)
        total = sum(stored.values())
        best = lambda hits: score(hits, n, avgdl, live).orderBy(F.col("score").desc(), "doc_id").limit(limit)
        if total <= (DIRECT if direct is None else direct):  # few postings need no exchange
            hits = self.hits(words)
            return best(hits.coalesce(1) if total <= ONE_TASK else hits), Work(0, 0, total, total)
        bounds = written(self._bounds(words, numbers, live, stored, n, avgdl), "bounds")
        every = bounds.agg(F.count("*").alias("b"), F.sum("n").alias("n")).first()
        first = bounds.orderBy(F.col("bound").desc(), "k", "block").limit(FIRST).collect()
        found = written(score(self._in_blocks(words, numbers, [(r["k"], r["block"]) for r in first]), n, avgdl, live), "first-blocks")
        top = [r["score"] for r in found.orderBy(F.col("score").desc()).limit(limit).collect()]
        least = top[-1] * (1 - 1e-9) if len(top) == limit else -math.inf
        done = {(r["k"], r["block"]) for r in first}
        rest = bounds.where(F.col("bound") >= least)
        named = rest.limit(NAMED + FIRST + 1).collect()
        if len(named) <= NAMED + FIRST:
            more = [r for r in named if (r["k"], r["block"]) not in done]
            work = Work(len(first) + len(more), every["b"], sum(r["n"] for r in [*first, *more]), every["n"])
            hits = self._in_blocks(words, numbers, [(r["k"], r["block"]) for r in more]) if more else None
        else:
            late = rest.join(self.spark.createDataFrame(list(done), "k int, block int"), ["k", "block"], "left_anti")
            sums = late.agg(F.count("*").alias("b"), F.sum("n").alias("n")).first()
            work = Work(len(first) + sums["b"], every["b"], sum(r["n"] for r in first) + sums["n"], every["n"])
            each = [self._alive(s, self._of_terms(s, "postings", words, numbers).join(late.where(F.col("k") == k).select("block"), "block", "left_semi")) for k, s in enumerate(self.segments)]
            hits = reduce(DataFrame.unionByName, [x.select("term", "doc_id", "freq", "dl") for x in each])
        both = found if hits is None else found.unionByName(score(hits, n, avgdl, live))
        return both.orderBy(F.col("score").desc(), "doc_id").limit(limit), work

    def _bounds(self, words: list[str], numbers: list[int], live: dict[str, int], stored: dict[tuple[int, str], int], n: int, avgdl: float) -> DataFrame:
        """``k, block, bound, n``: the most that a document of each block of each segment can score, and the postings there.

        What a block's documents give at most was computed with the mean length
        of its segment; a larger one now can raise it by their ratio at most.
        """
        idf = F.create_map(*[F.lit(x) for t, df in live.items() for x in (t, math.log((n - df + 0.5) / (df + 0.5) + 1))]) if live else F.lit(None).cast("map<string,double>")
        each = []
        for k, s in enumerate(self.segments):
            often = [w for w in words if stored.get((k, w), 0) >= s["frequent"]]
            rare = [w for w in words if 0 < stored.get((k, w), 0) < s["frequent"]]
            of_block = [self._of_terms(s, "blocks", often, numbers).groupBy("term", "block").agg(F.sum("n").alias("n"), F.max("best").alias("best"))] if often else []
            if rare:
                of_block.append(self._of_terms(s, "postings", rare, numbers).groupBy("term", "block").agg(F.count("*").alias("n"), F.max(part(s["avgdl"])).alias("best")))
            stretch = max(1.0, avgdl / s["avgdl"]) if s["avgdl"] else 1.0
            for rows in of_block:
                each.append(rows.select(F.lit(k).alias("k"), "block", (F.coalesce(F.element_at(idf, F.col("term")), F.lit(0.0)) * F.col("best") * stretch).alias("bound"), "n"))
        return reduce(DataFrame.unionByName, each).groupBy("k", "block").agg(F.sum("bound").alias("bound"), F.sum("n").alias("n"))

    def _in_blocks(self, words: list[str], numbers: list[int], blocks: list[tuple[int, int]]) -> DataFrame:
        """``hits`` of some blocks, which are named in the scan."""
        each = []
        for k, s in enumerate(self.segments):
            own = [b for x, b in blocks if x == k]
            if own:
                each.append(self._alive(s, self._of_terms(s, "postings", words, numbers).where(F.col("block").isin(own))).select("term", "doc_id", "freq", "dl"))
        return reduce(DataFrame.unionByName, each)


def part(avgdl: float) -> Column:
    """What a posting gives to a score, but for the weight of its term."""
    return F.col("freq") * F.lit(K1 + 1) / (F.col("freq") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit(float(avgdl or 1.0))))
