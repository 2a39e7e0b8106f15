"""Spelling variant grouping by rolling-hash deletions (operator 11).

Two words are near if one inserted, deleted or replaced code point makes them
equal.  Every word gives a key for itself and one for each deletion of a code
point; prefix and suffix polynomial hashes give all of a batch's keys as one
NumPy array.  Keys are dealt by their high bits and sorted; what shares no key
with another word is left behind.  The rest is confirmed on strings: rows are
grouped by what the deletion leaves, at the same place for replacements, at the
first of equal letters for insertions, so that each near pair is seen once.

A group is never expanded into pairs.  Its rows are ordered by count; each word
takes the group's size and its first word other than itself.  Windows spill, and
a group has at most a word for each letter and place, whatever the corpus.

Scale: occurrences are counted with partial sums before any exchange; after
that all work is on distinct words, some twice their length of 20-byte keys
each.  Forms are followed to their ends by doubling, on the shared folder; a
form is at least ``FACTOR`` times as frequent, so chains are short and have no
cycle.

Defined cases: a null text has no runs; a run of a row with a null id is never
altered by the query.  Repeated rows count each.  Words that are equal but for
accents are different.  An empty table gives an empty result.  A word of any
length is handled; memory goes with the longest word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotlog.llm._common import mapped, mix, table, written

MIN_CHARS, MIN_COUNT, FACTOR = 6, 5, 5
#: Letters of a run: A-Z, a-z and U+00C0 to U+00FF.
RUN = "[A-Za-zÀ-ÿ]+"
#: Code points whose keys are made at once, about.
STEP = 1 << 18

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))


def runs(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, run``: every run of letters of every text, A-Z lower-cased."""
    each = docs.select(F.col(id).alias("doc"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), 0)).alias("run"))
    return each.select("doc", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))


def frequent(words: DataFrame, word: str = "word", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of the words that are long and frequent enough."""
    return words.select(F.col(word).alias("word")).where(F.char_length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, owner and place of every deletion of a code point; place -1 is the whole word."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    size = np.array([len(w) for w in words])
    end = np.cumsum(size)
    start, owner = end - size, np.repeat(np.arange(len(words)), size)
    place = np.arange(len(letters)) - start[owner]
    powers = np.full(int(size.max(initial=0)) + 1, _BASE, np.uint64)
    powers[0] = 1
    sums = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(mix(letters + np.uint64(0x51)) * np.cumprod(powers, dtype=np.uint64)[place], out=sums[1:])
    prefix = sums[:-1] - sums[start[owner]]
    suffix = (sums[end[owner]] - sums[1:]) * _BACK
    whole = mix(sums[end] - sums[start] + size.astype(np.uint64))
    left = mix(prefix + suffix + (size[owner] - 1).astype(np.uint64))
    return np.r_[whole, left], np.r_[np.arange(len(words)), owner], np.r_[np.full(len(words), -1), place]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        ends = np.cumsum([len(w) for w in words])
        at = 0
        while at < len(words):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right")))
            key, owner, place = deletion_keys(words[at:to])
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(ids[at:to][owner]), pa.array(place, pa.int32())], ["key", "id", "place"])
            at = to


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose key several words have; keys come sorted, and the last of a batch waits for the next."""
    names = ["key", "id", "place"]

    def found(columns: list[np.ndarray]) -> pa.RecordBatch:
        key, id, _ = columns
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        keep = np.repeat(np.minimum.reduceat(id, start) != np.maximum.reduceat(id, start), size)
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names)

    wait = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32)]
    for batch in batches:
        if not batch.num_rows:
            continue
        wait = [np.concatenate([w, batch.column(n).to_numpy()]) for w, n in zip(wait, names, strict=True)]
        last = int(np.searchsorted(wait[0], wait[0][-1]))
        if last:
            yield found([c[:last] for c in wait])
            wait = [c[last:] for c in wait]
    if len(wait[0]):
        yield found(wait)


def near(words: DataFrame) -> DataFrame:
    """``id, n_near, best`` of the words of ``id, word, n`` that have near words; ``best`` is the most frequent, as ``-n, word``."""
    schema = "key long, id long, place int"
    keys = mapped(words.select("id", "word"), _keys, schema)
    dealt = keys.repartition(F.shiftrightunsigned("key", 44)).sortWithinPartitions("key")
    shared = mapped(dealt, _shared, schema).select("id", "place").join(words, "id")
    whole = F.col("place") < 0
    before = F.expr("substring(word, 1, place)")
    rest = F.when(whole, F.col("word")).otherwise(F.concat(before, F.expr("substring(word, place + 2)")))
    first = ~whole & ((F.col("place") == 0) | (F.expr("substring(word, place, 1)") != F.expr("substring(word, place + 1, 1)")))
    rows = shared.select("id", "place", "n", "word", rest.alias("rest"), whole.alias("whole"), first.alias("first"))
    me = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))
    same_place = Window.partitionBy("rest", "place")
    ordered = same_place.orderBy(F.col("n").desc(), "word")
    of_rest = Window.partitionBy("rest")
    rows = rows.withColumns({"me": me}).withColumns({"size": F.count("*").over(same_place), "top": F.first("me").over(ordered), "next": F.lead("me").over(ordered), "rank": F.row_number().over(ordered)})
    rows = rows.withColumns({"own": F.max(F.when(F.col("whole"), F.col("me"))).over(of_rest), "longer": F.sum(F.col("first").cast("long")).over(of_rest), "best_longer": F.min(F.when(F.col("first"), F.col("me"))).over(of_rest)})
    inserted = F.col("first") & F.col("own").isNotNull()
    count = F.when(F.col("whole"), F.col("longer")).otherwise(F.col("size") - 1 + inserted.cast("long"))
    replaced = F.when(F.col("rank") == 1, F.col("next")).otherwise(F.col("top"))
    best = F.when(F.col("whole"), F.col("best_longer")).otherwise(F.least(replaced, F.when(inserted, F.col("own"))))
    return rows.select("id", count.alias("count"), best.alias("best")).where("count > 0").groupBy("id").agg(F.sum("count").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: the end of each chain, by doubling."""
    reached = forms.select("word", F.col("form").alias("root"))
    while True:
        up = reached.select(F.col("word").alias("root"), F.col("root").alias("up"))
        reached = written(reached.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
        if reached.where("moved").isEmpty():
            return reached.select("word", "root")


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of distinct words with their counts (``word, n``).

    A word's form is its most frequent near word (ties: the first in code-point
    order) if it is at least ``factor`` times as frequent; its root is the end
    of the chain of forms, or itself.
    """
    words = written(words.select(F.monotonically_increasing_id().alias("id"), "word", F.col("n").cast("long").alias("n")), "words")
    takes = -F.col("best.less") >= F.col("n") * factor
    found = words.join(near(words), "id", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.word")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n"))
    found = written(found, "forms")
    roots = _roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def misspelt(doc: Column, run: Column) -> Column:
    """The run, or in one of 199 cases (by a checksum of the document's id and the run) without one code point."""
    h = F.crc32(F.concat(doc.cast("string"), F.lit(":"), run).cast("binary"))
    place = (h % F.char_length(run)).cast("int")
    return F.when(h % 199 == 0, F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.char_length(run)))).otherwise(run)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of all documents, with the forms that they are variants of."""
    each = runs(table(spark, sf_dir, "documents")).where(F.char_length("run") >= MIN_CHARS)
    return variants(frequent(each.select(misspelt(F.col("doc"), F.col("run")).alias("word")))).select("word", "form", "root", "n", "n_near", "form_n")


SQL = r"""
WITH RECURSIVE steps AS (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256)) AS i)
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM steps
), runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY doc_id, run
), summed AS (
  SELECT doc_id, run, n,
         xor(list_reduce(flatten(list_transform(string_split(doc_id || ':' || run, ''),
                                                lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [195, ord(x) - 64] END)),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM runs, crc
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM summed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cut AS (
  SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS p FROM words)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT c.word, c.n, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, w.n, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word
), best AS (
  SELECT word, any_value(n) AS n, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word
), forms AS (
  SELECT word, other AS form, m AS form_n FROM best WHERE m >= 5 * n
), chain AS (
  SELECT word, form AS root, 1 AS k FROM forms
  UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN forms f ON f.word = c.root
), roots AS (
  SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word
)
SELECT w.word, f.form, coalesce(r.root, w.word) AS root, w.n, coalesce(b.n_near, 0) AS n_near, f.form_n
FROM words w LEFT JOIN best b ON b.word = w.word LEFT JOIN forms f ON f.word = w.word LEFT JOIN roots r ON r.word = w.word
"""
