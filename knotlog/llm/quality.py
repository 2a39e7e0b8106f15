"""Quality rules (operator 3): text statistics and a calibrated n-gram classifier.

The classifier is a logistic regression over hashed word 1- and 2-grams and
hashed 4-grams of code points of a text, each group as shares of its own total.  It is fitted on labelled rows, and its score is turned into a
probability by a logistic curve fitted on labelled rows that the regression
did not see.  Texts are scored in Arrow batches against a fixed threshold.

Scale: learning takes a bounded sample of labelled rows (``MAX_LABELLED``), so
what is broadcast and what reaches the driver does not grow.  The weights (two
fixed tables of ``2**BITS`` numbers) are broadcast; rows are scored where they
lie, without a shuffle, in slices of bounded size.

Defined cases: a null text has no words and fails the base rules; with no
labels, or labels of one value only, the base rules decide alone; several
labels of one row count as their least; repeated rows are scored alike; rows
with a null id are scored but never learned from; an empty table gives an empty
result; other columns pass through but for the text, and one named as an output
column is replaced.  A very long text is scored in one slice of its own, about
150 bytes a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotlog.llm._common import Words, mix, runs_of, slices, table, utf8

#: Labelled rows of each quality that are learned from, about.
MAX_LABELLED = 1_200
#: Hash buckets of the word table and of the character table: 2**BITS each.
BITS = 15
#: Kept if the calibrated probability of good quality is at least this.
KEEP_AT = 0.5
#: Base rules.
MIN_WORDS, MAX_REPEAT_PERCENT, RUN = 20, 30, 8
SYMBOLS = b"#*$%&|<>"

_SIZE = 1 << BITS
_SHIFT = np.uint64(64 - BITS)
_SYM = np.zeros(256, np.int64)
_SYM[list(SYMBOLS)] = 1
_GRAM = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _bounds(rows: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(rows, np.arange(n + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the stretches ``first[i]:first[i + 1]``; 0 for empty ones."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and where each begins."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    head = data[at].astype(np.int64)
    more = (head >= 0xC0).astype(np.int64) + (head >= 0xE0) + (head >= 0xF0)
    point = head & np.array([0x7F, 0x1F, 0x0F, 0x07])[more]
    for k in (1, 2, 3):
        some = np.flatnonzero(more >= k)
        point[some] = point[some] << 6 | data[at[some] + k] & 0x3F
    return point, at


def ngram_buckets(data: np.ndarray, offs: np.ndarray, words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each occurrence, bounds of each row's occurrences) by table."""
    n = len(offs) - 1
    two = runs_of(words.hash, 2)
    ok = words.row[1:] == words.row[:-1] if len(words) > 1 else np.zeros(0, bool)
    two, two_row = two[ok], words.row[1:][ok]
    rows = np.concatenate([words.row, two_row])
    order = np.argsort(rows, kind="stable")
    word = (np.concatenate([words.hash, two])[order] >> _SHIFT).astype(np.int64)
    out = [(word, _bounds(rows[order], n))]
    point, at = code_points(data)
    first = np.searchsorted(at, offs)
    row = np.repeat(np.arange(n), np.diff(first))
    if len(point) >= 4:
        c = mix(point.astype(np.uint64) + np.uint64(1))
        four = c[:-3] * _GRAM[0] + c[1:-2] * _GRAM[1] + c[2:-1] * _GRAM[2] + c[3:] * _GRAM[3]
        inside = row[:-3] == row[3:]
        out.append(((four[inside] >> _SHIFT).astype(np.int64), _bounds(row[:-3][inside], n)))
    else:
        out.append((np.zeros(0, np.int64), np.zeros(n + 1, np.int64)))
    return out


def scores(data: np.ndarray, offs: np.ndarray, words: Words, weights: np.ndarray, bias: float) -> np.ndarray:
    """Raw score of each row: mean weight of each table's n-grams, added up."""
    total = np.full(len(offs) - 1, bias)
    for (bucket, first), w in zip(ngram_buckets(data, offs, words), weights, strict=True):
        total += _sums(w[bucket], first) / np.maximum(np.diff(first), 1)
    return total


def repeated_run_words(words: Words, run: int = RUN) -> np.ndarray:
    """Words of each row that lie in a ``run``-word window found twice in it."""
    h = runs_of(words.hash, run)
    out = np.zeros(words.rows, np.int64)
    if not len(h):
        return out
    at = np.flatnonzero(words.row[run - 1 :] == words.row[: len(words) - run + 1])
    if not len(at):
        return out
    h, row = h[at], words.row[at]
    order = np.lexsort((h, row))
    h, row, at = h[order], row[order], at[order]
    same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    twice = np.r_[False, same] | np.r_[same, False]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + run, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return _sums(covered.astype(np.int64), words.first)


def duplicate_lines(texts: list[str | None]) -> list[int]:
    """Lines with a word that equal an earlier line of their text."""
    out = []
    for t in texts:
        n = 0
        if t and "\n" in t:
            lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
            n = len(lines) - len(set(lines))
        out.append(n)
    return out


def statistics(batch: pa.RecordBatch, text: str, words: Words, data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Base statistics of each row."""
    lead = (data & 0xC0) != 0x80  # first byte of each code point
    ends = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=ends[1:])
    per_word = ends[words.end] - ends[words.start]
    n_repeat = repeated_run_words(words)
    return {
        "n_words": words.count,
        "word_chars": _sums(per_word, words.first),
        "n_symbols": _sums(_SYM[data], offs),
        "n_dup_lines": np.array(duplicate_lines(batch.column(text).to_pylist()), np.int64),
        "n_repeat_words": n_repeat,
    }


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", quality: str = "quality") -> tuple[np.ndarray, float] | None:
    """Weights of both tables and the bias, calibrated; None with too few labels."""
    known = labels.where(F.col(id).isNotNull() & F.col(quality).isin(0, 1)).groupBy(F.col(id).alias("_id")).agg(F.min(quality).cast("int").alias("_y"))
    sizes = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return None
    point = F.pmod(F.xxhash64(F.lit(13), "_id"), F.lit(1_000_000)) / 1e6
    share = F.when(F.col("_y") == 0, F.lit(MAX_LABELLED / sizes[0])).otherwise(F.lit(MAX_LABELLED / sizes[1]))
    sample = known.where(point < share)  # about 2 * MAX_LABELLED rows: bounded, so broadcast
    rows = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(sample), "_id")

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                data, offs = utf8(batch.column("_text"))
                groups = ngram_buckets(data, offs, Words(data, offs))
                keys, values = [], []
                for i in range(batch.num_rows):
                    k, v = [], []
                    for g, (bucket, first) in enumerate(groups):
                        own, n = np.unique(bucket[first[i] : first[i + 1]], return_counts=True)
                        k.append(own + g * _SIZE)
                        v.append(n / max(1, n.sum()))
                    keys.append(np.concatenate(k).astype("<i4").tobytes())
                    values.append(np.concatenate(v).astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("_id").cast(pa.int64()), batch.column("_y"), pa.array(keys, pa.binary()), pa.array(values, pa.binary())], ["_id", "_y", "k", "v"])

    got = rows.select("_id", "_y", "_text").mapInArrow(shares, "_id long, _y int, k binary, v binary").toArrow().sort_by("_id")
    y = np.array(got.column("_y").to_pylist(), float)
    if len(set(y.tolist())) < 2:
        return None
    keys = [np.frombuffer(x, "<i4").astype(np.int64) for x in got.column("k").to_pylist()]
    values = [np.frombuffer(x, "<f4").astype(float) for x in got.column("v").to_pylist()]
    held = np.arange(len(y)) % 4 == 3
    return _train(keys, values, y, held)


def _train(keys: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, held: np.ndarray, rounds: int = 120, l2: float = 1e-6) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch Adam, then a fitted logistic curve."""
    def rows(of: np.ndarray):
        pick = np.flatnonzero(of)
        k, v = np.concatenate([keys[i] for i in pick]), np.concatenate([values[i] for i in pick])
        return k, v, np.repeat(np.arange(len(pick)), [len(keys[i]) for i in pick]), y[pick]

    k, v, r, t = rows(~held)
    v = v * 100
    balance = np.where(t == 1, 0.5 / max(t.mean(), 1e-9), 0.5 / max(1 - t.mean(), 1e-9))
    w, b = np.zeros(2 * _SIZE), 0.0
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = np.bincount(r, w[k] * v, len(t)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - t) * balance / len(t)
        gw, gb = np.bincount(k, g[r] * v, len(w)) + l2 * w, g.sum()
        m, s = 0.9 * m + 0.1 * gw, 0.99 * s + 0.01 * gw * gw
        mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.03 * (m / c1) / (np.sqrt(s / c2) + 1e-8)
        b -= 0.03 * (mb / c1) / (np.sqrt(sb / c2) + 1e-8)
    w *= 100
    k, v, r, t = rows(held) if held.any() and len(set(y[held].tolist())) == 2 else rows(~held)
    z = np.bincount(r, w[k] * v, len(t)) + b
    a, c = 1.0, 0.0  # probability = logistic(a * z + c), by Newton's method with the classes as they are
    aim = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
        h = np.maximum(p * (1 - p), 1e-9)
        ga, gc = ((p - aim) * z).sum() + 1e-3 * (a - 1), (p - aim).sum()
        haa, hac, hcc = (h * z * z).sum() + 1e-3, (h * z).sum(), h.sum() + 1e-3
        d = haa * hcc - hac * hac
        a, c = a - np.clip((ga * hcc - gc * hac) / d, -1, 1), c - np.clip((gc * haa - ga * hac) / d, -1, 1)
    return (a * w).reshape(2, _SIZE), float(a * b + c)


def quality(docs: DataFrame, model: tuple[np.ndarray, float] | None, text: str = "text") -> DataFrame:
    """``docs`` without its text, with statistics, base rules, probability, verdict."""
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    new = [*longs, "base_failed", "p_good", "kept"]
    kept = [f for f in docs.schema.fields if f.name not in (text, *new)]
    out = T.StructType([*kept, *[T.StructField(c, T.LongType()) for c in longs], T.StructField("base_failed", T.BooleanType()), T.StructField("p_good", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    names = [f.name for f in kept]
    sent = docs.sparkSession.sparkContext.broadcast(None if model is None else (model[0].astype(np.float32), model[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                data, offs = utf8(batch.column(text))
                words = Words(data, offs)
                st = statistics(batch, text, words, data, offs)
                failed = (st["n_words"] < MIN_WORDS) | (100 * st["n_repeat_words"] > MAX_REPEAT_PERCENT * st["n_words"])
                p = np.ones(batch.num_rows)
                if sent.value is not None:
                    p = 1 / (1 + np.exp(-np.clip(scores(data, offs, words, *sent.value), -30, 30)))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *[pa.array(st[c], pa.int64()) for c in longs], pa.array(failed), pa.array(p), pa.array(~failed & (p >= KEEP_AT))], out.names)

    return docs.mapInArrow(run, out)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return quality(docs.select("doc_id", "text"), model)
