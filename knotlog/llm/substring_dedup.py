"""Substring dedup by fixed-block anchors (operator 6).

The index holds every non-overlapping block of ``BLOCK`` words of every
document; the probes are every rolling window of ``BLOCK`` words.  A block that
also occurs elsewhere is an anchor.  Two equal windows of ``2 * BLOCK`` words
each contain a whole block of their own document that the other one's rolling
windows meet, so a repeat of that length always holds an anchor on both sides.
Anchors are extended to both sides: every ``2 * BLOCK`` window that holds one is
compared with all such windows, and each but the first in order of (id, start)
is a repeat.  Runs of repeated windows are the maximal exact repeats that start
earlier; their words go.

Scale: what is shuffled are packs of hashes, not rows.  A task collapses its
windows before it sends them: a hash goes to its bucket once a pack, with the
pack's first place of it, and places that the pack itself shows to be repeats
go straight to their documents.  So a passage that a third of all documents
share reaches a bucket once a pack, about once in ``PACK_WORDS`` words, and so
do its anchors.  Hashes are dealt by value; buckets grow in number with the
words, not in size, and there are never more windows than words.  Texts move
twice, with their anchors and with their repeats.

Hashes: an anchor is found by ``32 + log2(buckets)`` bits, and a wrong one only
costs time; windows are compared by 64 bits of one hash and 32 of another, and
these 96 bits are taken as exact.

Defined cases: a null text has no words; a text shorter than a window loses
nothing; rows that share an id are ordered by their text's hash, and repeated
rows (same id and text) count as one document and are treated alike; rows with
a null id are left alone and count nowhere; an empty table gives an empty
result; other columns are not looked at and not kept, whatever their names.  A
very long text is one row of one pack, hashed in one task with about 100 bytes
a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotlog.llm._common import Words, mix, resident, runs_of, slices, table, utf8, written

BLOCK = 10
#: Words of one bucket, about.
BUCKET_WORDS = 2_500_000
#: Words that a task packs at once.
PACK_WORDS = 1_500_000
#: Bits of a hash that are kept inside a bucket.
REST_BITS = 32


def pack(sorted_values: np.ndarray) -> bytes:
    """Sorted numbers as differences of as many bytes as the largest needs, after that width."""
    if not len(sorted_values):
        return b""
    d = np.diff(np.concatenate([np.zeros(1, np.uint64), sorted_values.astype(np.uint64)]))
    width = max(1, (int(d.max()).bit_length() + 7) // 8)
    return bytes([width]) + d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes) -> np.ndarray:
    """What ``pack`` was given."""
    if not data:
        return np.zeros(0, np.uint64)
    d = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    wide = np.zeros((len(d), 8), np.uint8)
    wide[:, : data[0]] = d
    return np.cumsum(wide.view("<u8")[:, 0].astype(np.uint64), dtype=np.uint64)


def _deal(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket (any number of them) and remaining bits of each hash."""
    high = h >> np.uint64(32)
    return ((high * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64), mix(h) >> np.uint64(64 - REST_BITS)


#: Columns of rows to a bucket, of rows that pass through it to a document's place, and of what it sends.
_ASKS = "bucket long, h binary, g binary, docs binary, local binary, items binary, "
_SENT_ON = "place long, ids binary, marks binary, count binary, sent binary"
_SENT = "place long, ids binary, marks binary, count binary, items binary"


def _ask(bucket: int, h: bytes, g: bytes, ids: np.ndarray, marks: np.ndarray, doc: np.ndarray, items: np.ndarray) -> pa.RecordBatch:
    """A pack's hashes for one bucket, with places (document and item) that it asks for."""
    docs, local = np.unique(doc, return_inverse=True)
    row = (h, g, ids[docs].tobytes() + marks[docs].tobytes(), local.astype(np.uint16 if len(docs) < 65536 else np.uint32).tobytes(), items.astype(np.uint32).tobytes())
    sent = [pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.binary())] * 4]
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), *[pa.array([x], pa.binary()) for x in row], *sent], _NAMES)


def _asked(p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, marks and items of the places that a row asks for."""
    n = len(p["docs"]) // 16
    both = np.frombuffer(p["docs"], np.int64)
    local = np.frombuffer(p["local"], np.uint16 if n < 65536 else np.uint32).astype(np.int64)
    return both[:n][local], both[n:][local], np.frombuffer(p["items"], np.uint32).astype(np.int64)


_NAMES = ["bucket", "h", "g", "docs", "local", "items", "place", "ids", "marks", "count", "sent"]


def _pass(ids: np.ndarray, marks: np.ndarray, values: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Certain places of a pack, on their way to their documents."""
    for batch in _send(ids, marks, values, buckets):
        yield pa.RecordBatch.from_arrays([batch.column("place"), *[pa.nulls(1, pa.binary())] * 5, *batch.columns], _NAMES)


def _passed(packs: list[dict]) -> Iterator[pa.RecordBatch]:
    for p in packs:
        if p["place"] is not None:
            yield pa.RecordBatch.from_arrays([pa.array([p["place"]], pa.int64()), *[pa.array([p[c]], pa.binary()) for c in ("ids", "marks", "count", "sent")]], ["place", "ids", "marks", "count", "items"])


def _probes(buckets: int, block: int):
    """Packs of rolling windows and blocks of each task, by bucket."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([x[0] for x in held])
        blocks = np.concatenate([x[1] for x in held])
        number = np.concatenate([x[2] for x in held])
        ids = np.array([x[3] for x in held], np.int64)
        marks = np.array([x[4] for x in held], np.int64)
        bucket, rest = _deal(h, buckets)
        order = np.lexsort((rest, bucket))
        bucket, rest = bucket[order], rest[order]
        new = np.r_[True, (bucket[1:] != bucket[:-1]) | (rest[1:] != rest[:-1])]
        head = np.flatnonzero(new)
        alone = np.diff(np.r_[head, len(h)]) == 1
        bucket, rest = bucket[head], rest[head]
        b_bucket, b_rest = _deal(blocks, buckets)
        b_doc = np.repeat(np.arange(len(held)), [len(x[1]) for x in held])
        edge = np.searchsorted(bucket, np.arange(buckets + 1))
        at = np.empty(len(blocks), np.int64)  # each block is a window too: its place among the pack's hashes
        b_order = np.lexsort((b_rest, b_bucket))
        b_edge = np.searchsorted(b_bucket[b_order], np.arange(buckets + 1))
        for k in range(buckets):
            own = b_order[b_edge[k] : b_edge[k + 1]]
            at[own] = edge[k] + np.searchsorted(rest[edge[k] : edge[k + 1]], b_rest[own])
        sure = ~alone[at]
        if sure.any():
            yield from _pass(ids[b_doc[sure]], marks[b_doc[sure]], number[sure], buckets)
        for k in range(buckets):
            if edge[k] == edge[k + 1]:
                continue
            own = b_order[b_edge[k] : b_edge[k + 1]]
            own = own[~sure[own]]
            yield _ask(k, pack(rest[edge[k] : edge[k + 1]]), pack(b_rest[own]), ids, marks, b_doc[own], number[own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        held, words_held = [], 0
        for whole in batches:
            for batch in slices(whole, "text"):
                words = Words(*utf8(batch.column("text")))
                h = runs_of(words.hash, block)
                ids, marks = batch.column("id").to_pylist(), batch.column("mark").to_pylist()
                for i in range(batch.num_rows):
                    a, n = int(words.first[i]), int(words.count[i])
                    if n >= block:
                        own = h[a : a + n - block + 1]
                        at = np.arange(0, n - block + 1, block) if n >= 2 * block else np.zeros(0, np.int64)
                        held.append((own.copy(), own[at], at // block, ids[i], marks[i]))
                        words_held += n
                if words_held >= PACK_WORDS:
                    yield from flush(held)
                    held, words_held = [], 0
        if held:
            yield from flush(held)

    return run


def _send(ids: np.ndarray, marks: np.ndarray, values: np.ndarray, to: int) -> Iterator[pa.RecordBatch]:
    """Values of documents as packs, one for each of ``to`` places that some go to."""
    place = ((mix(ids.astype(np.uint64) ^ mix(marks.astype(np.uint64))) >> np.uint64(32)) * np.uint64(to) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((values, marks, ids, place))
    ids, marks, values, place = ids[order], marks[order], values[order], place[order]
    edge = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True]) if len(place) else np.zeros(1, np.int64)
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        d, m = ids[a:b], marks[a:b]
        head = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (m[1:] != m[:-1])])
        count = np.diff(np.r_[head, b - a]).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([place[a]], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in (d[head], m[head], count, values[a:b].astype(np.int32))]], ["place", "ids", "marks", "count", "items"])




def _received(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs of one place as one row for each document."""
    packs = [r for b in rows for r in b.to_pylist()]
    count = np.concatenate([np.frombuffer(p["count"], np.uint32) for p in packs])
    ids, marks = (np.repeat(np.concatenate([np.frombuffer(p[c], np.int64) for p in packs]), count) for c in ("ids", "marks"))
    items = np.concatenate([np.frombuffer(p["items"], np.int32) for p in packs])
    order = np.lexsort((items, marks, ids))
    ids, marks, items = ids[order], marks[order], items[order]
    head = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])])
    for x in range(0, len(head), 20_000):
        own = head[x : x + 20_000]
        end = head[x + 20_000] if x + 20_000 < len(head) else len(ids)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[own, end].astype(np.int32) - np.int32(own[0])), pa.array(items[own[0] : end]))
        yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(marks[own]), lists], ["id", "mark", "items"])


def _anchors(to: int):
    """Blocks of one bucket that occur in another pack too, packed by document."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = [r for b in rows for r in b.to_pylist()]
        yield from _passed(packs)
        packs = [p for p in packs if p["place"] is None]
        if not packs:
            return
        seen = np.sort(np.concatenate([unpack(p["h"]) for p in packs]))
        many = np.unique(seen[1:][seen[1:] == seen[:-1]])
        del seen
        out = []
        for p in packs:
            blocks = unpack(p["g"])
            if not len(blocks) or not len(many):
                continue
            hit = np.flatnonzero(many[np.minimum(np.searchsorted(many, blocks), len(many) - 1)] == blocks)
            if len(hit):
                out.append([x[hit] for x in _asked(p)])
        if out:
            yield from _send(*(np.concatenate(x) for x in zip(*out, strict=True)), to)

    return run


def _repeat(h: np.ndarray, g: np.ndarray, doc: np.ndarray, mark: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each window, and the later ones.

    A repeated row stands at the same place as its first copy and is no later one.
    """
    order = np.lexsort((start, mark, doc, g, h))
    same = (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])
    lead = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(order)), 0))
    later, of = order[1:][same], order[lead[1:][same]]
    return order[np.r_[True, ~same]], later[(doc[of] != doc[later]) | (mark[of] != mark[later]) | (start[of] != start[later])]


def _windows(buckets: int, block: int):
    """Packs of the windows that hold an anchor, of each task, by bucket."""
    size = 2 * block

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, g, start = (np.concatenate([x[i] for x in held]) for i in range(3))
        doc = np.repeat(np.arange(len(held)), [len(x[0]) for x in held])
        ids, marks = np.array([x[3] for x in held], np.int64), np.array([x[4] for x in held], np.int64)
        first, later = _repeat(h, g, ids[doc], marks[doc], start)
        if len(later):
            yield from _pass(ids[doc[later]], marks[doc[later]], start[later], buckets)
        bucket = (((h[first] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first, edge = first[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
        for k in range(buckets):
            own = first[edge[k] : edge[k + 1]]
            if len(own):
                yield _ask(k, h[own].tobytes(), g[own].tobytes(), ids, marks, doc[own], start[own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for whole in batches:
            for batch in slices(whole, "text"):
                data, offs = utf8(batch.column("text"))
                words, other = Words(data, offs), Words(data, offs, which=1)
                h, g = runs_of(words.hash, size), runs_of(other.hash, size)
                numbers = batch.column("number").to_pylist()
                ids, marks = batch.column("id").to_pylist(), batch.column("mark").to_pylist()
                for i in range(batch.num_rows):
                    a, n = int(words.first[i]), int(words.count[i])
                    if n < size or not numbers[i]:
                        continue
                    at = np.asarray(numbers[i], np.int64)[:, None] * block + np.arange(-block, 1)[None, :]
                    at = np.unique(at[(at >= 0) & (at <= n - size)])
                    held.append((h[a + at], (g[a + at] >> np.uint64(32)).astype(np.uint32), at, ids[i], marks[i]))
                    n_held += len(at)
                if n_held >= PACK_WORDS // 2:
                    yield from flush(held)
                    held, n_held = [], 0
        if held:
            yield from flush(held)

    return run


def _repeats(to: int):
    """Windows of one bucket that another pack has earlier, packed by document."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = [r for b in rows for r in b.to_pylist()]
        yield from _passed(packs)
        packs = [p for p in packs if p["place"] is None]
        if not packs:
            return
        h = np.concatenate([np.frombuffer(p["h"], np.uint64) for p in packs])
        g = np.concatenate([np.frombuffer(p["g"], np.uint32) for p in packs])
        doc, mark, start = (np.concatenate(x) for x in zip(*map(_asked, packs), strict=True))
        del packs
        _, later = _repeat(h, g, doc, mark, start)
        if len(later):
            yield from _send(doc[later], mark[later], start[later], to)

    return run


def _cut(size: int, text_out: str):
    """Texts without the words that repeated windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data, offs = utf8(batch.column("text"))
                words = Words(data, offs)
                gone = np.zeros(len(words) + 1, np.int64)
                for i, starts in enumerate(batch.column("start").to_pylist()):
                    if starts:
                        at = np.unique(np.asarray(starts, np.int64)) + words.first[i]
                        gone[at] += 1
                        gone[at + size] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                removed = np.concatenate([[0], np.cumsum(gone)])
                n_removed = removed[words.first[1:]] - removed[words.first[:-1]]
                raw = data.tobytes()
                stay = ~gone
                texts = []
                for i in range(batch.num_rows):
                    a, b = words.first[i], words.first[i + 1]
                    p = stay[a:b]
                    texts.append(b" ".join([raw[x:y] for x, y in zip(words.start[a:b][p].tolist(), words.end[a:b][p].tolist(), strict=True)]))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words.count, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", text_out])

    return run


def _of(function, schema: str):
    """A function of a group's batches for ``applyInArrow``."""
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    form = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])

    def run(t: pa.Table) -> pa.Table:
        got = [b.cast(form) for b in function(iter(t.to_batches()))]
        return pa.Table.from_batches(got, form)

    return run


def substring_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``id, n_words, n_removed, kept``: texts without repeats of ``2 * block`` words."""
    own = docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(F.lit(9), F.col(text)).alias("mark"), F.col(text).alias("text"))
    known = own.where(F.col("id").isNotNull())
    letters = known.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, -(-letters // (6 * BUCKET_WORDS)))

    def gathered(packs: DataFrame, function, items: str, label: str) -> DataFrame:
        sent = packs.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_of(function(buckets), _SENT), _SENT)  # a bucket is a task
        form = "id long, mark long, items array<int>"
        per_doc = sent.repartition(buckets, "place").groupBy("place").applyInArrow(_of(_received, form), form)
        return written(per_doc.withColumnRenamed("items", items), label)

    anchors = gathered(known.mapInArrow(_probes(buckets, block), _ASKS + _SENT_ON), _anchors, "number", "substring-anchors")
    starts = gathered(known.join(anchors, ["id", "mark"]).mapInArrow(_windows(buckets, block), _ASKS + _SENT_ON), _repeats, "start", "substring-repeats")
    out = own.join(starts, ["id", "mark"], "left").select("id", "text", "start").mapInArrow(_cut(2 * block, "kept"), "id long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document, how many go, and a digest of what stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = substring_dedup(docs)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 18, 1))) AS st FROM w
), k AS (
  SELECT doc_id, st, row_number() OVER (PARTITION BY array_to_string(ws[st:st + 19], ' ') ORDER BY doc_id, st) AS n FROM s
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(st, st + 20)) AS pos FROM k WHERE n > 1
), words AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w
), kept AS (
  SELECT doc_id, count(g.pos) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY words.pos) FILTER (g.pos IS NULL), '') AS kept
  FROM words LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
