"""Token counts by rank-synchronous array merging (operator 10).

Pre-tokens not met before are held as one ragged numpy array of symbols.  In
each round every sequence finds its adjacent pair of lowest rank, all places of
that pair merge at once, and sequences without a mergeable pair leave
(``Vocabulary.merged``); the symbols that each pre-token still has are counted.
A long pre-token goes by the same rule, but keeps the places of each rank, so
that a round looks only at the places that merge and their neighbours.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); a special
string inside a text is one token, the library's default; repeated rows are
counted alike, rows with a null id like any others; an empty table gives an
empty result; other columns pass through but for the text, and one named as an
output column is replaced.  No shuffle; memory is bounded by the remembered
pre-tokens (a number of short ones) and one slice of text, which a very long
text is by itself.  A run of a megabyte without a break takes seconds.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotlog.llm._bytebpe import Pretokens, Vocabulary, default_path
from knotlog.llm._common import mapped, resident, slices, table, utf8

#: Pre-tokens that one Python process remembers at most, and their length; bytes from which a pre-token is long.
REMEMBER, LONGEST, LOCAL_BYTES = 500_000, 64, 512
#: A training sequence of more tokens than this is marked.
LIMIT = 512


class Counter:
    """Counts the symbols that survive merging."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.split = Pretokens(self.vocabulary)
        self.seen: dict[str, int] = {}

    def merge(self, parts: list[bytes]) -> np.ndarray:
        """Surviving symbols of each byte string (none may be empty)."""
        lens = np.array([len(x) for x in parts])
        seq = np.repeat(np.arange(len(parts)), lens)
        _, owner = self.vocabulary.merged(self.vocabulary.byte[np.frombuffer(b"".join(parts), np.uint8)], seq, seq)
        return np.bincount(owner, minlength=len(parts))

    def merge_long(self, data: bytes) -> int:
        """Surviving symbols of one long byte string: rank by rank, with the places of each rank."""
        v = self.vocabulary
        merge = v.merge
        sym: list[int] = v.byte[np.frombuffer(data, np.uint8)].tolist()
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[int, list[int]] = defaultdict(list)
        for i in range(n - 1):
            if m := merge.get((sym[i], sym[i + 1])):
                places[m[0]].append(i)
        ranks = list(places)
        heapq.heapify(ranks)
        left = n
        while ranks:
            rank = heapq.heappop(ranks)
            for i in sorted(places.pop(rank)):  # from the left, so that of overlapping places every other one merges
                j = after[i]
                m = merge.get((sym[i], sym[j])) if j < n else None
                if m is None or m[0] != rank:
                    continue  # a neighbour merged meanwhile
                sym[i], sym[j] = m[1], -1
                left -= 1
                k = after[i] = after[j]
                h = before[i]
                if k < n:
                    before[k] = i
                for x, y in ((i, k), (h, i)):
                    if x >= 0 and y < n and (new := merge.get((sym[x], sym[y]))):
                        if new[0] not in places:
                            heapq.heappush(ranks, new[0])
                        places[new[0]].append(x)
        return left

    def _first(self, new: list[str]) -> None:
        """Counts pre-tokens not met before."""
        parts = [t.encode() for t in new]
        short = [(t, x) for t, x in zip(new, parts, strict=True) if len(x) < LOCAL_BYTES]
        if short:
            self.seen.update(zip([t for t, _ in short], self.merge([x for _, x in short]).tolist(), strict=True))
        self.seen.update((t, self.merge_long(x)) for t, x in zip(new, parts, strict=True) if len(x) >= LOCAL_BYTES)

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text."""
        docs, extra = [], []
        for text in texts:
            toks: list[str] = []
            special = 0
            for piece, is_special in self.vocabulary.pieces(text or ""):
                if is_special:
                    special += 1
                else:
                    toks += self.split(piece)
            docs.append(toks)
            extra.append(special)
        if len(self.seen) > REMEMBER:
            self.seen.clear()
        seen = self.seen
        new = list({t for toks in docs for t in toks if t not in seen})
        if new:
            self._first(new)
        get = seen.__getitem__
        out = [sum(map(get, toks)) + x for toks, x in zip(docs, extra, strict=True)]
        for t in new:
            if len(t) > LONGEST:
                del seen[t]
        return out


def counter(path: str) -> Counter:
    """The counter of ``path``, kept in a Python worker."""
    return resident(("counter", path), lambda: Counter(path))


def token_counts(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` without its text, with ``n_bytes`` (UTF-8) and ``n_tokens``."""
    path = path or default_path()
    kept = [f for f in docs.schema.fields if f.name not in (text, "n_bytes", "n_tokens")]
    out = T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for whole in batches:
            for batch in slices(whole, text):
                size = np.diff(utf8(batch.column(text))[1])
                n = count.counts(batch.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(size, pa.int64()), pa.array(n, pa.int64())], [*names, "n_bytes", "n_tokens"])

    return mapped(docs, run, out)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they exceed one sequence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs).withColumn("over_limit", F.col("n_tokens") > LIMIT)
