"""BPE encoding and decoding by forced-boundary splitting (operator 7).

Byte pairs that occur inside no token of the vocabulary can never be merged
across, so such a pair is a certain cut.  Each pre-token is cut there, every
fragment is encoded by itself, and the ids are concatenated.  The fragments of
all pre-tokens not met before are encoded together, as ragged arrays; a long
fragment by a heap of its own.  Encoding needs no shuffle; pre-tokens already
met are looked up.

Defined cases: a null text counts as empty and gives no ids; ids are stored as
little-endian unsigned 32-bit integers; repeated rows are encoded alike, rows
with a null id like any others; an empty table gives an empty result; other
columns pass through, and one named as an output column is replaced.  A very
long text is encoded in one slice of its own, about 100 bytes a byte, less what
its pre-tokens repeat.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotlog.llm._bytebpe import Pretokens, Vocabulary, default_path
from knotlog.llm._common import mapped, resident, slices, table

#: Pre-tokens that one Python process remembers at most (about 200 bytes each), and their length.
REMEMBER, LONGEST = 120_000, 64
#: Bytes from which a fragment is merged by a heap.
HEAP_BYTES = 512


class Encoder:
    """Encodes and decodes single texts with one vocabulary."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.split = Pretokens(self.vocabulary)
        self.seen: dict[str, bytes] = {}

    def fragment(self, data: bytes) -> bytes:
        """Ids of a fragment: merge the pair of lowest rank, leftmost first."""
        v = self.vocabulary
        ids: list[int] = v.byte[np.frombuffer(data, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merge = v.merge
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merge.get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            h = before[i]
            if h >= 0 and (m := merge.get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, ids[h], new, m[1]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Places before which a byte string is certainly cut."""
        return np.flatnonzero(~self.vocabulary.inside[data[:-1], data[1:]]) + 1

    def pretokens(self, texts: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens: their fragments between forced cuts, joined."""
        out, short, parts = {}, [], []
        for t in texts:
            data = t.encode()
            if len(data) < HEAP_BYTES:
                short.append(t)
                parts.append(data)
            else:
                edges = [0, *self.cuts(np.frombuffer(data, np.uint8)).tolist(), len(data)]
                out[t] = b"".join([self.fragment(data[x:y]) for x, y in zip(edges[:-1], edges[1:], strict=True)])
        if short:
            data = np.frombuffer(b"".join(parts), np.uint8)
            lens = np.array([len(x) for x in parts])
            edge = np.zeros(len(data), bool)
            edge[self.cuts(data)] = True
            edge[np.cumsum(lens) - lens] = True
            sym, owner = self.vocabulary.merged(self.vocabulary.byte[data], np.cumsum(edge), np.repeat(np.arange(len(parts)), lens))
            raw, at = sym.astype("<u4").tobytes(), (np.cumsum(np.bincount(owner, minlength=len(parts))) * 4).tolist()
            out.update(zip(short, [raw[x:y] for x, y in zip([0, *at[:-1]], at, strict=True)], strict=True))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        v, seen = self.vocabulary, self.seen
        docs: list[list] = []
        for text in texts:
            toks: list = []
            for piece, special in v.pieces(text or ""):
                if special:
                    toks.append(v.special[piece])
                elif piece:
                    toks += self.split(piece)
            docs.append(toks)
        new = list({t for toks in docs for t in toks if t not in seen and t.__class__ is str})
        if new:
            if len(seen) + len(new) > REMEMBER:
                seen.clear()
                new = list({t for toks in docs for t in toks if t.__class__ is str})
            seen.update(self.pretokens(new))
        special = {i: np.array([i], "<u4").tobytes() for i in v.special.values()}
        out = [b"".join([seen[t] if t.__class__ is str else special[t] for t in toks]) for toks in docs]
        for t in new:
            if len(t) > LONGEST:
                del seen[t]
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.vocabulary.token.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encoder(path: str) -> Encoder:
    """The encoder of ``path``, kept in a Python worker."""
    return resident(("encoder", path), lambda: Encoder(path))


def _with(batch: pa.RecordBatch, schema: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in schema], schema)


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", count: str = "n_tokens", path: str | None = None) -> DataFrame:
    """``docs`` with the token ids of a text column (binary) and their number."""
    path = path or default_path()
    kept = [f for f in docs.schema.fields if f.name not in (ids, count)]
    out = T.StructType([*kept, T.StructField(ids, T.BinaryType()), T.StructField(count, T.LongType())])
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for batch in slices(whole, text):
                found = enc.encode(batch.column(text).to_pylist())
                yield _with(batch, names, {ids: pa.array(found, pa.binary()), count: pa.array([len(x) // 4 for x in found], pa.int64())})

    return mapped(docs, run, out)


def decode(docs: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """``docs`` with the text that a column of token ids stands for."""
    path = path or default_path()
    out = T.StructType([*[f for f in docs.schema.fields if f.name != text], T.StructField(text, T.StringType())])
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [enc.decode(x) if x else "" for x in batch.column(ids).to_pylist()]
                yield _with(batch, names, {text: pa.array(found, pa.string())})

    return mapped(docs, run, out)


def recode(docs: DataFrame, text: str = "text", ids: str = "ids", count: str = "n_tokens", decoded: str = "decoded", path: str | None = None) -> DataFrame:
    """``encode`` and then ``decode`` in one pass, so that a task needs one Python worker."""
    path = path or default_path()
    new = {ids: T.BinaryType(), count: T.LongType(), decoded: T.StringType()}
    out = T.StructType([*[f for f in docs.schema.fields if f.name not in new], *[T.StructField(n, k) for n, k in new.items()]])
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for whole in batches:
            for batch in slices(whole, text):
                found = enc.encode(batch.column(text).to_pylist())
                made = (pa.array(found, pa.binary()), pa.array([len(x) // 4 for x in found], pa.int64()), pa.array([enc.decode(x) for x in found], pa.string()))
                yield _with(batch, names, dict(zip(new, made, strict=True)))

    return mapped(docs, run, out)


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    coded = recode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
