"""Helpers shared by the corpus operators: tables, scratch space, text hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from knotlog.sources import scratch

__all__ = ["LOWER", "Words", "fresh", "mapped", "mix", "resident", "runs_of", "slices", "table", "utf8", "written"]

#: Bytes of text that one vectorised step works on.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by folder and name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table of the shared folder; small ones as few files."""
    return scratch.written(df, label, few=True)


def fresh(df: DataFrame, prefix: str) -> str:
    """``prefix`` with as many underscores before it as keep it from starting a column's name."""
    while any(c.startswith(prefix) for c in df.columns):
        prefix = f"_{prefix}"
    return prefix


_RESIDENT: dict[tuple, object] = {}


def resident(key: tuple | None = None, make: Callable[[], object] | None = None) -> object:
    """What a Python worker keeps between tasks: one model or vocabulary, the last that was asked for.

    Workers are used again by later stages; with no key, what an earlier one
    left is dropped.
    """
    if key not in _RESIDENT:
        _RESIDENT.clear()
        if make is not None:
            _RESIDENT[key] = make()
    return _RESIDENT.get(key)


def give_back() -> None:
    """Returns memory that Arrow and the C library hold free to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """``df.mapInArrow``, each task of which gives back what it has freed.

    Its Python worker waits for other tasks, through stages without any, beside
    a JVM that needs the memory.
    """

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


# --- text in Arrow batches -------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch with about ``most`` text bytes (whole rows)."""
    n = batch.num_rows
    if not n:
        return
    lens = np.diff(utf8(batch.column(column))[1])
    ends = np.cumsum(lens)
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


# --- hashes of words and word runs -----------------------------------------

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.default_rng(20240229)
_BYTE = [_RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASE = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_POW: list[tuple[np.ndarray, np.ndarray]] = []


#: Bytes whose words are hashed at once, about, and powers that a process keeps at most.
PIECE, KEPT_POWERS = 1 << 19, 1 << 20


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n + 1``."""
    while len(_POW) < 2:
        _POW.append((np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
    if len(_POW[which][0]) > n:
        return _POW[which]
    out = []
    for base in (_BASE[which], pow(_BASE[which], -1, 1 << 64)):
        steps = np.full(max(n + 1, KEPT_POWERS), base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    if n < KEPT_POWERS:
        _POW[which] = (out[0], out[1])
    return out[0], out[1]


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """Hash of each word, whatever stands around it; piece by piece, so that a long text needs no long tables."""
    out, a = np.empty(len(start), np.uint64), 0
    while a < len(start):
        base = start[a]
        b = max(a + 1, int(np.searchsorted(start, base + PIECE)))
        part = data[base : end[b - 1]]
        power, inverse = _powers(len(part), which)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[which][part] * power[: len(part)], out=sums[1:])
        s, e = start[a:b] - base, end[a:b] - base
        out[a:b] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
        a = b
    return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Words:
    """The words of consecutive texts: byte spans, owning row and 64-bit hash.

    A word is a run of bytes other than space and 0x09-0x0D, which is the same
    as a run of such code points, or of the bytes that ``solid`` marks.  Words
    never cross rows.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False, which: int = 0, solid: np.ndarray | None = None):
        n, rows = len(data), len(offs) - 1
        self.rows = rows
        if lower:
            data = LOWER[data]
        self.data = data
        solid = (~_WS if solid is None else solid)[data]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        before = np.zeros(n, bool)
        after = np.zeros(n, bool)
        if n:
            before[1:] = solid[:-1]
            after[:-1] = solid[1:]
            before[edge[:-1]] = False
            after[edge[1:]] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        first = np.searchsorted(self.start, offs)
        self.count = np.diff(first)
        self.first = first
        self.row = np.repeat(np.arange(rows), self.count)
        self.hash = _hashes(data, self.start, self.end, which)

    def __len__(self) -> int:
        return len(self.start)


_A = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def runs_of(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive values of ``h`` (row borders not regarded)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    have, width = h, 1  # doubling, then what is missing
    parts = {1: h}
    while width * 2 <= k:
        have = mix(have[: len(have) - width] * _A[0] + have[width:] + np.uint64(width))
        width *= 2
        parts[width] = have
    out, done = parts[width], width
    while done < k:
        step = max(w for w in parts if w <= k - done)
        m = len(h) - done - step + 1
        out = mix(out[:m] * _A[1] + parts[step][done : done + m] + np.uint64(step))
        done += step
    return out
