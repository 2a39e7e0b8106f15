"""MinHash near-dedup with an LSH forest (operator 5).

A document is the set of its word shingles.  Equal sets are one class with a
representative.  Representatives get a MinHash signature, which is sorted in
several orders (rotations): in each order, rows with a common prefix of at
least ``DEPTH`` values form a region, and the neighbours in sort order, which
are those with the longest common prefix, are candidates.  How deep a candidate
agrees thus adapts to how dense its region is.  Candidates whose whole
signatures agree often enough are confirmed on their full shingle sets.

Rounds keep the number of candidates linear in a group of near copies: the
first takes a few orders and links each row to its best neighbour; the second
takes all orders and links each row to its best neighbour of another component;
the third looks wider and takes the best two of other components in each order
and, for each dense stretch, its most central row.  Pairs once refused are not
tried again.

What ranks and widths leave out is found exactly.  After the rounds, a region
whose rows are all of one component is done.  Rows of the other regions, however
wide, are open: they go through a prefix-filtered join.  Shingles have one fixed
order, from the rarest of a sample to the commonest; two sets over the threshold
share one of the first ``n - ceil(n * percent / 100) + 1`` of each.  Of a list
of a shingle, only pairs of different components whose sizes and places in the
order allow the overlap are looked at: the rows of its largest component meet
the others, not each other.  A list with few such pairs a row gives them to the
full-set check.  Dense lists that share rows are one family, which is checked
where it lies on its full sets and gives the links that join components, fewer
than its rows.  A list or family too large for a task is cut in chunks; chunks of the largest component meet chunks of the
others, so a group of near copies that is already one component is sent once.

Scale: a signature is ``ORDERS * DEPTH`` two-byte values.  Rows that share no
prefix in any order drop out before signatures are copied.  Sort orders are
dealt by range with the id as last key, so a group with equal signatures is
split over tasks.  A broadcast only happens behind a count.  Components come
from star contraction; nothing but counts and the order of the commonest
shingles of a bounded sample reaches the driver.

Recall: a link is missed if the two signatures share no prefix in any order
(4 in 10 million at 85 %, 3 in 100,000 at 80 %) or if 64-bit hashes collide.
Whatever shares one is found: the rounds and their bounds (``NEAR``, ``WIDE``,
``SLACK``, borders of stretches) only decide how much is left to the join.

Defined cases: a null, empty or wordless text has no shingles and is linked
with nothing; fewer words than a shingle make one shingle of them all; rows
that share an id count as one document; rows with a null id are linked with
nothing and kept; equal texts are one class; an empty table gives an empty
result; a very long text is one row with many shingles, hashed in slices and
held by one task at a time; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotlog.llm._common import Words, mapped, mix, resident, runs_of, slices, table, utf8, written
from knotlog.llm.components import components

ORDERS, DEPTH = 20, 4
VALUES = ORDERS * DEPTH
#: Standard deviations by which a pair may agree less than its similarity says.
SLACK = 4.4
#: Neighbours looked at in the first two rounds and in the third.
NEAR, WIDE = 8, 32
#: Orders of the first round.
FIRST = 4
#: Rows of a sorted stretch that a task holds, about.
STRETCH_ROWS = 50_000
#: Open rows whose shingles are counted for their order, about, and the commonest that are known.
SAMPLE_DOCS, COMMON = 10_000, 50_000
#: Candidates a row from which a list is checked where it lies.
DENSE = 4
#: Rows and shingles of a chunk of a list, about.
CHUNK_ROWS, CHUNK_SHINGLES = 600, 1_000_000
#: Rows of a list up to which all its pairs are looked at by distance in it.
SHORT = 64
#: Rows of lists that a task holds, about.
LIST_ROWS = 200_000
#: Ids that are broadcast at most (8 bytes each).
BROADCAST_ROWS = 500_000

_RNG = np.random.default_rng(85)
_MUL = _RNG.integers(0, 2**31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 2**32, VALUES, dtype=np.uint32)


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (A-Z lower-cased)."""
    words = Words(data, offs, lower=True)
    whole = runs_of(words.hash, width)
    out = []
    for first, n in zip(words.first[:-1].tolist(), words.count.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(whole[first : first + n - width + 1]))
        elif n:
            out.append(mix(runs_of(words.hash[first : first + n], n) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> bytes:
    """MinHash values of a set as big-endian two-byte numbers."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(low, (_MUL[:, None] * x[None, i : i + 4096] + _ADD[:, None]).min(axis=1), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(">u2").tobytes()


def common_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles of a bounded sample of ``sets``, sorted, and their counts there."""
    total = sets.count()
    some = sets.sample(fraction=min(1.0, SAMPLE_DOCS / total), seed=85) if total else sets
    got = some.select(F.explode("shingles").alias("s")).groupBy("s").count().where("count > 2").orderBy(F.desc("count"), "s").limit(COMMON).toArrow()
    key, count = got.column("s").to_numpy().astype(np.uint64), got.column("count").to_numpy()
    order = np.argsort(key)
    return key[order], count[order]


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """The first shingles in the fixed order, one of which any similar set has in its own."""
    key, count = common
    often = np.zeros(len(shingles), np.int64)
    if len(key):
        at = np.minimum(np.searchsorted(key, shingles), len(key) - 1)
        often = np.where(key[at] == shingles, count[at], 0)
    return shingles[np.lexsort((shingles, often))[: len(shingles) + 1 + -len(shingles) * percent // 100]]


def signatures(docs: DataFrame, id: str, text: str, width: int) -> DataFrame:
    """``id, n, h1, h2, sig`` of every row; the hashes stand for the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resident()
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(*utf8(batch.column("text")), width)
                h1 = [int(s.sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                h2 = [int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
                sig = [signature(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary())], ["id", "n", "h1", "h2", "sig"])

    return mapped(docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")), run, "id long, n long, h1 long, h2 long, sig binary")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``id, prefix`` of ``id, shingles``."""
    common = common_shingles(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                first = [prefix(x.values.to_numpy().astype(np.uint64), common, percent).astype(np.int64) for x in batch.column("shingles")]
                offs = pa.array(np.cumsum([0, *map(len, first)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(offs, pa.array(np.concatenate([np.zeros(0, np.int64), *first])))], ["id", "prefix"])

    return mapped(sets, run, "id long, prefix array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = [s.astype(np.int64) for s in shingle_sets(*utf8(batch.column("text")), width)]
                offs = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.int64), *sets])
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], ["id", "shingles"])

    return mapped(docs, run, "id long, shingles array<long>")


def _read(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None


def _sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of sorted rows that have, or at a border may have, a neighbour with their key and order."""
    t = _read(batches)
    if t is None:
        return
    order, key, ids = (t.column(c).to_numpy() for c in ("t", "key", "id"))
    same = (order[1:] == order[:-1]) & (key[1:] == key[:-1])
    yield pa.RecordBatch.from_arrays([pa.array(np.unique(ids[np.r_[True, same] | np.r_[same, True]]))], ["id"])


def _candidates(mode: int, percent: int):
    """Pairs of sorted rows: 1 best neighbour before, 2 best of another component, 3 the best two, wider."""
    p = percent / 100
    least = int(VALUES * p - SLACK * (VALUES * p * (1 - p)) ** 0.5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _read(batches)
        if t is None:
            return
        n = t.num_rows
        sig = np.frombuffer(b"".join(t.column("order_sig").to_pylist()), ">u2").reshape(n, VALUES).astype(np.uint16)
        order, ids, comp, size = (t.column(c).to_numpy() for c in ("t", "id", "comp", "n"))
        start = np.r_[True, (order[1:] != order[:-1]) | (sig[1:, :DEPTH] != sig[:-1, :DEPTH]).any(axis=1)]
        region = np.cumsum(start) - 1
        a, b = [], []

        def agreeing(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            ok = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
            out = np.zeros(len(i), np.int64)
            for x in range(0, len(i), 65536):
                p = np.flatnonzero(ok[x : x + 65536]) + x
                out[p] = (sig[i[p]] == sig[j[p]]).sum(axis=1)
            return out

        top = 2 if mode == 3 else 1
        best, best_at = np.zeros((top, n), np.int64), np.full((top, n), -1)

        def offer(i: np.ndarray, j: np.ndarray, agree: np.ndarray) -> None:
            for k in range(top):  # a better one takes the place and hands the old one down
                up = agree > best[k, i]
                old, old_at = best[k, i], best_at[k, i]
                best[k, i], best_at[k, i] = np.where(up, agree, old), np.where(up, j, old_at)
                agree, j = np.where(up, old, agree), np.where(up, old_at, j)

        for w in range(1, (WIDE if mode == 3 else NEAR) + 1):
            i = np.arange(w, n)
            i = i[(region[i] == region[i - w]) & ((comp[i] != comp[i - w]) if mode > 1 else True)]
            if not len(i):
                continue
            agree = agreeing(i, i - w)
            ok = agree >= least
            i, agree = i[ok], agree[ok]
            offer(i, i - w, agree)
            if mode > 1:
                offer(i - w, i, agree)
        for k in range(top):
            i = np.flatnonzero(best_at[k] >= 0)
            a.append(ids[i])
            b.append(ids[best_at[k, i]])
        if mode == 3:  # the most central row of each stretch wider than the neighbourhood
            heads = np.flatnonzero(start)
            for x, y in zip(heads.tolist(), [*heads[1:].tolist(), n], strict=True):
                if y - x > WIDE and (comp[x:y] != comp[x]).any():
                    s = np.sort(sig[x:y], axis=0)
                    fresh = np.concatenate([np.ones((1, VALUES), bool), s[1:] != s[:-1]])
                    usual = np.empty(VALUES, np.uint16)
                    for c in range(VALUES):
                        at = np.flatnonzero(fresh[:, c])
                        usual[c] = s[at[np.argmax(np.diff(np.r_[at, y - x]))], c]
                    hub = x + int(np.argmax((sig[x:y] == usual).sum(axis=1)))
                    i = np.flatnonzero(comp[x:y] != comp[hub]) + x
                    i = i[agreeing(i, np.full(len(i), hub)) >= least]
                    a.append(ids[i])
                    b.append(np.full(len(i), ids[hub]))
        a, b = np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        for x in range(0, len(pairs), 100_000):
            p = pairs[x : x + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], ["a", "b"])

    return run


def _others(comp: np.ndarray) -> np.ndarray:
    """Rows that are not of the component with most rows."""
    values, which, count = np.unique(comp, return_inverse=True, return_counts=True)
    return np.flatnonzero(which != np.argmax(count))


def _possible(percent: int):
    """Pairs of different components in sorted cells that may be links; of a dense cell its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _read(batches)
        if t is None:
            return
        cell, ids, comp, n, pos = (t.column(c).to_numpy() for c in ("cell", "id", "comp", "n", "pos"))

        def may(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            most = np.minimum(n[i] - pos[i], n[j] - pos[j])  # where this is the first shingle in common
            return (comp[i] != comp[j]) & ((100 + percent) * most >= percent * (n[i] + n[j]))

        heads = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        ends = np.r_[heads[1:], len(cell)]
        rows = ends - heads
        which = np.repeat(np.arange(len(heads)), rows)
        rank = np.arange(len(cell)) - heads[which]
        found = np.zeros(len(heads), np.int64)
        i, w, a, b = np.flatnonzero(rows[which] <= SHORT), 0, [], []
        while len(i):
            w += 1
            i = i[rank[i] >= w]
            i = i[(100 * n[i - w] >= percent * n[i]) & (found[which[i]] <= DENSE * rows[which[i]])]
            ok = i[may(i, i - w)]
            np.add.at(found, which[ok], 1)
            a.append(ok)
            b.append(ok - w)
        for k in np.flatnonzero(rows > SHORT).tolist():
            x, y = heads[k], ends[k]
            others = _others(comp[x:y]) + x
            small = np.zeros(y - x, bool)
            small[others - x] = True
            for i in others.tolist():  # sizes rise within a cell
                lo, hi = x + np.searchsorted(n[x:y], [-(-percent * n[i] // 100), 100 * n[i] // percent + 1])
                j = np.arange(lo, hi)
                j = j[(~small[lo - x : hi - x] | (j > i)) & may(np.full(len(j), i), j)]
                found[k] += len(j)
                if found[k] > DENSE * rows[k]:
                    break
                a.append(np.full(len(j), i))
                b.append(j)
        dense = found > DENSE * rows
        a, b = np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])
        few = ~dense[which[a]]
        a, b = ids[a[few]], ids[b[few]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        for x in range(0, len(pairs), 100_000):
            p = pairs[x : x + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy()), pa.nulls(len(p), pa.int64())], ["a", "b", "cell"])
        i = np.flatnonzero(dense[which])
        for x in range(0, len(i), 100_000):
            p = i[x : x + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(ids[p]), pa.nulls(len(p), pa.int64()), pa.array(cell[p])], ["a", "b", "cell"])

    return run


def overlaps(sets: list[np.ndarray], of: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets numbered ``of`` with every set."""
    m = len(sets)
    out = np.zeros((len(of), m), np.float32)
    slot = np.full(m, -1)
    slot[of] = np.arange(len(of))
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((row, token))
    row, token = row[order], token[order]
    seldom = count[token] <= 32
    r, k = row[seldom], token[seldom]
    for w in range(1, 32):
        same = np.flatnonzero(k[w:] == k[:-w])
        if not len(same):
            break
        for x, y in ((r[same], r[same + w]), (r[same + w], r[same])):
            mine = slot[x] >= 0
            np.add.at(out, (slot[x[mine]], y[mine]), 1)
    r, (_, k) = row[~seldom], np.unique(token[~seldom], return_inverse=True)
    for x in range(0, int(k.max()) + 1 if len(k) else 0, 2048):
        lo, hi = np.searchsorted(k, [x, x + 2048])
        has = np.zeros((m, 2048), np.float32)
        has[r[lo:hi], k[lo:hi] - x] = 1
        out += has[of] @ has.T
    return out


def _joining(percent: int):
    """Links of sorted dense cells that join components there, from full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _read(batches)
        if t is None:
            return
        cell, ids, comp = (t.column(c).to_numpy() for c in ("cell", "id", "comp"))
        lists = t.column("shingles").combine_chunks()
        flat, offs = lists.values.to_numpy(), lists.offsets.to_numpy()
        heads = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        a, b = [], []
        for x, y in zip(heads.tolist(), [*heads[1:].tolist(), len(cell)], strict=True):
            n = np.diff(offs[x : y + 1]).astype(np.int64)
            label = comp[x:y].copy()
            for part in np.array_split(of := _others(label), -(-len(of) // 256) or 1):
                both = overlaps([flat[offs[k] : offs[k + 1]] for k in range(x, y)], part)
                for k, i in enumerate(part.tolist()):
                    j = np.flatnonzero((label != label[i]) & ((100 + percent) * both[k].astype(np.int64) >= percent * (n[i] + n)))
                    others, at = np.unique(label[j], return_index=True)
                    if len(others):
                        a += [ids[x + i]] * len(others)
                        b += ids[x + j[at]].tolist()
                        label[np.isin(label, others)] = label[i]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _dealt(spots: DataFrame) -> tuple[DataFrame, int]:
    """``cell, id, comp, n, pos`` of ``key, id, comp, n, pos`` under keys of several components, and how many.

    Chunks of a key's largest component (``i``) meet chunks of its other rows
    (``j``), and these each other.
    """
    each = spots.groupBy("key", "comp").agg(F.count("*").alias("rows"), F.sum("n").alias("all"))
    lists = each.groupBy("key").agg(F.sum("rows").alias("rows"), F.sum("all").alias("all"), F.count("*").alias("comps"), F.max(F.struct("rows", "all", "comp")).alias("top")).where("comps > 1")
    chunks = lambda rows, all: F.greatest(F.ceil(rows / CHUNK_ROWS), F.ceil(all / CHUNK_SHINGLES)).cast("int")
    wide = chunks(F.col("rows"), F.col("all")) > 1
    top, rest = F.col("top"), (F.col("rows") - F.col("top.rows"), F.col("all") - F.col("top.all"))
    lists = lists.select("key", "rows", top["comp"].alias("top"), F.when(wide, chunks(top["rows"], top["all"])).otherwise(1).alias("i"), F.when(wide, chunks(*rest)).otherwise(1).alias("j"))
    lists = written(lists, "near-lists")
    total = lists.agg(F.sum(F.col("rows") * (F.col("j") + 1))).first()[0] or 0
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda kind, x, y: F.xxhash64(F.lit(kind), "key", x, y)
    of_top = F.transform(up_to("j"), lambda y: cell(0, own("i"), y))
    of_rest = F.concat(F.transform(up_to("i"), lambda x: cell(0, x, own("j"))), F.when(F.col("j") > 1, F.transform(up_to("j"), lambda y: cell(1, F.least(y, own("j")), F.greatest(y, own("j"))))).otherwise(F.array().cast("array<bigint>")))
    dealt = spots.join(lists, "key").select(F.explode(F.when(F.col("comp") == F.col("top"), of_top).otherwise(of_rest)).alias("cell"), "id", "comp", "n", "pos")
    return dealt, total


def _families(dense: DataFrame) -> DataFrame:
    """``key, id`` for ``cell, id`` of dense cells, so that each pair of a cell meets under a key.

    Cells that share rows are one family, in which a row is sent once and not
    once a cell; a family with more pairs than all its cells stays in cells.
    """
    dense = written(dense, "near-dense")
    heads = dense.groupBy("cell").agg(F.min("id").alias("head"), F.count("*").alias("rows"))
    family = written(components(dense.join(heads, "cell").select("id", "head")), "near-families")
    pairs = heads.join(family, F.col("head") == F.col("id")).groupBy("component").agg(F.sum(F.col("rows") * F.col("rows")).alias("in_cells"))
    sizes = family.groupBy("component").agg(F.count("*").alias("rows")).join(pairs, "component").select("component", (F.col("rows") * F.col("rows") <= F.col("in_cells")).alias("whole"))
    family = written(family.join(sizes, "component"), "near-families")
    whole = family.where("whole").select(F.xxhash64(F.lit(2), "component").alias("key"), "id")
    return whole.union(dense.join(family.where("NOT whole"), "id").select(F.col("cell").alias("key"), "id"))


def _likely(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Pairs whose prefixes allow the overlap.

    A shingle in common lies in both prefixes or, of the set whose prefix ends
    first, after it.
    """
    side = lambda x: rows.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("prefix").alias(f"p{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    most = F.size(F.array_intersect("pa", "pb")) + F.greatest(F.col("na") - F.size("pa"), F.col("nb") - F.size("pb"))
    return both.where((100 + percent) * most >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``id, n_shingles, component_id`` of every row (at 80 % of 5-word shingles).

    Pairs with ``100 * intersection >= percent * union`` are links.
    """
    spark = docs.sparkSession
    rows = written(signatures(docs, id, text, width), "near-signatures")
    classes = rows.where("n > 0 AND id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"))
    classes = written(classes, "near-classes")
    total = classes.count()

    heads = lambda: F.posexplode(F.array(*[F.xxhash64(F.substring("sig", 2 * DEPTH * k + 1, 2 * DEPTH)) for k in range(ORDERS)])).alias("t", "key")
    rotated = lambda k: F.concat(F.substring("sig", 2 * DEPTH * k + 1, 2 * VALUES), F.substring("sig", 1, 2 * DEPTH * k)) if k else F.col("sig")
    keys = classes.select(F.col("rep").alias("id"), heads())
    parts = max(1, -(-total * ORDERS // (4 * STRETCH_ROWS)))
    sharing = mapped(keys.repartitionByRange(parts, "t", "key", "id").sortWithinPartitions("t", "key", "id"), _sharing, "id long").distinct()
    sharing = written(sharing, "near-sharing")
    n_sharing = sharing.count()
    small = F.broadcast if n_sharing <= BROADCAST_ROWS else (lambda df: df)
    active = written(classes.select(F.col("rep").alias("id"), "n", "sig").join(small(sharing), "id", "left_semi"), "near-active")
    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    sets = written(_sets(texts.join(small(sharing), "id", "left_semi"), width), "near-sets")

    def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        one = pairs.join(sets.withColumnsRenamed({"id": "a", "shingles": "sa"}), "a")
        two = one.join(sets.withColumnsRenamed({"id": "b", "shingles": "sb"}), "b")
        both = F.size(F.array_intersect("sa", "sb"))
        return two.select("a", "b", (100 * both >= percent * (F.size("sa") + F.size("sb") - both)).alias("ok")).where("ok").select("a", "b")

    links = tried = None
    comp = spark.createDataFrame([], "id long, component long")
    labelled = lambda: active.join(comp, "id", "left").select("id", "n", "sig", F.coalesce("component", "id").alias("comp"))
    for mode in (1, 2, 3):
        orders = range(FIRST) if mode == 1 else range(ORDERS)
        exploded = labelled().select("id", "n", "comp", F.posexplode(F.array(*[rotated(k) for k in orders])).alias("t", "order_sig"))
        parts = max(1, -(-n_sharing * len(orders) // STRETCH_ROWS))
        found = mapped(exploded.repartitionByRange(parts, "t", "order_sig", "id").sortWithinPartitions("t", "order_sig", "id"), _candidates(mode, percent), "a long, b long").distinct()
        if tried is not None:
            found = found.join(tried, ["a", "b"], "left_anti")
        found = written(found, f"near-candidates{mode}")
        if found.isEmpty():
            continue
        tried = found if tried is None else tried.union(found)
        new = written(linked(found, sets), f"near-links{mode}")
        if new.isEmpty():
            continue
        links = new if links is None else links.union(new)
        comp = written(components(links), f"near-components{mode}")

    # exact: rows of regions that still have several components
    spots = labelled().select("id", "comp", heads())
    mixed = written(spots.groupBy("t", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("t", "key"), "near-mixed")
    if n_mixed := mixed.count():
        opened = written(spots.join(F.broadcast(mixed) if n_mixed <= BROADCAST_ROWS else mixed, ["t", "key"]).select("id", "comp").distinct(), "near-open")
        few = F.broadcast if opened.count() <= BROADCAST_ROWS else (lambda df: df)
        open_sets = written(sets.join(few(opened), "id").select("id", "comp", F.size("shingles").cast("long").alias("n"), "shingles"), "near-open-sets")
        prefixed = open_sets.select("id", "comp", "n").join(_prefixes(open_sets.select("id", "shingles"), percent), "id")
        prefixed = written(prefixed, "near-prefixes")
        cells, total = _dealt(prefixed.select("id", "comp", "n", F.posexplode("prefix").alias("pos", "key")))
        if total:
            cells = cells.repartition(-(-total // LIST_ROWS), "cell").sortWithinPartitions("cell", "n", "id")
            rest = written(mapped(cells, _possible(percent), "a long, b long, cell long"), "near-rest")
            pairs = written(_likely(rest.where("cell IS NULL").select("a", "b").distinct(), prefixed, percent), "near-rest-pairs")
            dense = rest.where("cell IS NOT NULL").select("cell", F.col("a").alias("id")).distinct()
            own = open_sets.select("id", "shingles")
            new = linked(pairs, own)
            if not dense.isEmpty():
                spots = _families(dense).join(prefixed.select("id", "comp", "n"), "id").withColumn("pos", F.lit(0))
                cells, total = _dealt(spots)
                packed = cells.select("cell", "id", "comp").join(own, "id").repartition(-(-total // CHUNK_ROWS), "cell").sortWithinPartitions("cell", "id")
                new = new.union(mapped(packed, _joining(percent), "a long, b long"))
            new = written(new, "near-rest-links")
            if not new.isEmpty():
                comp = written(components(new if links is None else links.union(new)), "near-components")

    member = classes.select("h1", "h2", "n", "rep").join(comp, F.col("rep") == comp["id"], "left").select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.col("n").alias("cn"), F.coalesce("component", "rep").alias("component"))
    member = written(member, "near-members")
    out = rows.join(member, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")) & (F.col("n") == F.col("cn")), "left")
    label = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), label.alias("component_id"))


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document, the smallest id, of each group of near copies."""
    found = near_duplicates(docs, id, text, width, percent)
    gone = found.where(F.col("component_id") != F.col(id)).select(F.col(id)).distinct()
    return docs.join(gone, id, "left_anti")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of every document, and whether it stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs, width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3
           THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
           WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS MATERIALIZED (
  WITH RECURSIVE reach AS (
    SELECT DISTINCT a AS root, a AS node FROM e
    UNION
    SELECT reach.root, e.b FROM reach JOIN e ON e.a = reach.node
  ) SELECT root, min(node) AS c FROM reach GROUP BY root
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(r.c, d.doc_id) AS component_id,
       coalesce(r.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.root = d.doc_id
"""
