"""Cross-tokenizer alignment by a group dictionary (operator 13).

A text, with a space before it, is encoded by a byte-level BPE vocabulary (A)
and by a sentence-piece one (B).  Byte offsets at which tokens of both end cut
the tokens into groups.  Groups repeat, so they are interned: a document keeps
the keys of its distinct groups and how often it has them, and a dictionary
keeps each group once with its frequency.  Links (overlapping A and B tokens)
are expanded once for each distinct group and multiplied by its frequency; what
the counts say about a group is joined back by its key.

Scale: one pass over the texts, all tokens of a slice as arrays, which writes
keys and digests to the shared folder.  The dictionary is summed in each task
before it is shuffled.  Groups of the most documents, at most ``HOT_GROUPS`` by
a histogram of their documents, are broadcast; of the others each is in a
vanishing share of the documents, so they are joined by a plain exchange without
hot keys.  Pairs are broadcast if counted and found few.  Keys are 64-bit
hashes; should two groups share one, which the dictionary shows, the pass runs
again with another salt.

Defined cases: texts that are null, empty, or that the tokens do not spell byte
for byte (a U+2581, which B reads as a space) have no tokens: zeros and no
groups.  Special strings are plain text.  Repeated rows are counted each, rows
with a null id like any others.  An empty table gives an empty result.  Other
columns pass through but for the text; one named as an output column is
replaced.  A very long text is encoded in one slice of its own, some 150 bytes a
byte; a long run without a break takes no longer than other text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotlog.llm._common import fresh, mapped, mix, resident, slices, table, written
from knotlog.llm.bpe_codec import Encoder

#: Bytes of text whose tokens are aligned at once; distinct groups that a task sums before it hands them on.
STEP, TASK_GROUPS = 1 << 19, 150_000
#: Groups, and pairs of ids, that are broadcast at most (some 40 bytes each).
HOT_GROUPS, BROADCAST_PAIRS = 300_000, 500_000
#: Characters without a break from which a text is encoded by way of heaps.
RUN = 400
#: Fixed value: how the piece model writes a space.
SPACE = "▁"

_LONG_SPACE = re.compile(r"\s{%d}" % RUN).search


def default_paths() -> tuple[str, str]:
    """Where the installed public tokenizer package keeps vocabularies A and B."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Bytes:
    """Vocabulary A: the encoder of operator 7, and a faster one where both are known to agree.

    The faster one reads the vocabulary's tokens as ranks.  It may class a
    character otherwise, so each is tried once between others, and texts with
    one that it encodes otherwise, or with a long run, go to the slower one.
    """

    def __init__(self, path: str):
        import tiktoken

        self.exact = Encoder(path)
        self.token = self.exact.vocabulary.token
        special = set(self.exact.vocabulary.special.values())
        ranks = {t: i for i, t in enumerate(self.token) if i not in special}
        self.fast = tiktoken.Encoding("plain", pat_str=_pattern(), mergeable_ranks=ranks, special_tokens={})
        self.same: set[str] = set(map(chr, range(128)))
        self.odd: set[str] = set()

    def _exact(self, text: str) -> np.ndarray:
        parts = self.exact.split(text)
        coded = self.exact.pretokens(list(set(parts)))
        return np.frombuffer(b"".join([coded[p] for p in parts]), "<u4")

    def _try(self, chars: set[str]) -> None:
        for c in chars:
            probes = [f"a{c}a", f"1{c}1", f"!{c}!", f" {c} ", f"a {c}", f"\t{c}\t{c}x"]
            (self.same if all(self._exact(p).tolist() == self.fast.encode_ordinary(p) for p in probes) else self.odd).add(c)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, special strings being plain text."""
        if not text.isascii():
            chars = set(text)
            self._try(chars - self.same - self.odd)
            if not chars.isdisjoint(self.odd):
                return self._exact(text)
        if max(map(len, text.split()), default=0) >= RUN or _LONG_SPACE(text):
            return self._exact(text)
        return self.fast.encode_to_numpy(text, disallowed_special=())


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Pieces:
    """Vocabulary B."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.token = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]

    def encode(self, text: str) -> list[int]:
        """Ids of a text, before which the model puts a space."""
        return self.model.encode(text, num_threads=1)


class _Side:
    """Tables of one vocabulary by id: bytes of a token, its number's digits, and random values."""

    def __init__(self, token: list[bytes], seed: int):
        self.size = np.array([len(t) for t in token], np.int64)
        self.random = mix(np.arange(1, len(token) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


class Aligned:
    """Tokens of some texts in groups: sums, keys and text of the groups."""

    def __init__(self, align: Aligner, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, salt: int):
        # both sides spell the same bytes, so offsets over all texts are the same
        end_a, end_b = np.cumsum(align.of_a.size[a]), np.cumsum(align.of_b.size[b])
        at = np.minimum(np.searchsorted(end_b, end_a), max(len(end_b) - 1, 0))
        last_a = end_b[at] == end_a
        last_b = np.zeros(len(b), bool)
        last_b[at[last_a]] = True
        to_a, to_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        from_a, from_b = np.r_[0, to_a[:-1]][: len(to_a)], np.r_[0, to_b[:-1]][: len(to_b)]
        self.n_a, self.n_b = n_a, n_b
        self.doc = np.searchsorted(np.cumsum(n_a), from_a, "right")
        self.n_groups = np.bincount(self.doc, minlength=len(n_a))
        group_a, group_b = np.repeat(np.arange(len(to_a)), to_a - from_a), np.repeat(np.arange(len(to_b)), to_b - from_b)
        self.key = self._keys(align, (a, from_a, group_a), (b, from_b, group_b), salt)
        self._spell(a, b, group_a, group_b, (from_a, to_a), (from_b, to_b), last_a, last_b)

    @staticmethod
    def _keys(align: Aligner, on_a: tuple, on_b: tuple, salt: int) -> np.ndarray:
        out = np.uint64(salt)
        for side, (ids, start, group), base in ((align.of_a, on_a, 0xC2B2AE3D27D4EB4F), (align.of_b, on_b, 0x165667B19E3779F9)):
            if not len(ids):
                return np.zeros(0, np.uint64)
            place = np.arange(len(ids)) - start[group]
            powers = np.full(int(place.max()) + 1, base, np.uint64)
            powers[0] = 1
            out = mix(np.add.reduceat(side.random[ids] * np.cumprod(powers, dtype=np.uint64)[place], start) + out * np.uint64(0x9E3779B97F4A7C15))
        return out

    def _spell(self, a, b, group_a, group_b, span_a, span_b, last_a, last_b) -> None:
        """The groups' text, ``a1,a2|b1;``, as bytes, and where each begins."""
        ids, sep = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
        for tokens, place, last, mark in ((a, np.arange(len(a)) + span_b[0][group_a], last_a, b"|"), (b, np.arange(len(b)) + span_a[1][group_b], last_b, b";")):
            ids[place], sep[place] = tokens, np.where(last, mark[0], b","[0])
        digits = np.ones(len(ids), np.int64)
        power = 10
        while (more := ids >= power).any():
            digits += more
            power *= 10
        start = np.cumsum(digits + 1) - digits - 1
        self.text = np.empty(int(start[-1] + digits[-1] + 1) if len(ids) else 0, np.uint8)
        self.text[start + digits] = sep
        rest = ids
        for d in range(int(digits.max(initial=0))):  # from the last digit to the first
            own = digits > d
            self.text[(start + digits - 1 - d)[own]] = (rest[own] % 10 + 48).astype(np.uint8)
            rest = rest // 10
        self.at = np.r_[start[span_a[0] + span_b[0]], len(self.text)] if len(ids) else np.zeros(1, np.int64)

    def spelled(self, first: int, last: int) -> str:
        """The text of groups ``first`` to before ``last``."""
        return self.text[self.at[first] : self.at[last] - 1].tobytes().decode() if last > first else ""

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text, key): the text, the key, how often, and one group that has it."""
        order = np.lexsort((self.key, self.doc))
        key, doc = self.key[order], self.doc[order]
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]) if len(key) else np.zeros(0, np.int64)
        return doc[first], key[first], np.diff(np.r_[first, len(key)]), order[first]


class Aligner:
    """Cuts texts into groups of tokens of two vocabularies."""

    def __init__(self, bpe: str, pieces: str):
        self.a, self.b = Bytes(bpe), Pieces(pieces)
        self.of_a, self.of_b = _Side(self.a.token, 1), _Side(self.b.token, 2)

    def __call__(self, texts: list[str | None], salt: int = 0) -> Aligned:
        """The tokens of the texts, aligned."""
        none = np.zeros(0, np.int64)
        ids_a, ids_b = [], []
        for text in texts:
            b = self.b.encode(text) if text else []
            good = text and b"".join(map(self.b.token.__getitem__, b)) == f" {text}".encode()
            ids_a.append(self.a.encode(f" {text}") if good else none)
            ids_b.append(np.array(b, np.int64) if good else none)
        n = [np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b)]
        both = [np.concatenate([none, *ids]).astype(np.int64) for ids in (ids_a, ids_b)]
        return Aligned(self, *both, *n, salt)

    def links(self, group: str) -> Counter:
        """Overlapping tokens of a group, ``a1,a2|b1,b2``, counted by their ids."""
        a, b = ([int(x) for x in side.split(",")] for side in group.split("|"))
        if len(a) == 1 or len(b) == 1:
            return Counter((x, y) for x in a for y in b)
        out: Counter = Counter()
        end_a, end_b = np.cumsum(self.of_a.size[a]).tolist(), np.cumsum(self.of_b.size[b]).tolist()
        i = k = 0
        while i < len(a) and k < len(b):
            out[a[i], b[k]] += 1
            e, f = end_a[i], end_b[k]
            i, k = i + (e <= f), k + (f <= e)
        return out


def aligner(paths: tuple[str, str]) -> Aligner:
    """The aligner of two vocabularies, kept in a Python worker."""
    return resident(("aligner", paths), lambda: Aligner(*paths))


_DOC = [("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("groups", T.StringType()), ("keys", T.ArrayType(T.LongType())), ("times", T.ArrayType(T.LongType()))]
_GROUP = [("key", T.LongType()), ("group", T.StringType()), ("freq", T.LongType()), ("docs", T.LongType())]


class _Dictionary:
    """A task's groups: the text of each once, and sums."""

    def __init__(self):
        self.text: dict[int, str] = {}
        self.sums: list[tuple[np.ndarray, ...]] = []

    def add(self, tokens: Aligned, key: np.ndarray, times: np.ndarray, group: np.ndarray) -> None:
        own, first, back = np.unique(key, return_index=True, return_inverse=True)
        for k, g in zip(own.tolist(), group[first].tolist(), strict=True):
            if k not in self.text:
                self.text[k] = tokens.spelled(g, g + 1)
        self.sums.append((own, np.bincount(back, times, len(own)), np.bincount(back, minlength=len(own))))

    def rows(self) -> Iterator[list[pa.Array]]:
        """Columns of ``_GROUP`` for what was added; nothing is left."""
        if self.sums:
            key, back = np.unique(np.concatenate([s[0] for s in self.sums]), return_inverse=True)
            freq, docs = (np.bincount(back, np.concatenate([s[i] for s in self.sums])).astype(np.int64) for i in (1, 2))
            for at in range(0, len(key), 20_000):
                own = slice(at, at + 20_000)
                yield [pa.array(key[own]), pa.array([self.text[k] for k in key[own].tolist()], pa.string()), pa.array(freq[own]), pa.array(docs[own])]
        self.text, self.sums = {}, []


def _encoded(docs: DataFrame, own: list[T.StructField], text: str, paths: tuple[str, str], salt: int) -> DataFrame:
    """A row ``doc`` for each document and rows ``entry`` of the task's dictionary, one of them null."""
    from pyspark.sql.pandas.types import to_arrow_schema

    doc = T.StructType([T.StructField("own", T.StructType(own)), *[T.StructField(n, t) for n, t in _DOC]])
    entry = T.StructType([T.StructField(n, t) for n, t in _GROUP])
    schema = T.StructType([T.StructField("doc", doc), T.StructField("entry", entry)])
    arrow = to_arrow_schema(schema)
    of_doc, of_entry = arrow.field("doc").type, arrow.field("entry").type
    of_own = of_doc.field("own").type

    def entries(found: _Dictionary) -> Iterator[pa.RecordBatch]:
        for columns in found.rows():
            made = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, of_entry, strict=True)], fields=list(of_entry))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(made), of_doc), made], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, found = aligner(paths), _Dictionary()
        for whole in batches:
            for batch in slices(whole, text, STEP):
                tokens = align(batch.column(text).to_pylist(), salt)
                doc, key, times, group = tokens.counted()
                key = key.view(np.int64)
                found.add(tokens, key, times, group)
                edge = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(edge), pa.array(x, pa.int64())) for x in (key, times)]
                of_group = np.r_[0, np.cumsum(tokens.n_groups)].tolist()
                spelled = pa.array([tokens.spelled(x, y) for x, y in zip(of_group[:-1], of_group[1:], strict=True)], pa.string())
                made = [pa.array(tokens.n_a), pa.array(tokens.n_b), pa.array(tokens.n_groups), spelled, *lists]
                rest = pa.StructArray.from_arrays([batch.column(f.name).cast(f.type) for f in of_own], fields=list(of_own))
                columns = [rest, *[c.cast(of_doc.field(n).type) for c, (n, _) in zip(made, _DOC, strict=True)]]
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, fields=list(of_doc)), pa.nulls(batch.num_rows, of_entry)], schema=arrow)
                if len(found.text) > TASK_GROUPS:
                    yield from entries(found)
        yield from entries(found)

    return mapped(docs, run, schema)


def _expanded(groups: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """``key, pair, links, count``: the links of each distinct group, and how many the corpus has by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(paths)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for key, group, freq in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for (a, b), n in align.links(group).items():
                    for column, x in zip(out, (key, a << 32 | b, n, n * freq), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["key", "pair", "links", "count"])

    return mapped(groups.select("key", "group", "freq"), run, "key long, pair long, links long, count long")


def _of_groups(groups: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """``key, docs, links, best, total`` of each distinct group."""
    links = written(_expanded(groups, paths), "links")
    counted = links.groupBy("pair").agg(F.sum("count").alias("n"))
    counted = written(counted.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))), "pairs")
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    known = written(counted.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("is_best")), "best-pairs")
    known = F.broadcast(known) if known.count() <= BROADCAST_PAIRS else known
    sums = links.join(known, "pair").groupBy("key").agg(F.sum("links").alias("links"), F.sum(F.when(F.col("is_best"), F.col("links")).otherwise(0)).alias("best"), F.sum(F.col("links") * F.col("n")).alias("total"))
    return written(groups.select("key", "docs").join(sums, "key"), "group-sums")


def _hot(groups: DataFrame) -> int:
    """Documents from which a group is broadcast, so that no more than ``HOT_GROUPS`` are."""
    level, total = F.floor(F.log2("docs")).cast("int").alias("level"), 0
    least = 1 << 62
    for r in groups.groupBy(level).count().orderBy(F.col("level").desc()).collect():  # a row for each power of two
        total += r["count"]
        if total > HOT_GROUPS:
            break
        least = 1 << r["level"]
    return least


def align(docs: DataFrame, text: str = "text", paths: tuple[str, str] | None = None, shown: Callable[[Column], Column] = lambda groups: groups) -> DataFrame:
    """``docs`` without its text, with ``n_a, n_b, n_groups, n_links, n_best, count_sum`` and ``groups``.

    ``groups`` are the ids, ``a1,a2|b1;a3|b2,b3``; ``shown`` makes of that text
    what is kept of it, so that a digest need not move the whole.
    """
    paths = paths or default_paths()
    new = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    own = [f for f in docs.schema.fields if f.name not in (*new, text)]
    words = fresh(docs, "own_text")
    source = docs.select(*[F.col(f"`{f.name}`") for f in own], F.col(f"`{text}`").alias(words))
    for salt in range(64):
        both = _encoded(source, own, words, paths, salt)
        kept = F.col("doc").withField("groups", shown(F.col("doc.groups")))
        both = written(both.select(F.when(F.col("doc").isNotNull(), kept).alias("doc"), "entry", F.monotonically_increasing_id().alias("row")), "encoded")
        entry = both.where("entry IS NOT NULL").select("entry.*")
        groups = written(entry.groupBy("key").agg(F.min("group").alias("group"), F.max("group").alias("other"), F.sum("freq").alias("freq"), F.sum("docs").alias("docs")), "groups")
        if groups.where(F.col("group") != F.col("other")).isEmpty():
            break
    sums = _of_groups(groups, paths)
    docs_only = both.where("doc IS NOT NULL")
    each = docs_only.select("row", F.explode(F.arrays_zip(F.col("doc.keys").alias("key"), F.col("doc.times").alias("times"))).alias("x")).select("row", F.col("x.key").alias("key"), F.col("x.times").alias("times"))
    least = _hot(sums)
    hot = F.broadcast(sums.where(F.col("docs") >= least).drop("docs"))
    rare = sums.where(F.col("docs") < least).drop("docs")
    per = ("links", "best", "total")
    if rare.isEmpty():
        joined = each.join(hot, "key")
    else:
        tried = each.join(hot, "key", "left")
        joined = tried.where("links IS NOT NULL").unionByName(tried.where("links IS NULL").drop(*per).join(rare, "key"))
    of_row = joined.groupBy("row").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in per])
    out = docs_only.select("row", "doc").join(of_row, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select(*[F.col(f"doc.own.`{f.name}`").alias(f.name) for f in own], "doc.n_a", "doc.n_b", "doc.n_groups", zero("links").alias("n_links"), zero("best").alias("n_best"), zero("total").alias("count_sum"), F.col("doc.groups").alias("groups"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every document under two vocabularies, and a digest of its groups."""
    digest = lambda g: F.when(g == "", g).otherwise(F.sha2(F.encode(g, "UTF-8"), 256))
    found = align(table(spark, sf_dir, "documents").select("doc_id", "text"), shown=digest)
    return found.withColumnRenamed("groups", "groups_sha256")
