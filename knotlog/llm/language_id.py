"""Language ID by segmentation-marginalised unigrams (operator 4).

Each language has a probability for every piece of a fixed public vocabulary of
byte strings.  The probability of a word is the sum over all its segmentations
into pieces, which a forward algorithm adds up position by position for all
languages at once; expectation maximisation with the matching backward pass
learns the pieces' probabilities from labelled text.  Every piece of the
vocabulary counts and words are never cut: sums are scaled as they go, so a
word may have any length.  A text's log probability is the sum of its words',
over the root of their number, which keeps the score of long texts from
becoming 0 or 1 for all but ties; the score is the best language's share.

Scale: learning takes a bounded sample of labelled rows (``MAX_DOCS`` of each
language), so what reaches the driver does not grow.  The model (vocabulary x
languages) is broadcast and every row is scored where it lies: no shuffle.
Words met before are looked up by hash, ``REMEMBER`` of them at most.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
rows without a label are scored but not learned from; ties go to the language
first in order; with nothing to learn from (an empty table too) everything is
``und``; repeated rows are scored alike; a null id is never held out and never
learned from; other columns pass through, and one named as an output column is
replaced (``prefix`` keeps both).  A very long text is scored in one slice of
its own, about 60 bytes a byte.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotlog.llm._common import Words, fresh, mapped, resident, slices, table, utf8

#: Labelled rows of one language that are learned from, about.
MAX_DOCS = 600
ROUNDS = 4
#: Added to every piece's expected count.
SMOOTH = 0.02
#: Words that one Python process remembers at most (about 150 bytes each).
REMEMBER = 150_000
#: Words that one forward pass holds at most, and their bytes.
PASS_WORDS, PASS_BYTES = 20_000, 1 << 20
#: Sums below this are scaled up.
TINY = 1e-100

_WORD = re.compile(r"[^\W\d_]+")
#: Bytes of runs that may hold letters: ASCII letters and all of other characters.
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def default_path() -> str:
    """The installed public vocabulary of byte pieces for many languages."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Pieces:
    """A vocabulary of byte strings as a trie in one hash table.

    A node is the number of a prefix of a piece; ``step`` follows a byte and
    gives -1 where no piece goes on.
    """

    def __init__(self, vocabulary: list[bytes]):
        self.size = len(vocabulary)
        edges: dict[int, int] = {}
        piece = [-1]
        for number, p in enumerate(vocabulary):
            node = 0
            for byte in p:
                key = node << 8 | byte
                to = edges.get(key)
                if to is None:
                    to = edges[key] = len(piece)
                    piece.append(-1)
                node = to
            piece[node] = number
        self.piece = np.array(piece, np.int32)
        keys, to = np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int32, len(edges))
        bits = max(8, int(len(keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.to = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):  # each free slot goes to one of those that want it, the others try the next
            free = self.keys[at] == -1
            slot, first = np.unique(at[free], return_index=True)
            own = np.flatnonzero(free)[first]
            self.keys[slot], self.to[slot] = keys[left[own]], to[left[own]]
            rest = np.ones(len(left), bool)
            rest[own] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node.astype(np.int64) << 8 | byte
        at = self._slot(key)
        out = np.where(self.keys[at] == key, self.to[at], -1)
        left = np.flatnonzero((self.keys[at] != key) & (self.keys[at] != -1))
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.keys) - 1)
            hit = self.keys[at] == key[left]
            out[left[hit]] = self.to[at[hit]]
            go = ~hit & (self.keys[at] != -1)
            left, at = left[go], at[go]
        return out


def pieces(path: str) -> Pieces:
    """The vocabulary of ``path``, kept in a Python process; every single byte is a piece of it."""
    return resident(("pieces", path), lambda: _pieces(path))


def _pieces(path: str) -> Pieces:
    with open(path, "rb") as f:
        found = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return Pieces(list(dict.fromkeys([bytes([b]) for b in range(256)] + found)))


class Lattice:
    """All segmentations of byte strings of like length, position by position."""

    def __init__(self, words: list[bytes], vocabulary: Pieces):
        self.vocabulary = vocabulary
        self.lens = np.array([len(w) for w in words], np.int64)
        self.width = int(self.lens.max())
        self.bytes = np.zeros((self.width, len(words)), np.uint8)
        for k, w in enumerate(words):
            self.bytes[: len(w), k] = np.frombuffer(w, np.uint8)

    def edges(self, i: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, words, pieces) of what starts at position ``i``."""
        live = np.flatnonzero(self.lens > i)
        node = np.zeros(len(live), np.int32)
        at = i
        while len(live):
            node = self.vocabulary.step(node, self.bytes[at, live])
            go = node >= 0
            live, node = live[go], node[go]
            at += 1
            piece = self.vocabulary.piece[node]
            ends = piece >= 0
            if ends.any():
                yield at - i, live[ends], piece[ends]
            go = self.lens[live] > at
            live, node = live[go], node[go]

    def forward(self, prob: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sums of all ways to each position, and their scale: true sum = sum * exp(scale).

        ``keep`` gets the edges of each position.
        """
        n, columns = len(self.lens), prob.shape[1]
        alpha = np.zeros((self.width + 1, n, columns))
        alpha[0] = 1.0
        scale, now = np.zeros((self.width + 1, n, columns)), np.zeros((n, columns))
        for i in range(self.width):
            found = list(self.edges(i))
            if keep is not None:
                keep.append(found)
            low = np.flatnonzero(((alpha[i] < TINY) & (alpha[i] > 0)).any(axis=1)) if i else ()
            if len(low):  # what is summed so far moves to the scale of this position
                up = np.where(alpha[i, low] > 0, alpha[i, low], 1.0)
                alpha[i:, low] /= up
                now[low] += np.log(up)
            scale[i] = now
            for length, words, piece in found:
                alpha[i + length, words] += alpha[i, words] * prob[piece]
            ended = np.flatnonzero(self.lens == i + 1)
            if len(ended):
                scale[i + 1 :, ended] = now[ended]
        return alpha, scale

    def totals(self, alpha: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Log probability of each word in each column."""
        at = (self.lens, np.arange(len(self.lens)))
        return np.log(np.maximum(alpha[at], 1e-300)) + scale[at]

    def expected(self, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected number of each piece over all segmentations (one column)."""
        kept: list = []
        alpha, scale = self.forward(prob, kept)
        total = self.totals(alpha, scale)[:, 0]
        alpha, scale = alpha[:, :, 0], scale[:, :, 0]
        beta, back, now = np.zeros_like(alpha), np.zeros_like(alpha), np.zeros(len(self.lens))
        beta[self.lens, np.arange(len(self.lens))] = 1.0
        out = np.zeros(len(prob))
        for i in range(self.width - 1, -1, -1):
            for length, words, piece in kept[i]:
                p = prob[piece, 0]
                into = beta[i + length, words] * np.exp(back[i + length, words] - now[words])
                beta[i, words] += p * into
                share = np.exp(np.log(np.maximum(alpha[i, words] * p * beta[i + length, words], 1e-300)) + scale[i, words] + back[i + length, words] - total[words])
                out += np.bincount(piece, weight[words] * share, len(prob))
            low = np.flatnonzero((beta[i] < TINY) & (beta[i] > 0))
            now[low] += np.log(beta[i, low])
            beta[i, low] = 1.0
            back[i] = now
        return out


def batches_of(words: list[bytes]) -> Iterator[np.ndarray]:
    """Numbers of words of like length, as many as one pass holds."""
    lens = np.array([len(w) for w in words], np.int64)
    step = np.ceil(np.log2(np.maximum(lens, 8)) * 4).astype(np.int64)
    order = np.lexsort((lens, step))
    a = 0
    while a < len(order):
        most = max(1, min(PASS_WORDS, PASS_BYTES // int(2 ** ((step[order[a]]) / 4))))
        b = min(a + most, int(np.searchsorted(step[order], step[order[a]], "right")))
        yield order[a:b]
        a = b


def words_in(text: str) -> list[str]:
    """Lower-cased runs of word characters with a letter, without digits."""
    return [w for w in _WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def as_bytes(word: str) -> bytes:
    """A word as the vocabulary's pieces write it, with its leading space."""
    return (" " + word).encode("utf-8", "replace")


def fit_language(counts: dict[str, int], vocabulary: Pieces) -> np.ndarray:
    """Piece probabilities of one language from its words' counts."""
    words = [as_bytes(w) for w in counts]
    weight = np.fromiter(counts.values(), float, len(counts))
    parts = [(Lattice([words[k] for k in own], vocabulary), weight[own]) for own in batches_of(words)]
    prob = np.full((vocabulary.size, 1), 1 / vocabulary.size)
    for _ in range(ROUNDS):
        new = np.full(vocabulary.size, SMOOTH)
        for lattice, w in parts:
            new += lattice.expected(prob, w)
        prob = (new / new.sum())[:, None]
    return prob[:, 0]


def held_out(id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.encode(id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", path: str | None = None) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the probability of each piece in each of them."""
    path = path or default_path()
    learn = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang")).where(F.col("_id").isNotNull() & F.col("_lang").isNotNull() & F.col("_text").isNotNull() & ~held_out(F.col("_id")))
    sizes = {r["_lang"]: r["n"] for r in learn.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((pieces(path).size, 0))
    share = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, MAX_DOCS / n)])
    point = F.pmod(F.xxhash64(F.lit(11), "_id"), F.lit(1_000_000)) / 1e6
    sample = learn.where(point < F.element_at(share, F.col("_lang"))).select("_lang", "_text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.update((name, w) for w in words_in(text))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found]), pa.array([k[1] for k in found]), pa.array(list(found.values()), pa.int64())], ["_lang", "word", "n"])

    # words of the bounded sample
    counted = mapped(sample, words, "_lang string, word string, n long").groupBy("_lang", "word").agg(F.sum("n").alias("n")).toArrow().sort_by([("_lang", "ascending"), ("word", "ascending")])
    by: dict[str, dict[str, int]] = {name: {} for name in sorted(sizes)}
    for name, word, n in zip(*[counted.column(c).to_pylist() for c in ("_lang", "word", "n")], strict=True):
        by[name][word] = n
    by = {name: words_of for name, words_of in by.items() if words_of}
    if not by:
        return [], np.zeros((pieces(path).size, 0))
    return list(by), np.stack([fit_language(x, pieces(path)) for x in by.values()], axis=1)


class Scorer:
    """Scores texts with a fitted model; remembers runs of letters by hash."""

    def __init__(self, languages: list[str], prob: np.ndarray, path: str):
        self.languages, self.prob, self.vocabulary = languages, prob, _pieces(path)
        self.at: dict[int, int] = {}
        self.rows = np.zeros((1024, len(languages) + 1))

    def log_probability(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        data, out = [as_bytes(w) for w in words], np.zeros((len(words), len(self.languages)))
        for own in batches_of(data):
            lattice = Lattice([data[k] for k in own], self.vocabulary)
            out[own] = lattice.totals(*lattice.forward(self.prob))
        return out

    def learn(self, hashes: list[int], runs: list[bytes]) -> None:
        """Sums of a run's words in each language; the last column counts the words."""
        found = [words_in(x.decode("utf-8", "replace")) for x in runs]
        new = list({w for words in found for w in words})
        number = dict(zip(new, range(len(new)), strict=True))
        logs = np.hstack([self.log_probability(new), np.ones((len(new), 1))]) if new else np.zeros((0, self.rows.shape[1]))
        n = len(self.at)
        if n + len(runs) > len(self.rows):
            self.rows = np.vstack([self.rows[:n], np.zeros((n // 2 + len(runs) + 1024, self.rows.shape[1]))])
        owner = np.repeat(np.arange(len(runs)), [len(words) for words in found])
        own = logs[[number[w] for words in found for w in words]] if new else logs
        for c in range(self.rows.shape[1]):
            self.rows[n : n + len(runs), c] = np.bincount(owner, own[:, c], len(runs))
        self.at.update(zip(hashes, range(n, n + len(runs)), strict=True))

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each text of a slice (bytes and row offsets)."""
        rows = len(offs) - 1
        runs = Words(data, offs, lower=True, solid=_LETTERS)
        if not len(runs) or not self.languages:
            return ["und"] * rows, np.zeros(rows)
        hashes, first, which = np.unique(runs.hash, return_index=True, return_inverse=True)
        keys = hashes.tolist()
        if len(self.at) > REMEMBER:
            self.at.clear()
        new = [k for k, h in enumerate(keys) if h not in self.at]
        if new:
            raw = runs.data.tobytes()
            a, b = runs.start[first[new]].tolist(), runs.end[first[new]].tolist()
            self.learn([keys[k] for k in new], [raw[x:y] for x, y in zip(a, b, strict=True)])
        at = np.fromiter(map(self.at.__getitem__, keys), np.int64, len(keys))
        total = np.zeros((rows, self.rows.shape[1]))
        for c in range(total.shape[1]):
            total[:, c] = np.bincount(runs.row, self.rows[at, c][which], rows)
        words = total[:, -1]
        logp = total[:, :-1] / np.sqrt(np.maximum(words, 1))[:, None]
        best = np.argmax(logp, axis=1)
        score = 1 / np.exp(logp - logp[np.arange(rows), best][:, None]).sum(axis=1)
        names = [self.languages[k] if n else "und" for k, n in zip(best.tolist(), words.tolist(), strict=True)]
        return names, np.where(words > 0, score, 0.0)


def predict(docs: DataFrame, languages: list[str], prob: np.ndarray, text: str = "text", path: str | None = None, prefix: str = "") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only the text is looked at.

    ``prefix`` goes before these names, for tables that have such columns.
    """
    path = path or default_path()
    new = [f"{prefix}lang_pred", f"{prefix}score"]
    kept = [f for f in docs.schema.fields if f.name not in new]
    out = T.StructType([*kept, T.StructField(new[0], T.StringType()), T.StructField(new[1], T.DoubleType())])
    names = [f.name for f in kept]
    model = docs.sparkSession.sparkContext.broadcast((languages, prob.astype(np.float32)))
    key = ("scorer", path, hash(prob.tobytes()), *languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = resident(key, lambda: Scorer(model.value[0], model.value[1].astype(float), path))
        for whole in batches:
            for batch in slices(whole, text):
                found, sure = score(*utf8(batch.column(text)))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(found, pa.string()), pa.array(sure, pa.float64())], [*names, *new])

    return mapped(docs, run, out)


def keep_known(docs: DataFrame, learn_from: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows whose language is known, however sure.

    With nothing to learn from, rows with a letter stay.
    """
    languages, prob = fit(learn_from, id, text, lang)
    if not languages:
        return docs.where(F.col(text).rlike(r"\p{L}"))
    prefix = fresh(docs, "language_id_")
    scored = predict(docs, languages, prob, text, prefix=prefix)
    return scored.where(F.col(f"{prefix}lang_pred") != "und").select(*docs.columns)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    languages, prob = fit(docs)
    scored = predict(docs.select("doc_id", "text"), languages, prob)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
