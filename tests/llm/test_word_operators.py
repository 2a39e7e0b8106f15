"""Spelling variants, benchmark decontamination and token alignment against brute force and the public libraries."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from knotlog.llm import decontaminate, spelling, token_alignment

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}
NAMES = ("id", "place", "key", "word", "n", "run", "doc", "row", "entry", "groups", "items", "spans", "n_words", "n_hit", "_places", "own_text", "contaminated", "links", "total")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def in_duck(sql, *tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con.sql(sql)


# --- spelling ---------------------------------------------------------------


def brute_variants(words, factor=5):
    near = {w: set() for w in words}
    for a in words:
        for p in range(len(a)):
            short = a[:p] + a[p + 1 :]
            if short in words:
                near[a].add(short)
                near[short].add(a)
        near[a] |= {b for b in words if len(b) == len(a) and sum(x != y for x, y in zip(a, b, strict=True)) == 1}
    form = {}
    for w in words:
        if near[w] and words[b := min(near[w], key=lambda x: (-words[x], x))] >= factor * words[w]:
            form[w] = b
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words.get(form.get(w))))
    return sorted(out, key=repr)


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_variants_are_those_of_all_pairs(spark):
    draw = random.Random(5)
    words = {}
    for _ in range(700):
        w = "".join(draw.choices("aab\u00e9\U0001f600", k=draw.randint(1, 7)))
        words[w] = draw.choice([1, 1, 2, 3, 5, 25, 125, 600])
    words |= {"x" * 3000: 50, "x" * 2999: 10, "x" * 1500 + "y" + "x" * 1499: 1, "q": 3}
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3))
    assert rows_of(got, *COLUMNS) == brute_variants(words)


def test_ties_chains_and_a_large_group(spark):
    """All letters at one place are near one another; forms are followed over several steps."""
    hot = {f"comm{chr(c)}n": 5 for c in [*range(97, 123), *range(0xE0, 0x100)]} | {"commun": 500, "commn": 2000}
    chain = {"aaaaaa": 1, "aaaaab": 5, "aaaabb": 25, "aaabbb": 125, "aabbbb": 625, "abbbbb": 3125, "bbbbbb": 15625}
    words = hot | chain | {"tiesxa": 1, "tiesxb": 7, "tiesxc": 7}
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert {r["root"] for w, r in got.items() if w in chain} == {"bbbbbb"} and got["aaaaaa"]["form"] == "aaaaab"
    assert got["common"]["form"] == "commn" and got["common"]["n_near"] == len(hot) - 1 and got["commun"]["form"] is None
    assert got["tiesxa"]["form"] == "tiesxb" and got["tiesxb"]["form"] is None
    assert len(got) == len(words)


def test_keys_of_colliding_hashes_are_confirmed(spark, monkeypatch):
    """With a hash of few values nothing changes but the work."""
    words = {"".join(random.Random(i).choices("abcdef", k=6)): i % 9 + 1 for i in range(300)}
    real = spelling._keys

    def few(batches):
        for b in real(batches):
            yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy() % 7), b.column(1), b.column(2)], b.schema.names)

    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    monkeypatch.setattr(spelling, "_keys", few)
    assert rows_of(spelling.variants(frame), *COLUMNS) == brute_variants(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab\u00ff\U0001f600", min_size=1, max_size=6), min_size=1, max_size=8))
def test_equal_strings_have_equal_keys(words):
    key, owner, place = spelling.deletion_keys(words)
    seen = {}
    for k, o, p in zip(key.tolist(), owner.tolist(), place.tolist(), strict=True):
        w = words[o]
        assert seen.setdefault(w if p < 0 else w[:p] + w[p + 1 :], k) == k
    assert len(set(seen.values())) == len(seen)


def brute_words(rows):
    n = Counter()
    for d, t, *_ in rows:
        for r in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            r = r.translate(LOWER)
            if d is not None and not (h := zlib.crc32(f"{d}:{r}".encode())) % 199:
                p = h % len(r)
                r = r[:p] + r[p + 1 :]
            n[r] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def test_spelling_query(spark, tmp_path):
    draw = random.Random(1)
    words = ["".join(draw.choices("ab\u00c9\u00d7Z", k=draw.randint(4, 9))) for _ in range(300)]
    rows = [(i % 90, " ".join(draw.choices(words, k=80)) + "\n1x_y") for i in range(150)] + [(None, "Straighten " * 9), (7, None), (8, ""), (9, "z" * 50_000), (9, "z" * 50_000)] + [(i, "z" * 50_000) for i in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("c") for c in NAMES}).write.parquet(str(tmp_path / "documents.parquet"))
    got = spelling.op11_spelling(spark, str(tmp_path))
    assert rows_of(got, *COLUMNS) == brute_variants(brute_words(rows))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert spelling.op11_spelling(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_spelling_sql(spark):
    want = in_duck(spelling.SQL, "documents")
    assert rows_of(spelling.op11_spelling(spark, SF), *COLUMNS) == sorted(want.select(*COLUMNS).fetchall(), key=repr)


# --- decontamination --------------------------------------------------------

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def brute_hits(docs, tests, width=10):
    low = lambda t: (t or "").translate(LOWER)
    windows = {}
    for i, t in tests:
        w = WORD.findall(low(t))
        k = min(width, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).add(i)
    out = []
    for d, t in docs:
        found = list(WORD.finditer(low(t)))
        w, hit, items = [m[0] for m in found], set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if (named := windows.get(tuple(w[a : a + k]))) is not None:
                    hit |= set(range(a, a + k))
                    items |= named
        spans = []
        for a in sorted(hit):
            if a - 1 in hit:
                spans[-1] = (spans[-1][0], found[a].end())
            else:
                spans.append(found[a].span())
        out.append((d, len(w), len(hit), tuple(sorted((x for x in items if x is not None), key=str)), tuple(spans)))
    return sorted(out, key=repr)


def hits(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), tuple((s["start"], s["end"]) for s in r["spans"])) for r in df.collect()), key=repr)


TEXTS = [None, "", "...", "Seven!", "seven", "a b c d e f g h i j k", "A-B-c/d e\U0001f600f g", "\u00e9t\u00e9 \u00c9t\u00e9"]


@pytest.mark.parametrize("pack", [1 << 21, 300])
def test_hits_are_those_of_all_windows(spark, monkeypatch, pack):
    monkeypatch.setattr(decontaminate, "PACK_BYTES", pack)
    draw = random.Random(4)
    say = lambda k: " ".join(draw.choices(["the", "of", "Cat", "dog", "caf\u00e9", "x1"], k=k))
    tests = [(i, say(draw.randint(0, 30))) for i in range(12)] + [(20, "SEVEN"), (None, "null id item"), (21, None), (22, ""), (23, "!?"), (3, "second text of item three"), (24, "Seven")]
    docs = [(i, t) for i, t in enumerate(TEXTS)]
    docs += [(100 + i, f"\U0001f600 {say(5)}, {tests[i % 12][1]}... {say(3)}; NULL  id\titem SEVEN second text of item") for i in range(60)]
    docs += [(None, f"x {tests[1][1]} y"), (7, "seven"), (500, " ".join(["hay"] * 40_000 + [tests[2][1], "seven", "hay" * 9]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({c: F.lit("c") for c in NAMES})
    items = spark.createDataFrame(tests, "item_id long, text string")
    got = decontaminate.decontaminate(frame, items)
    assert hits(got) == brute_hits(docs, tests)
    assert got.where("contaminated <> (n_hit > 0)").isEmpty() and got.where("id = 'c'").count() == len(docs)
    assert decontaminate.decontaminate(frame.limit(0), items).count() == 0
    assert decontaminate.decontaminate(frame, items.limit(0), with_text=False).where("n_hit > 0").isEmpty()


def test_a_passage_in_every_document(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    docs = [(i, f"own {i} {passage if i % 3 else ''} end {i}") for i in range(900)]
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(i, passage) for i in range(30)], "item_id long, text string"))
    assert {(r["doc_id"] % 3 > 0, r["n_hit"], len(r["items"])) for r in got.collect()} == {(True, 40, 30), (False, 0, 0)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_decontamination_sql(spark):
    got = decontaminate.op12_decontaminate(spark, SF)
    assert rows_of(got, *sorted(got.columns)) == sorted(in_duck(decontaminate.SQL, "documents", "benchmark").select(*sorted(got.columns)).fetchall(), key=repr)


# --- token alignment --------------------------------------------------------


def libraries():
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute_groups(text, a, b):
    """Groups and linked id pairs of a text, by the libraries; None if the tokens do not spell it."""
    if not text:
        return None
    letters = token_alignment.aligner(token_alignment.default_paths()).a.token
    ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
    of_a = [letters[i] for i in ids_a]
    of_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in ids_b]
    if b"".join(of_a) != f" {text}".encode() or b"".join(of_b) != f" {text}".encode():
        return None

    def spans(tokens):
        at = 0
        for t in tokens:
            yield at, at + len(t)
            at += len(t)

    sa, sb = list(spans(of_a)), list(spans(of_b))
    groups, links, i, k = [], [], 0, 0
    for e in sorted({y for _, y in sa} & {y for _, y in sb}):
        j, m = next(n + 1 for n in range(i, len(sa)) if sa[n][1] == e), next(n + 1 for n in range(k, len(sb)) if sb[n][1] == e)
        groups.append(",".join(map(str, ids_a[i:j])) + "|" + ",".join(map(str, ids_b[k:m])))
        links += [(ids_a[x], ids_b[y]) for x in range(i, j) for y in range(k, m) if max(sa[x][0], sb[y][0]) < min(sa[x][1], sb[y][1])]
        i, k = j, m
    return len(ids_a), len(ids_b), groups, links


def brute_alignment(rows):
    a, b = libraries()
    found = [(d, brute_groups(t, a, b)) for d, t in rows]
    counts = Counter(x for _, f in found if f for x in f[3])
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    none = (0, 0, 0, 0, 0, 0, "")
    return sorted(((d, *((f[0], f[1], len(f[2]), len(f[3]), sum(counts[x] == most[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), ";".join(f[2])) if f else none)) for d, f in found), key=repr)


ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
ODD = [None, "", " ", "\n", "  a  b ", "a\u2581b", "<|endoftext|> <s></s><unk> <0x0A>", "x\t\r\n y\r{\r", "e\u0301 \u6771\u4eac\U0001f600\u200d", "\x00\x1c z\x85\u00a0w\u3000", "don't stop", "repeat it", "repeat it", "tab\t", "nl\n\n  two\n", "\ufeff\ufffd"]


@pytest.mark.parametrize("hot", [300_000, 25])
def test_alignment_is_that_of_the_libraries(spark, monkeypatch, hot):
    monkeypatch.setattr(token_alignment, "HOT_GROUPS", hot)
    draw = random.Random(8)
    say = lambda: " ".join(draw.choices(["the", "Alignment,", "tokens", "caf\u00e9s", "(x1)", "unbelievably", "\n", "\u6771\u4eac"], k=draw.randint(1, 60)))
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, say()) for i in range(200)] + [(None, "null id"), (3, "same id"), (900, "w" * 30_000), (901, " ".join(f"w{i * i % 7919}" for i in range(30_000)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit("c") for c in NAMES})
    got = token_alignment.align(frame)
    assert rows_of(got, *ALIGNED) == brute_alignment(rows)
    assert got.where("id = 'c' AND own_text = 'c'").count() == len(rows)
    assert token_alignment.align(frame.limit(0)).count() == 0


def test_keys_that_clash_are_salted_anew(spark, monkeypatch):
    rows = [(i, f"some text number {i} of its own") for i in range(40)]
    real, salts = token_alignment._encoded, []

    def clashing(*args):
        salts.append(args[-1])
        if args[-1]:
            return real(*args)
        few = F.transform("doc.keys", lambda k: k % 5)
        return real(*args).select(F.when(F.col("doc").isNotNull(), F.col("doc").withField("keys", few)).alias("doc"), F.when(F.col("entry").isNotNull(), F.col("entry").withField("key", F.col("entry.key") % 5)).alias("entry"))

    monkeypatch.setattr(token_alignment, "_encoded", clashing)
    assert rows_of(token_alignment.align(spark.createDataFrame(rows, "doc_id long, text string")), *ALIGNED) == brute_alignment(rows) and salts == [0, 1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab <|>s_/'r.1\n\t\r{\u2581\u00e9\u6771"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_alignment_fuzz(text):
    lib = test_alignment_fuzz.__dict__.setdefault("lib", libraries())
    want = brute_groups(text, *lib)
    align = token_alignment.aligner(token_alignment.default_paths())
    tokens = align(["before it", text, "after"])
    n = tokens.n_groups.tolist()
    spelled = tokens.spelled(n[0], n[0] + n[1])
    doc, _, times, group = tokens.counted()
    counted = {tokens.spelled(g, g + 1): t for d, g, t in zip(doc.tolist(), group.tolist(), times.tolist(), strict=True) if d == 1}
    got = (tokens.n_a[1], tokens.n_b[1], n[1], spelled)
    if want is None:
        assert got == (0, 0, 0, "") and not counted
    else:
        assert got == (*want[:2], len(want[2]), ";".join(want[2])) and counted == Counter(want[2])
        assert sum((Counter({x: k * n for x, k in align.links(g).items()}) for g, n in counted.items()), Counter()) == Counter(want[3])


def test_fast_encoder_is_left_where_it_differs():
    """Long runs and characters that are classed otherwise give the ids of the library."""
    a = token_alignment.aligner(token_alignment.default_paths()).a
    lib = libraries()[0]
    for text in (" " + "x" * 5000, " " * 3000 + "y", " \u0558\u088f1 x", " a\u0558b", " \U00011f02 \u1c89x", "\u2028\u0085 z"):
        assert a.encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_alignment_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    want = sorted(((*x[:-1], digest(x[-1])) for x in brute_alignment(rows)), key=repr)
    assert rows_of(token_alignment.op13_token_alignment(spark, SF), *ALIGNED[:-1], "groups_sha256") == want
